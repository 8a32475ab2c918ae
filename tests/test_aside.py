"""Late records kept aside as they are dropped, and progress that outlives the session."""

import pytest
from helpers import fixture_records, small_settings
from pyspark.sql import functions as F

from tidemark.functions.envelope import key_to_id
from tidemark.operators import audit
from tidemark.session import run_dir
from tidemark.sinks.aside import AsideSink, count_and_records, start_aside
from tidemark.sources.tables import read_sink
from tidemark.sources.topic import FileTopic
from tidemark.streaming.progress import progress_table
from tidemark.streaming.progress_log import ProgressLog
from tidemark.streaming.replay import Arrivals, publish_arrivals, run_per_batch

# Each batch holds records that some rule finds late; 31 comes late twice, as two records.
BATCHES = [
    [(1, 0), (2, 100)],
    [(3, 200), (4, 70), (5, 81)],
    [(6, 300), (7, 90), (8, 150), (31, 10), (31, 10)],
    [(9, 400), (10, 179), (11, 250), (12, 381)],
]
RULES = {
    "append": ({}, True),
    "strict": ({"allow_multiple": False}, True),
    "resume": ({}, False),
}


def ids(df):
    return sorted(r["id"] for r in df.select(key_to_id("key").alias("id")).collect())


@pytest.mark.parametrize("rule", RULES)
def test_aside_holds_what_the_audit_finds_late(spark, rule):
    kw, one_run = RULES[rule]
    arr = publish_arrivals(spark, fixture_records(spark, BATCHES), "batch", len(BATCHES))
    plain = run_per_batch(spark, arr, small_settings(**kw), one_run=one_run)
    run = run_per_batch(
        spark, arr, small_settings(**kw), one_run=one_run, start=start_aside, plan=count_and_records
    )
    sink = AsideSink(spark, run.sink, run.checkpoint)
    persisted = read_sink(spark, plain.sink)
    assert ids(sink.groups()) == ids(persisted)
    missing = audit.missing(
        audit.reconcile(arr.topic.read(), persisted), audit.watermark_at(plain.final_watermark_ms)
    )
    late = missing.where("reason = 'late'")
    told = sorted(i for r in late.collect() for i in [r["id"]] * r["n_missing"])
    assert told and ids(sink.late()) == told
    # Whole records: the value is there, and each lies in the batch that brought it.
    brought = {k: b for b, batch in enumerate(BATCHES) for k, _ in batch}
    rows = sink.late().select(key_to_id("key").alias("id"), "value", "batch_id").collect()
    order = sorted({r["batch_id"] for r in rows})
    assert all(r["value"] is not None for r in rows)
    assert order == sorted(order) and len({(brought[r["id"]], r["batch_id"]) for r in rows}) == len(order)


def test_a_committed_batch_is_not_written_again(spark):
    arr = publish_arrivals(spark, fixture_records(spark, BATCHES), "batch", len(BATCHES))
    run = run_per_batch(spark, arr, small_settings(), one_run=True, start=start_aside, plan=count_and_records)
    sink = AsideSink(spark, run.sink, run.checkpoint)
    before = sorted(map(str, sink.changes().collect()))
    sink.write(sink.changes().where("batch_id = 2").drop("batch_id").limit(0), 2)
    assert sorted(map(str, sink.changes().collect())) == before
    # Files of a batch without a commit record are not read.
    sink.changes().where("batch_id = 2").drop("batch_id").write.partitionBy("kind").parquet(f"{sink.path}/batch_id=99")
    assert sorted(map(str, sink.changes().collect())) == before


def test_records_without_a_time_are_not_late(spark):
    records = fixture_records(spark, BATCHES).withColumn(
        "timestamp", F.when(key_to_id("key") != 31, F.col("timestamp"))
    )
    arr = publish_arrivals(spark, records, "batch", len(BATCHES))
    run = run_per_batch(spark, arr, small_settings(), one_run=True, start=start_aside, plan=count_and_records)
    assert 31 not in ids(AsideSink(spark, run.sink, run.checkpoint).late())


def test_empty_sink(spark):
    root = run_dir(spark, "aside-empty")
    sink = AsideSink(spark, f"{root}/sink", f"{root}/checkpoint")
    assert sink.groups().count() == 0 and sink.late().count() == 0


# -- W9 ------------------------------------------------------------------------
COUNTERS = ["batch_id", "input_rows", "watermark", "state_rows", "state_rows_updated", "dropped_by_watermark"]


def counters(df):
    return sorted(map(tuple, df.select(*COUNTERS).collect()))


def test_progress_of_two_sessions(spark):
    arr = publish_arrivals(spark, fixture_records(spark, BATCHES), "batch", len(BATCHES))
    whole = run_per_batch(spark, arr, small_settings(), one_run=True)
    root = run_dir(spark, "handed-over")
    log = ProgressLog(spark, f"{root}/progress")
    assert log.table().count() == 0 and log.compact() == 0
    run_per_batch(spark, arr, small_settings(), last=2, root=root, one_run=True, log=log)
    assert sorted(r["batch_id"] for r in log.table().collect()) == [0, 1]
    assert log.compact() == 2
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    rest = Arrivals(FileTopic(other, arr.topic.path), arr.n_batches)
    run = run_per_batch(
        other, rest, small_settings(), first=3, root=root, one_run=True, log=ProgressLog(other, log.path)
    )
    expected = counters(progress_table(spark, whole.progress))
    assert counters(log.table()) == expected == counters(log.table(run.checkpoint))
    assert log.table(run.checkpoint).where("NOT reported").count() == 0
    # An event that is there twice counts once.
    for row in spark.read.text(f"{log.path}/events").collect():
        log.put(row["value"])
    assert log.compact() == 3 and log.batches() == set()
    assert counters(log.table()) == expected


def test_a_batch_without_an_event_is_told_from_the_checkpoint(spark):
    arr = publish_arrivals(spark, fixture_records(spark, BATCHES), "batch", len(BATCHES))
    root = run_dir(spark, "lost-driver")
    log = ProgressLog(spark, f"{root}/progress")
    run = run_per_batch(spark, arr, small_settings(), root=root, one_run=True, log=log)
    before = {r["batch_id"]: r for r in log.table(run.checkpoint).collect()}
    for name in [n for n in log.files.names("events") if n.startswith("2-")]:
        log.files.delete(f"events/{name}")
    after = {r["batch_id"]: r for r in log.table(run.checkpoint).collect()}
    assert set(after) == set(before) and not after[2]["reported"]
    assert after[2]["watermark"] == before[2]["watermark"] and after[2]["input_rows"] is None
    assert all(after[b] == before[b] for b in before if b != 2)
