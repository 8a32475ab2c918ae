"""Sinks and audits that live long: by day, compacted, committed, kept up to date."""

import datetime as dt

import pytest
from helpers import BASE, fixture_records, keys_out, small_settings
from pyspark.sql import functions as F

from tidemark.functions.envelope import SINK_SCHEMA
from tidemark.operators import audit
from tidemark.operators.slices import SliceAudit, day_of
from tidemark.session import run_dir
from tidemark.sinks.daily import NO_DAY, DailySink, start_daily_sink
from tidemark.sinks.updates import UpdateSink, start_committed_updates
from tidemark.streaming.checkpoint import position, withheld_groups
from tidemark.streaming.replay import publish_arrivals, run_arrivals, run_per_batch

DAY = 86_400


def rows(spark, *given):
    """Sink rows of (key, seconds after BASE or None)."""
    told = [(0, None if t is None else dt.datetime.fromtimestamp(BASE + t), str(k).encode(), 1) for k, t in given]
    return spark.createDataFrame(told, SINK_SCHEMA)


def keys(df):
    return sorted(int(bytes(r["key"])) for r in df.select("key").collect())


@pytest.fixture
def sink(spark):
    return DailySink(spark, f"{run_dir(spark, 'daily-test')}/sink")


# -- K1 ----------------------------------------------------------------------
def test_a_day_lists_one_day(spark, sink):
    assert sink.read().count() == 0 and sink.days() == []
    sink.append(rows(spark, (1, 0), (2, DAY), (3, None)), 0)
    sink.append(rows(spark, (4, DAY), (5, 2 * DAY)), 1)
    first, second, third = "2023-11-14", "2023-11-15", "2023-11-16"
    assert sink.days() == [first, second, third, NO_DAY]
    one = sink.read(since=second, until=second)
    assert keys(one) == [2, 3, 4]
    assert all(second in f or NO_DAY in f for f in one.inputFiles())
    assert keys(sink.read()) == [1, 2, 3, 4, 5]


def test_a_batch_again_replaces_itself(spark, sink):
    sink.append(rows(spark, (1, 0), (2, DAY)), 0)
    sink.append(rows(spark, (1, 0), (2, DAY)), 0)
    assert keys(sink.read()) == [1, 2]


def test_compaction_swaps_under_readers(spark, sink):
    for b in range(4):
        sink.append(rows(spark, (b, 10 * b), (10 + b, DAY)), b)
    held = sink.read()
    assert sink.compact("2023-11-14", files=1)
    assert not sink.compact("2023-11-14") and not sink.compact("2030-01-01")
    want = [*range(4), *range(10, 14)]
    assert keys(held) == keys(sink.read()) == want  # before and after, each row once
    assert len(sink.read(until="2023-11-14").inputFiles()) == 1
    sink.append(rows(spark, (0, 0), (10, DAY)), 0)  # a late re-run of a compacted batch
    assert keys(sink.read()) == want
    sink.compact("2023-11-15")
    sink.vacuum(keep=1)
    assert keys(sink.read()) == want and len(sink.read().inputFiles()) == 2
    assert len(sink.files.names("manifest")) == 1


def test_a_compaction_that_lost_its_day_changes_nothing(spark, sink, monkeypatch):
    for b in range(2):
        sink.append(rows(spark, (b, 0), (10 + b, 2 * DAY)), b)
    write = sink._written

    def slow(df, folder):
        out = write(df, folder)
        DailySink(spark, sink.path).expire("2023-11-15")
        return out

    monkeypatch.setattr(sink, "_written", slow)
    assert not sink.compact("2023-11-14")
    assert keys(sink.read()) == [10, 11]


def test_writers_at_the_same_time_both_commit(spark, sink, monkeypatch):
    sink.append(rows(spark, (1, 0)), 0)
    put, once = sink.files.put_new, []

    def raced(name, text):
        if not once:
            once.append(DailySink(spark, sink.path).append(rows(spark, (2, 0)), 1))
        return put(name, text)

    monkeypatch.setattr(sink.files, "put_new", raced)
    sink.append(rows(spark, (3, 0)), 2)
    assert keys(sink.read()) == [1, 2, 3]


def test_retention(spark, sink):
    sink.append(rows(spark, (1, 0), (2, DAY), (3, None)), 0)
    sink.expire("2023-11-15")
    assert keys(sink.read()) == [2, 3]


def test_stream_gives_the_plain_sink(spark):
    recs = fixture_records(spark, [[(0, 0), (1, DAY)], [(2, DAY + 30), (3, 5)], [(4, 3 * DAY)]])
    arr = publish_arrivals(spark, recs, "batch", 3)
    plain = run_per_batch(spark, arr, small_settings(), one_run=True)
    daily = run_per_batch(spark, arr, small_settings(), one_run=True, start=start_daily_sink)
    assert keys(DailySink(spark, daily.sink).read()) == keys_out(spark, plain.sink)


# -- W3 ----------------------------------------------------------------------
def test_readers_see_committed_batches(spark):
    sink = UpdateSink(spark, f"{run_dir(spark, 'updates-test')}/sink")
    assert sink.latest().count() == 0
    one = rows(spark, (1, 0), (2, 0))
    sink.write(one, 0)
    # A batch on its way: rows without a commit record.
    one.withColumn("cnt", F.lit(7).cast("long")).write.parquet(f"{sink.path}/batch_id=1")
    assert sorted(r["cnt"] for r in sink.latest().collect()) == [1, 1]
    sink.write(one.limit(1).withColumn("cnt", F.lit(5).cast("long")), 1)
    assert sorted((r["cnt"], r["batch_id"]) for r in sink.latest().collect()) == [(1, 0), (5, 1)]
    sink.write(one.withColumn("cnt", F.lit(9).cast("long")), 1)  # committed: nothing changes
    assert sorted(r["cnt"] for r in sink.latest().collect()) == [1, 5]


def test_update_stream(spark):
    recs = fixture_records(spark, [[(0, 0), (0, 0), (2, 5)], [(0, 0), (4, 9)]])
    arr = publish_arrivals(spark, recs, "batch", 2)
    run = run_per_batch(
        spark, arr, small_settings(), output_mode="update", one_run=True, start=start_committed_updates
    )
    got = UpdateSink(spark, run.sink).latest().collect()
    assert sorted((bytes(r["key"]), r["cnt"], r["batch_id"]) for r in got) == [(b"0", 3, 1), (b"2", 1, 0), (b"4", 1, 1)]


# -- W2 / A5 -----------------------------------------------------------------
def test_state_holds_what_is_withheld(spark):
    run = run_arrivals(spark, fixture_records(spark, [[(0, 0), (1, 90)], [(2, 100), (2, 100), (3, 85)]]), "batch", 2, small_settings())
    got = withheld_groups(spark, run.checkpoint).collect()
    assert sorted((bytes(r["key"]), r["cnt"]) for r in got) == [(b"1", 1), (b"2", 2), (b"3", 1)]
    assert keys_out(spark, run.sink) == [0]


# -- A5 / W9 -----------------------------------------------------------------
def test_polls_equal_the_full_audit(spark):
    batches = [
        [(0, 0), (1, DAY), (2, DAY + 50)],
        [(3, 2 * DAY), (4, 2 * DAY + 5)],
        [(5, 3), (6, 3 * DAY), (6, 3 * DAY)],  # 5 is late by days
        [(7, DAY + 1), (8, 5 * DAY), (9, 5 * DAY + 19)],
    ]
    arr = publish_arrivals(spark, fixture_records(spark, batches), "batch", 4, by_day=True)
    root, told = run_dir(spark, "polls"), []

    def poll(b, run):
        store, at = SliceAudit(spark, root), position(spark, run.checkpoint)
        last, topic = store.progress(), arr.topic.read_batches(by_day=True)
        sent = store.to_read(topic, "batch", "day", b)
        persisted = DailySink(spark, run.sink).read(since=str(last.open_from) if last else None)
        got = store.poll(sent, persisted, b, at.watermark_ms).first()
        full = audit.reconcile(topic.where(F.col("batch") <= b), DailySink(spark, run.sink).read())
        assert got == audit.summary(full, audit.watermark_at(at.watermark_ms)).first()
        told.append((sent, persisted, got, store.progress()))

    run_per_batch(spark, arr, small_settings(), one_run=True, start=start_daily_sink, after=poll)
    sent, persisted, got, progress = told[-1]
    assert got["missing_late"] == 2 and got["missing_withheld"] == 2
    assert progress.poll == 3 and str(progress.open_from) == "2023-11-19"
    # The last poll reads no closed day of the arrivals before, and none of the sink.
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "day" in plan
    days = {str(r["day"]) for r in sent.where("batch <= 2").select("day").collect()}
    assert days == {"2023-11-16", "2023-11-17"}
    assert all(not f.split("day=")[1].startswith(("2023-11-14", "2023-11-15")) for f in persisted.inputFiles())


def test_a_failed_poll_is_run_again(spark):
    store = SliceAudit(spark, run_dir(spark, "polls"))
    records = fixture_records(spark, [[(0, 0), (1, DAY)]])
    nothing = spark.createDataFrame([], SINK_SCHEMA)
    store.poll(records, nothing, 0, 0)
    # The next one left a folder without its success mark.
    store.files.put_new("poll-1/part-00000", "broken")
    again = SliceAudit(spark, store.files.path)
    assert again.progress().poll == 0
    row = again.poll(records, nothing, 0, (BASE + 3 * DAY) * 1000).first()  # all days were open
    assert row["sent"] == row["missing_late"] == 2 and again.progress().poll == 1
    row = again.poll(records.limit(0), nothing, 1, (BASE + 3 * DAY) * 1000).first()
    assert row["sent"] == row["missing_late"] == 2 and again.progress().upto == 1


def test_days_are_closed_before_the_watermark():
    assert day_of(0) == dt.date(1970, 1, 1) and day_of(DAY * 1000 - 1) == dt.date(1970, 1, 1)
    assert day_of(DAY * 1000) == dt.date(1970, 1, 2) and day_of(-1) == dt.date(1969, 12, 31)


# -- A6 ----------------------------------------------------------------------
def test_fingerprints_tell_what_happened(spark):
    def topic(*pairs):
        told = [(p, str(k).encode(), str(v).encode()) for p, k, v in pairs]
        return spark.createDataFrame(told, "partition int, key binary, value binary")

    base = [(p, k, k + 1) for p in range(5) for k in range(20)]
    got = [x for x in base if x[0] != 0] + [x for x in base if x[0] == 0][::-1]  # 0: another order
    got.remove((1, 3, 4))  # 1: lost
    got += [(2, 5, 6)]  # 2: copied
    got = [(3, 7, 99) if x == (3, 7, 8) else x for x in got]  # 3: another value
    got = [(4, 1, 2) if x == (4, 2, 3) else x for x in got]  # 4: one lost, one twice
    told = audit.delivery_fingerprint(topic(*base), topic(*got).repartition(3)).collect()
    assert {r["partition"]: r["verdict"] for r in told} == {0: "same", 1: "lost", 2: "copied", 3: "values", 4: "other"}
    plan = audit.fingerprint(topic(*base))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(partition") == 1
    assert audit.delivery_fingerprint(topic((0, 1, 1)).limit(0), topic((0, 1, 1))).first()["verdict"] == "copied"
