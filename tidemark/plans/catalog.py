"""Registered queries: one per operator of the inventory, each a function of
``(spark, sf_dir)`` returning a DataFrame over the given tables.

Streaming queries run their stream to completion (bounded ``availableNow``
runs over a replayed topic) and return a batch read of what it persisted.
Queries that only read or audit a finished run may share it (``scenarios.finished``).
Keys come back decoded and event times as TIMESTAMP_NTZ so that results
compare with plain SQL engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.envelope import as_wall_clock, bytes_to_text, key_to_id
from tidemark.operators import audit
from tidemark.operators.aggregate import group_count, latest, mean_of
from tidemark.operators.order import first_rows, sorted_by
from tidemark.operators.slices import SliceAudit
from tidemark.operators.records import decode_ids, decode_records, project_records
from tidemark.plans import bounded
from tidemark.plans import scenarios as sc
from tidemark.session import pin_utc, run_dir
from tidemark.sinks.aside import AsideSink
from tidemark.sinks.daily import DailySink
from tidemark.sinks.files import overwrite_parquet
from tidemark.sinks.updates import UpdateSink
from tidemark.sources.tables import read_sink, scan_parquet, table
from tidemark.sources.topic import FileTopic
from tidemark.streaming.checkpoint import position, withheld_groups
from tidemark.streaming.progress import progress_table
from tidemark.streaming.watch import Watch

Query = Callable[[SparkSession, str], DataFrame]

WATCH_SCHEMA = (
    "sent long, persisted_rows long, persisted long, latest_persisted timestamp_ntz, missing_late long, "
    "missing_withheld long, malformed_keys long, complete boolean, missing_unread long, batch int"
)

#: Retention of the registered sink by day.
KEPT_FROM = "2024-01-16"


# -- shared shapes ----------------------------------------------------------
def sink_rows(spark: SparkSession, path: str) -> DataFrame:
    """A sink read back (S5) with the key decoded and time as wall clock."""
    return read_sink(spark, path).select(
        "partition",
        as_wall_clock("timestamp").alias("timestamp"),
        key_to_id("key").alias("key"),
        "cnt",
    )


def _published(spark: SparkSession, label: str, records: DataFrame) -> FileTopic:
    topic = FileTopic(spark, f"{run_dir(spark, label)}/topic")
    topic.publish(records)
    return topic


def _roundtrip_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 -> K2 -> S5: the ids of the events, written and read back."""
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return scan_parquet(spark, overwrite_parquet(ids, f"{run_dir(spark, 'range')}/ids"))


# -- streaming (S1, K1, W1-W9, P4) -----------------------------------------
def stream_append_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship (S1, W1, W2, K1): events published, one run, the sink read back."""
    return sink_rows(spark, sc.single_run(spark, sf_dir).sink)


def stream_append_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship with a one-day delay: rows within a day of the newest wait."""
    return sink_rows(spark, sc.single_run(spark, sf_dir, delay=sc.DAY_DELAY).sink)


def stream_append_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same key on every record: groups differ only by partition and
    time, so counts are well above one."""
    return read_sink(spark, sc.constant_run(spark, sf_dir).sink).select(
        "partition",
        as_wall_clock("timestamp").alias("timestamp"),
        bytes_to_text("key").alias("key"),
        "cnt",
    )


def stream_append_multibatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival batches with held-back records, one run."""
    return sink_rows(spark, sc.arrivals_run(spark, sf_dir).sink)


def stream_append_strict_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows judged against the current batch's watermark
    (``allowMultiple=false``), as Spark releases before multiple stateful
    operators did: records one batch late are dropped too."""
    return sink_rows(spark, sc.arrivals_run(spark, sf_dir, allow_multiple=False).sink)


def stream_nodata_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals run without the closing no-data batch."""
    return sink_rows(spark, sc.arrivals_run(spark, sf_dir, no_data_batches=False).sink)


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per arrival batch on one checkpoint."""
    return sink_rows(spark, sc.resume_run(spark, sf_dir).sink)


def stream_update_foreachbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode through foreachBatch, one directory per batch id."""
    run = sc.arrivals_run(spark, sf_dir, output_mode="update")
    return read_sink(spark, run.sink, batch_partitioned=True).select(
        "batch_id",
        "partition",
        as_wall_clock("timestamp").alias("timestamp"),
        key_to_id("key").alias("key"),
        "cnt",
    )


def _arrivals_audit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Reconcile what was published to the topic with what the sink holds."""
    run = sc.finished_arrivals_run(spark, sf_dir)
    sent = FileTopic(spark, run.topic).read()
    reconciled = audit.reconcile(sent, read_sink(spark, run.sink))
    if run.final_watermark_ms is None:  # no batch reported one: derive it
        return reconciled, audit.expected_watermark(sent, sc.default_settings(spark).delay)
    return reconciled, audit.watermark_at(run.final_watermark_ms)


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records the arrivals run dropped as late (P4, W5), found by the audit."""
    reconciled, wm = _arrivals_audit(spark, sf_dir)
    return (
        audit.missing(reconciled, wm)
        .where(F.col("reason") == "late")
        .select("id", "timestamp", "partition")
    )


def stream_processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship under a processing-time trigger, stopped when it has caught up."""
    return sink_rows(spark, sc.timed_run(spark, sf_dir).sink)


def stream_from_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals, by a consumer that starts at the end of the first three batches."""
    return sink_rows(spark, sc.newcomer_run(spark, sf_dir).sink)


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine reported for each micro-batch of the arrivals run
    (the deterministic counters; durations are left out)."""
    return progress_table(spark, sc.arrivals_run(spark, sf_dir).progress).drop("duration_ms")


def stream_late_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late records of the arrivals, written aside by the micro-batch that drops them."""
    run = sc.aside_run(spark, sf_dir)
    return AsideSink(spark, run.sink, run.checkpoint).late().select(
        key_to_id("key").alias("id"),
        as_wall_clock("timestamp").alias("timestamp"),
        "partition",
        "offset",
        bytes_to_text("value").alias("value"),
        "batch_id",
    )


def stream_progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress of a run that one session began and another ended, from its log."""
    log, run = sc.handed_over_run(spark, sf_dir)
    return log.table(run.checkpoint).drop("duration_ms")


def stream_time_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over all that waits, in time order (W2): state holds a batch, not all."""
    return sink_rows(spark, bounded.time_ordered_run(spark, sf_dir).sink)


def stream_update_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest count of each group, from the committed update batches."""
    run = sc.committed_updates_run(spark, sf_dir)
    return UpdateSink(spark, run.sink).latest().select(
        "partition",
        as_wall_clock("timestamp").alias("timestamp"),
        key_to_id("key").alias("key"),
        "cnt",
        "batch_id",
    )


def sink_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals in the sink by day, every day compacted, half of them expired (K1)."""
    sink = DailySink(spark, sc.daily_run(spark, sf_dir).sink)
    days = sink.days()
    for day in days:
        sink.compact(day)
    sink.expire(KEPT_FROM)
    sink.vacuum()
    return sink.read().select(
        F.to_date("timestamp").alias("day"),
        "partition",
        as_wall_clock("timestamp").alias("timestamp"),
        key_to_id("key").alias("key"),
        "cnt",
    )


def withheld_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the flagship withholds, read from its state store."""
    run = sc.finished_single_run(spark, sf_dir)
    return withheld_groups(spark, run.checkpoint).select(
        "partition",
        as_wall_clock("timestamp").alias("timestamp"),
        key_to_id("key").alias("key"),
        "cnt",
    )


# -- audit (A3, A5, A6) -----------------------------------------------------
def audit_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll after each arrival batch that reads only what is new (A5, W9): one row a poll."""
    root = f"{run_dir(spark, 'slices')}/totals"
    rows = []

    def poll(batch: int, run) -> None:
        store = SliceAudit(spark, root)
        last, at = store.progress(), position(spark, run.checkpoint)
        sent = store.to_read(FileTopic(spark, run.topic).read_batches(by_day=True), "batch", "day", batch)
        since = str(last.open_from) if last else None
        persisted = DailySink(spark, run.sink).read(since=since)
        row = store.poll(sent, persisted, batch, at.watermark_ms)
        rows.append(row.withColumn("batch", F.lit(batch)))

    sc.daily_run(spark, sf_dir, after=poll)
    return reduce(DataFrame.unionByName, rows)


def audit_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watch of a lagging query (A5, W9): a poll after each of the three batches that it has
    read, told by its checkpoint which files are new; one row a poll."""
    root, rows = f"{run_dir(spark, 'watch')}/totals", []

    def poll(batch: int, run) -> None:
        row = Watch(spark, FileTopic(spark, run.topic), run.sink, run.checkpoint, root).poll()
        rows.append(Row(**row.asDict(), batch=batch))

    sc.daily_run(spark, sf_dir, after=poll, last=sc.DRAINED_BATCHES)
    return spark.createDataFrame(rows, WATCH_SCHEMA)


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row completeness audit of the arrivals run (A3, A5)."""
    reconciled, wm = _arrivals_audit(spark, sf_dir)
    return audit.summary(reconciled, wm)


def audit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the arrivals run that is not persisted, with the reason (A5)."""
    reconciled, wm = _arrivals_audit(spark, sf_dir)
    return audit.missing(reconciled, wm)


def audit_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poll's question asked of the flagship (A2, A3, A5): how many of
    the events sent are persisted, the latest persisted time, and why the
    rest are missing."""
    run = sc.finished_single_run(spark, sf_dir)
    sent = sc.events_records(spark, sf_dir)
    reconciled = audit.reconcile(sent, read_sink(spark, run.sink))
    return audit.summary(reconciled, audit.watermark_at(run.final_watermark_ms))


def audit_in_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing from the sink of a stream that has read three of six arrival
    batches (A5): late, withheld, or not read yet; told from its checkpoint."""
    run = sc.drained_run(spark, sf_dir)
    at = position(spark, run.checkpoint)
    sent = FileTopic(spark, run.topic).read_marked(run.checkpoint, at)
    reconciled = audit.reconcile_progress(sent, read_sink(spark, run.sink))
    return audit.missing_progress(reconciled, audit.watermark_at(at.watermark_ms))


def delivery_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders published as pair records and consumed: at least all of them."""
    sent = sc.orders_records(spark, sf_dir)
    topic = _published(spark, "delivery", sent)
    return audit.delivery_check(sent, topic.read())


def delivery_check_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery drill with identical records (A6): lineitem is what was to be sent as
    ``("key", "value")`` records; a topic that got partition 0 of it only is asked
    for one record fewer than it holds, for as many, for one more, and for all."""
    lineitem = sc.lineitem_constant_records(spark, sf_dir)
    topic = _published(spark, "drill", lineitem.where(F.col("partition") == 0))
    here = table(spark, sf_dir, "lineitem").where("pmod(l_linenumber, 2) = 0")
    n = here.agg(F.count(F.lit(1)).alias("n")).scalar()
    return audit.delivery_check(lineitem, topic.read(), n - 1, n, n + 1, None)


def delivery_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders published twice over, with losses, copies and swapped values (A6): the
    fingerprints of each partition tell which."""
    sent = sc.orders_records(spark, sf_dir)
    rid = F.expr("offset * 2 + partition")
    lost = sent.where(F.when(F.col("partition") == 0, rid % 100 != 0).otherwise(True))
    twice = sent.where((F.col("partition") == 1) & (rid % 100 == 1))
    topic = _published(spark, "fingerprint", lost.unionByName(twice))
    return audit.delivery_fingerprint(sent, topic.read())


def consume_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each partition between two offsets (S6): a quarter of them, by data
    skipping on a topic that is clustered by partition and offset."""
    topic = FileTopic(spark, f"{run_dir(spark, 'offsets')}/topic")
    topic.publish_clustered(sc.events_records(spark, sf_dir))
    n = table(spark, sf_dir, "events").count()
    return decode_records(topic.read_offsets({0: (n // 8, n // 4), 1: (n // 4, 3 * n // 8)}))


# -- reads of the flagship sink (S5, P2, P3, A2, O1) -------------------------
def decode_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted keys of the flagship decoded to integers."""
    return decode_ids(read_sink(spark, sc.finished_single_run(spark, sf_dir).sink))


def sorted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded ids in numeric order (O1)."""
    # Sink rows are unique per (partition, timestamp, key): a skew-proof tiebreak.
    sink = read_sink(spark, sc.finished_single_run(spark, sf_dir).sink)
    ids = sink.select(key_to_id("key").alias("id"), "timestamp", "partition", "key")
    return sorted_by(ids, "id", ["timestamp", "partition", "key"]).select("id")


def max_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest persisted record time of the flagship (A2)."""
    sink = read_sink(spark, sc.finished_single_run(spark, sf_dir).sink)
    return latest(sink, "timestamp").select(as_wall_clock("latest").alias("latest"))


# -- records (K3, S6, P1, F1-F5) ---------------------------------------------
def envelope_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter-form records as written to the topic, bytes in hex."""
    topic = _published(spark, "encode", sc.events_records(spark, sf_dir))
    return topic.read().select(
        F.hex("key").alias("key_hex"),
        F.hex("value").alias("value_hex"),
        "topic",
        "partition",
        "offset",
        as_wall_clock("timestamp").alias("timestamp"),
        "timestampType",
    )


def envelope_encode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair-form records from orders as written, decoded."""
    topic = _published(spark, "pairs", sc.orders_records(spark, sf_dir))
    return topic.read().select(
        bytes_to_text("key").alias("key"),
        bytes_to_text("value").alias("value"),
        "partition",
        "offset",
        as_wall_clock("timestamp").alias("timestamp"),
    )


def envelope_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a consumer reads back from the topic."""
    topic = _published(spark, "consume", sc.events_records(spark, sf_dir))
    return decode_records(topic.read())


def project_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three columns the count needs."""
    return project_records(sc.events_records(spark, sf_dir)).select(
        bytes_to_text("key").alias("key"),
        as_wall_clock("timestamp").alias("timestamp"),
        "partition",
    )


# -- batch operators (A1, A4, S4, S5, K2, O2) --------------------------------
def group_count_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the streaming count on the event records (A1)."""
    counted = group_count(sc.events_records(spark, sf_dir))
    return counted.select(
        "partition",
        as_wall_clock("timestamp").alias("timestamp"),
        key_to_id("key").alias("key"),
        "cnt",
    )


def group_count_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 on lineitem, where groups hold several rows."""
    pin_utc(spark)
    li = table(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(4)).cast("int").alias("partition"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("key"),
    )
    return group_count(li)


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain Parquet scan of the events table."""
    return scan_parquet(spark, f"{sf_dir.rstrip('/')}/events.parquet")


def range_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the events written and read back."""
    return _roundtrip_ids(spark, sf_dir)


def top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 20 ids of the round trip (O2)."""
    return first_rows(_roundtrip_ids(spark, sf_dir), "id", 20)


def mean_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean id of the round trip (A4)."""
    return mean_of(_roundtrip_ids(spark, sf_dir), "id", "mean_id")


def _in_utc(fn: Query) -> Query:
    """Every query renders and compares event time in UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


_PLAIN: dict[str, Query] = {
    "stream_append_single": stream_append_single,
    "stream_append_day": stream_append_day,
    "stream_append_constant": stream_append_constant,
    "stream_append_multibatch": stream_append_multibatch,
    "stream_append_strict_late": stream_append_strict_late,
    "stream_late_rows": stream_late_rows,
    "stream_nodata_off": stream_nodata_off,
    "stream_resume": stream_resume,
    "stream_update_foreachbatch": stream_update_foreachbatch,
    "stream_processing_time": stream_processing_time,
    "stream_from_latest": stream_from_latest,
    "stream_progress": stream_progress,
    "stream_late_aside": stream_late_aside,
    "stream_progress_log": stream_progress_log,
    bounded.NAME: stream_time_ordered,
    "stream_update_latest": stream_update_latest,
    "sink_daily": sink_daily,
    "withheld_state": withheld_state,
    "audit_incremental": audit_incremental,
    "audit_watch": audit_watch,
    "delivery_fingerprint": delivery_fingerprint,
    "consume_range": consume_range,
    "audit_summary": audit_summary,
    "audit_missing": audit_missing,
    "audit_flagship": audit_flagship,
    "audit_in_progress": audit_in_progress,
    "delivery_check": delivery_check,
    "delivery_check_constant": delivery_check_constant,
    "decode_key": decode_key,
    "sorted_ids": sorted_ids,
    "max_timestamp": max_timestamp,
    "envelope_encode": envelope_encode,
    "envelope_encode_pair": envelope_encode_pair,
    "envelope_decode": envelope_decode,
    "project_envelope": project_envelope,
    "group_count": group_count_events,
    "group_count_wide": group_count_wide,
    "parquet_scan": parquet_scan,
    "range_roundtrip": range_roundtrip,
    "top20": top20,
    "mean_id": mean_id,
}

QUERIES: dict[str, Query] = {name: _in_utc(fn) for name, fn in _PLAIN.items()}
