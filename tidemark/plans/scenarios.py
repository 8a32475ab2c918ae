"""Record sets and streaming runs over the given tables.

Each run writes under its own directory in the shared checkpoint folder. The
registered stream queries run their stream at every call; queries that read or
audit a finished run may share one, as long as the table's files are the same.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.records import constant_records, counter_records, pair_records
from tidemark.session import app_id, pin_utc, run_dir
from tidemark.sinks.aside import count_and_records, start_aside
from tidemark.sinks.daily import start_daily_sink
from tidemark.sinks.updates import start_committed_updates
from tidemark.sources.tables import stream_table, table, table_version
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import (
    EVERY_BATCH,
    StreamSettings,
    count_per_key,
    session_conf,
    start_parquet_sink,
    trigger_args,
)
from tidemark.streaming.progress_log import ProgressLog
from tidemark.streaming.replay import (
    Arrivals,
    StreamRun,
    arrival_batch,
    publish_arrivals,
    run_per_batch,
    run_stream,
)

# Replay parameters of the registered queries (ours). They do not depend on
# the table's size: the rows that come late follow from the number of batches.
ARRIVAL_BATCHES = 6
DRAINED_BATCHES = 3
DAY_DELAY = "1 day"
TIMED_INTERVAL = "1 second"

# Finished runs by application, kind, settings and the versions of the table's files.
_RUNS: dict[tuple, StreamRun] = {}
_LOCK = threading.Lock()


def _source(spark: SparkSession, sf_dir: str, name: str, stream: bool) -> DataFrame:
    return stream_table(spark, sf_dir, name) if stream else table(spark, sf_dir, name)


def events_records(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Counter-form envelopes from ``events``: key = event_id, value = ts.
    ``stream=True`` reads the table as a stream (records encoded on the fly)."""
    pin_utc(spark)
    return counter_records(_source(spark, sf_dir, "events", stream), "event_id", "ts")


def orders_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair-form envelopes from ``orders``: ``key_<o_orderkey>`` -> ``val_<o_custkey>``."""
    pin_utc(spark)
    return pair_records(
        table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderdate", "o_orderkey"
    )


def lineitem_constant_records(
    spark: SparkSession, sf_dir: str, stream: bool = False
) -> DataFrame:
    """Constant-form envelopes, one per lineitem row: every record carries
    the same ``("key", "value")``; record time = ship date; ``l_orderkey * 8 +
    l_linenumber`` places it in a partition (it is no offset: it repeats)."""
    pin_utc(spark)
    li = _source(spark, sf_dir, "lineitem", stream).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rid"), "l_shipdate"
    )
    return constant_records(li, "l_shipdate", "rid")


def events_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes plus the arrival batch of each record. One count (answered from
    Parquet footers) places the ids in the batches."""
    events = table(spark, sf_dir, "events")
    pin_utc(spark)
    return counter_records(
        events.withColumn("batch", arrival_batch("event_id", events.count(), ARRIVAL_BATCHES)),
        "event_id",
        "ts",
        carry=["batch"],
    )


STATE_PARTITIONS_CONF = "tidemark.statePartitions"
STATE_STORE_CONF = "tidemark.stateStore"


def default_settings(spark: SparkSession, **kw) -> StreamSettings:
    """State partitions: ``tidemark.statePartitions`` when the session sets
    it, else ``spark.sql.shuffle.partitions`` as submitted (the number of cores known
    when the first query runs may be small under dynamic allocation, and the
    checkpoint freezes it). State store: ``tidemark.stateStore``
    (``rocksdb`` or ``hdfs``) when set, else the ``StreamSettings`` default."""
    configured = spark.conf.get(STATE_PARTITIONS_CONF, None)
    parts = int(configured or spark.conf.get("spark.sql.shuffle.partitions"))
    store = spark.conf.get(STATE_STORE_CONF, None)
    if store:
        kw.setdefault("state_store", store)
    # The registered runs state Spark's defaults for the two semantic
    # switches instead of inheriting whatever the session has.
    for switch in ("allow_multiple", "no_data_batches"):
        if kw.get(switch) is None:
            kw[switch] = True
    # Bounded replays report every micro-batch (stream_progress).
    kw.setdefault("progress_retention", EVERY_BATCH)
    return StreamSettings(state_partitions=max(parts, 1), **kw)


def _layout(settings: StreamSettings) -> tuple:
    """The parts of the settings that shape a run's output and checkpoint."""
    return (
        settings.delay, settings.state_store, settings.state_partitions,
        settings.allow_multiple, settings.no_data_batches,
    )


def finished(spark: SparkSession, sf_dir: str, name: str, kind: str, settings, make) -> StreamRun:
    """A finished run for a query that only reads one: that of an earlier call if
    the table's files have not changed, else a new one."""
    key = (app_id(spark), kind, _layout(settings), table_version(spark, sf_dir, name))
    with _LOCK:
        run = _RUNS.get(key)
    if run is None:
        run = make(spark, sf_dir)
        with _LOCK:
            _RUNS[key] = run
    return run


def single_run(spark: SparkSession, sf_dir: str, delay: str | None = None) -> StreamRun:
    """The flagship: the events table itself is the stream (records encoded
    on the fly, no copy), read by one run that ends with the no-data batch."""
    settings = default_settings(spark, **({"delay": delay} if delay else {}))
    records = events_records(spark, sf_dir, stream=True)
    return run_stream(spark, records, settings, "single", f"{sf_dir}/events.parquet")


def timed_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    """The flagship under a processing-time trigger (W4), stopped when it has caught up."""
    settings = default_settings(spark, query_name="timed")
    root = run_dir(spark, "timed")
    sink, ckpt = f"{root}/sink", f"{root}/checkpoint"
    counted = count_per_key(events_records(spark, sf_dir, stream=True), settings.delay)
    with session_conf(spark, settings.conf(spark)):
        query = start_parquet_sink(
            counted, sink, ckpt, settings.query_name, trigger_args("processing", TIMED_INTERVAL)
        )
    try:
        query.processAllAvailable()  # raises what the query failed with
        progress = [dict(p) for p in query.recentProgress]
    finally:
        query.stop()
    return StreamRun(sink, ckpt, f"{sf_dir}/events.parquet", progress)


def newcomer_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    """The arrivals, by a consumer that came when half of the batches had gone by (S2, ``latest``)."""
    return run_per_batch(
        spark, arrivals_topic(spark, sf_dir), default_settings(spark), "newcomer",
        one_run=True, start_at=DRAINED_BATCHES,
    )


def finished_single_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    return finished(spark, sf_dir, "events", "single", default_settings(spark), single_run)


def constant_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    """The flagship over constant-form records: one key on every record."""
    records = lineitem_constant_records(spark, sf_dir, stream=True)
    return run_stream(
        spark, records, default_settings(spark), "constant", f"{sf_dir}/lineitem.parquet"
    )


def arrivals_topic(spark: SparkSession, sf_dir: str, by_day: bool = False) -> Arrivals:
    """The arrival batches, published."""
    return publish_arrivals(
        spark, events_arrivals(spark, sf_dir), "batch", ARRIVAL_BATCHES, by_day=by_day
    )


def arrivals_run(
    spark: SparkSession,
    sf_dir: str,
    no_data_batches: bool | None = None,
    output_mode: str = "append",
    allow_multiple: bool | None = None,
) -> StreamRun:
    """The arrival batches, every tenth record held back three batches, one run."""
    settings = default_settings(
        spark, no_data_batches=no_data_batches, allow_multiple=allow_multiple
    )
    arr = arrivals_topic(spark, sf_dir)
    label = "arrivals-" + output_mode + ("-strict" if allow_multiple is False else "")
    return run_per_batch(spark, arr, settings, label, output_mode=output_mode, one_run=True)


def committed_updates_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    """The arrivals in update mode, each batch with its commit record."""
    return run_per_batch(
        spark, arrivals_topic(spark, sf_dir), default_settings(spark), "updates",
        output_mode="update", one_run=True, start=start_committed_updates,
    )


def daily_run(spark: SparkSession, sf_dir: str, after=None, last: int | None = None) -> StreamRun:
    """The arrivals (the first ``last`` batches) into the sink by day; ``after`` runs after each batch."""
    arr = arrivals_topic(spark, sf_dir, by_day=True)
    return run_per_batch(
        spark, arr, default_settings(spark), "daily", one_run=True, start=start_daily_sink, after=after, last=last
    )


def aside_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    """The arrivals with their late records kept aside as they are dropped."""
    return run_per_batch(
        spark, arrivals_topic(spark, sf_dir), default_settings(spark), "aside",
        one_run=True, start=start_aside, plan=count_and_records,
    )


def handed_over_run(spark: SparkSession, sf_dir: str) -> tuple[ProgressLog, StreamRun]:
    """The arrivals, read halfway by one session and to their end by another, with the log of
    the progress of both."""
    arr, root = arrivals_topic(spark, sf_dir), run_dir(spark, "handed-over")
    first = ProgressLog(spark, f"{root}/progress")
    settings = default_settings(spark, query_name="handed_over")
    run_per_batch(spark, arr, settings, last=DRAINED_BATCHES, root=root, one_run=True, log=first)
    other = spark.newSession()
    pin_utc(other)
    rest = Arrivals(FileTopic(other, arr.topic.path), arr.n_batches)
    run = run_per_batch(
        other, rest, settings, first=DRAINED_BATCHES + 1, root=root, one_run=True,
        log=ProgressLog(other, first.path),
    )
    return first, run


def finished_arrivals_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    return finished(spark, sf_dir, "events", "arrivals", default_settings(spark), arrivals_run)


def resume_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    """The same arrivals, one run after each batch on one checkpoint."""
    return run_per_batch(spark, arrivals_topic(spark, sf_dir), default_settings(spark))


def drained_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    """All arrivals published, the first ``DRAINED_BATCHES`` of them read: a stream
    that lags behind its topic."""
    arr = arrivals_topic(spark, sf_dir)
    return run_per_batch(spark, arr, default_settings(spark), "drained", last=DRAINED_BATCHES)
