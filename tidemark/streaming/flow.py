"""The flagship flow: watermark, per-key count, Parquet sink.

    records --select(key, timestamp, partition)--> withWatermark(timestamp, d)
            --groupBy(partition, timestamp, key).count--> append to Parquet

Spark's semantics on this plan, which the tests pin down:

* eviction watermark in batch b: E_b = max event time of batches < b
  (milliseconds) minus d; a group is emitted once, when its timestamp <= E_b,
  and leaves the state store;
* (W5) late watermark in batch b: E_{b-1} while
  ``spark.sql.streaming.statefulOperator.allowMultiple`` is true (default),
  E_b when false; rows with timestamp <= it are dropped;
* (W6) after the last data batch a no-data batch moves E to max - d (unless
  ``spark.sql.streaming.noDataMicroBatches.enabled`` is false); rows within d
  of the maximum stay in state until newer data arrives.
"""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.envelope import GROUP_KEY, TRIGGER_INTERVAL, WATERMARK_DELAY
from tidemark.operators.aggregate import group_count
from tidemark.operators.records import project_records
from tidemark.session import is_local, parallelism

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HDFS_PROVIDER = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
ROCKSDB_BOUNDED_MEMORY = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"


#: Progress retention of a run that reports all its micro-batches.
EVERY_BATCH = 2**31 - 1


@dataclass(frozen=True)
class StreamSettings:
    """Knobs of one streaming run.

    ``state_partitions`` is frozen into the checkpoint by the first run, so
    outside local mode it must be given: size it to the cluster (state is spread
    over that many tasks). State lives in RocksDB on the executors' local disks
    (not in JVM memory) with changelog checkpointing and one bounded native
    memory budget per executor, which costs nothing locally and keeps a
    large state from exhausting executor memory;
    ``state_store="hdfs"`` selects Spark's in-memory default instead. The
    provider is frozen into the checkpoint as well.

    ``snapshots`` stores RocksDB's own files with each batch instead of a log of its
    changes, for a series of short runs on one checkpoint: each run loads the state anew, and
    without a snapshot it would replay the changes of all batches before. It is
    not frozen: runs of both kinds take up each other's checkpoints.

    ``None`` for the two semantic switches keeps Spark's defaults:
    ``allow_multiple`` picks the late watermark (W5), ``no_data_batches``
    the final emission (W6).
    """

    delay: str = WATERMARK_DELAY
    state_partitions: int | None = None  # local mode: one per core
    allow_multiple: bool | None = None
    no_data_batches: bool | None = None
    state_store: str = "rocksdb"  # or "hdfs": Spark's in-memory provider
    snapshots: bool = False  # right for one long run: a small log with each batch
    query_name: str = "per_key_count"
    # A bounded (availableNow) run ends by itself; a limit stops it before
    # that, and its checkpoint can be run again.
    timeout_s: float | None = None
    # Progress events kept per query (one small record per micro-batch).
    # None keeps Spark's 100, right for a live query that runs for weeks; a
    # bounded replay that reports every batch keeps ``EVERY_BATCH``.
    progress_retention: int | None = None
    extra_conf: dict[str, str] = field(default_factory=dict)

    def conf(self, spark: SparkSession | None = None) -> dict[str, str]:
        """The SQL settings of a run; ``spark`` tells the default state partitions."""
        c = {}
        parts = self.state_partitions
        if parts is None and spark is not None:
            if not is_local(spark):
                raise ValueError("state_partitions must be given outside local mode")
            parts = parallelism(spark)
        if parts is not None:
            c["spark.sql.shuffle.partitions"] = str(parts)
        if self.allow_multiple is not None:
            c["spark.sql.streaming.statefulOperator.allowMultiple"] = str(
                self.allow_multiple
            ).lower()
        if self.no_data_batches is not None:
            c["spark.sql.streaming.noDataMicroBatches.enabled"] = str(
                self.no_data_batches
            ).lower()
        if self.state_store == "rocksdb":
            c["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB_PROVIDER
            c[ROCKSDB_CHANGELOG] = str(not self.snapshots).lower()
            # All state partitions of an executor share one native memory
            # budget, however many of them it hosts.
            c[ROCKSDB_BOUNDED_MEMORY] = "true"
        elif self.state_store == "hdfs":
            c["spark.sql.streaming.stateStore.providerClass"] = HDFS_PROVIDER
        else:
            raise ValueError(f"unknown state store {self.state_store!r}")
        c.update(self.extra_conf)
        return c


_STARTING = threading.Lock()


@contextlib.contextmanager
def session_conf(spark: SparkSession, conf: dict[str, str]):
    """Apply SQL settings while a query starts, then restore them.

    A streaming query clones the session when it starts, so settings made
    here are the ones its micro-batches run with. Keep nothing else in the
    block: the settings hold for the whole session, for one starting query at a time.
    """
    with _STARTING:
        before = {k: spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)


PROGRESS_RETENTION = "spark.sql.streaming.numRecentProgressUpdates"
_HOLDERS: list[int] = []
_BEFORE: list[str | None] = []


@contextlib.contextmanager
def progress_kept(spark: SparkSession, batches: int | None):
    """Hold the progress retention while a run is waited for. Spark reads it from the
    session at each micro-batch, not from the query's copy; runs at the same time
    share the largest, and the last of them restores it."""
    if batches is None:
        yield
        return
    with _STARTING:
        if not _HOLDERS:
            _BEFORE[:] = [spark.conf.get(PROGRESS_RETENTION, None)]
        _HOLDERS.append(batches)
        spark.conf.set(PROGRESS_RETENTION, str(max(_HOLDERS)))
    try:
        yield
    finally:
        with _STARTING:
            _HOLDERS.remove(batches)
            if _HOLDERS:
                spark.conf.set(PROGRESS_RETENTION, str(max(_HOLDERS)))
            elif _BEFORE[0] is None:
                spark.conf.unset(PROGRESS_RETENTION)
            else:
                spark.conf.set(PROGRESS_RETENTION, _BEFORE[0])


def count_per_key(records: DataFrame, delay: str = WATERMARK_DELAY) -> DataFrame:
    """W1 + W2: watermark on the record time, then A1 on (partition, timestamp, key)."""
    return group_count(project_records(records).withWatermark("timestamp", delay), GROUP_KEY)


def trigger_args(mode: str = "available_now", interval: str = TRIGGER_INTERVAL) -> dict:
    """``processing`` fires every ``interval`` (half the delay by default)
    on a live source; ``available_now`` drains what is there and stops."""
    if mode == "processing":
        return {"processingTime": interval}
    return {"availableNow": True}


def start_parquet_sink(
    counted: DataFrame,
    sink: str,
    checkpoint: str,
    query_name: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """K1 + W2 + W7 + W8: append finished groups to Parquet, exactly once.

    The file sink commits each batch to ``<sink>/_spark_metadata``; readers
    of the directory see only committed files. Restarting on the same
    checkpoint resumes after the last committed batch.
    """
    return (
        counted.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .queryName(query_name)
        .trigger(**(trigger or trigger_args()))
        .start()
    )


def _write_update_batch(sink: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # One directory per batch id, replaced as a whole: a batch that is
        # re-run after a failure overwrites its own output, never duplicates.
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return write


def start_update_sink(
    counted: DataFrame,
    sink: str,
    checkpoint: str,
    query_name: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Update mode. The Parquet file sink rejects it, so each micro-batch
    goes through ``foreachBatch`` into ``<sink>/batch_id=<n>``."""
    return (
        counted.writeStream.outputMode("update")
        .foreachBatch(_write_update_batch(sink))
        .option("checkpointLocation", checkpoint)
        .queryName(query_name)
        .trigger(**(trigger or trigger_args()))
        .start()
    )


def await_query(query: StreamingQuery, timeout_s: float | None) -> list[dict]:
    """Wait (with a bound when given), stop, surface failures; return
    the progress."""
    try:
        if timeout_s is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout_s):
            raise TimeoutError(f"streaming query {query.name} still running after {timeout_s}s")
        err = query.exception()
        if err is not None:
            raise RuntimeError(f"streaming query {query.name} failed: {err}")
        return [p if isinstance(p, dict) else p.asDict() if hasattr(p, "asDict") else dict(p)
                for p in query.recentProgress]
    finally:
        if query.isActive:
            query.stop()


def run_count(
    spark: SparkSession,
    records: DataFrame,
    sink: str,
    checkpoint: str,
    settings: StreamSettings,
    output_mode: str = "append",
    trigger: dict | None = None,
    start: Callable | None = None,
    plan: Callable | None = None,
) -> list[dict]:
    """Run the flow once to completion (``availableNow`` by default). ``start`` starts it on
    another sink than the Parquet one (append) or the folder per batch (update);
    ``plan`` makes its rows from the records and the delay (the count, if not given)."""
    counted = (plan or count_per_key)(records, settings.delay)
    start = start or (start_update_sink if output_mode == "update" else start_parquet_sink)
    with progress_kept(spark, settings.progress_retention):
        with session_conf(spark, settings.conf(spark)):
            query = start(counted, sink, checkpoint, settings.query_name, trigger)
        return await_query(query, settings.timeout_s)
