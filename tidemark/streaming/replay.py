"""Drive the flow from a replayed topic: one run, or one run per batch.

The replay publishes a table to a ``FileTopic``, each arrival batch a folder, all in one
write. The watermarked count then runs over it with ``availableNow``, once for each folder on one
checkpoint, so that every folder is one micro-batch. The watermark rules depend on the
no-data batches between:

* ``one_run``: none but after the last folder. Late watermark, eviction and output are those of
  one long run over the batches (the checkpoint carries both watermarks on);
* else one after each folder (as when the consumer is started anew for each): the next run
  starts with the late watermark one step further on.

A live deployment swaps the topic for ``read_kafka_stream`` and the trigger for a
processing-time one; the flow is unchanged.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import run_dir
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import StreamSettings, run_count
from tidemark.streaming.progress import final_watermark_ms
from tidemark.streaming.progress_log import ProgressLog, logged

# Arrival rule for replays with late records (ours, not the reference's):
# records arrive in B batches in id order, and every tenth record is held
# back by three batches.
LATE_EVERY = 10
LATE_BY = 3


def arrival_batch(id_col: str, n_rows: int, n_batches: int) -> Column:
    """``least(B-1, id*B div N + (3 if id % 10 = 0 else 0))``."""
    base = F.expr(f"`{id_col}` * {int(n_batches)} div {int(max(n_rows, 1))}")
    held = F.when(F.col(id_col) % LATE_EVERY == 0, F.lit(LATE_BY)).otherwise(F.lit(0))
    return F.least(F.lit(n_batches - 1).cast("bigint"), base + held).cast("int")


@dataclass
class StreamRun:
    """Where a finished run left its output and what it reported."""

    sink: str
    checkpoint: str
    topic: str  # where the records came from: a topic folder, or a table streamed as is
    progress: list[dict]

    @property
    def final_watermark_ms(self) -> int | None:
        return final_watermark_ms(self.progress)


def run_stream(
    spark: SparkSession, records: DataFrame, settings: StreamSettings, label: str, source: str
) -> StreamRun:
    """One run over a streaming DataFrame of records (a table read as a
    stream and encoded on the fly, say) into a fresh sink and checkpoint."""
    root = run_dir(spark, label)
    sink, ckpt = f"{root}/sink", f"{root}/checkpoint"
    progress = run_count(spark, records, sink, ckpt, settings)
    return StreamRun(sink, ckpt, source, progress)


def publish_all(spark: SparkSession, records: DataFrame, label: str = "single") -> FileTopic:
    """Publish every record to a fresh topic at once (parallel write)."""
    topic = FileTopic(spark, f"{run_dir(spark, label + '-topic')}/topic")
    topic.publish(records)
    return topic


def run_single_batch(
    spark: SparkSession, records: DataFrame, settings: StreamSettings, label: str = "single"
) -> StreamRun:
    """Publish everything, then one run: one data batch plus the no-data batch."""
    return run_topic(spark, publish_all(spark, records, label), None, settings, label)


@dataclass
class Arrivals:
    """A topic published in ``n_batches`` arrival batches."""

    topic: FileTopic
    n_batches: int


def publish_arrivals(
    spark: SparkSession,
    records: DataFrame,
    batch_col: str,
    n_batches: int,
    label: str = "arrivals",
    by_day: bool = False,
) -> Arrivals:
    """Publish ``n_batches`` arrival batches to a fresh topic in one write, without a shuffle."""
    topic = FileTopic(spark, f"{run_dir(spark, label + '-topic')}/topic")
    topic.publish_batches(records, batch_col, by_day)
    return Arrivals(topic, n_batches)


def publish_in_time_order(
    spark: SparkSession, records: DataFrame, n_batches: int, label: str = "backlog"
) -> Arrivals:
    """Publish a backlog as at most ``n_batches`` arrival batches in event-time order.

    The bounds are quantiles of the record time (one aggregation that returns
    ``n_batches - 1`` numbers); each batch is the records between two bounds. Times of a
    batch are above those of the batch before, so no record is ever late: a
    stream over these batches emits exactly what one batch over the whole backlog
    would, while its state holds about one batch instead of all. Records without a
    time are in the first batch.
    """
    parts = [i / n_batches for i in range(1, n_batches)]
    found = []
    if parts:
        micros = F.unix_micros("timestamp")
        told = records.agg(F.percentile_approx(micros, parts, 10_000).alias("q"), F.max(micros).alias("m")).first()
        found = [q for q in told["q"] or [] if q < told["m"]]
    bounds = sorted(set(found))
    batch = F.lit(0)
    for b in bounds:
        batch = batch + F.coalesce((F.unix_micros("timestamp") > F.lit(b)).cast("int"), F.lit(0))
    dealt = records.withColumn("time_order", batch)
    return publish_arrivals(spark, dealt, "time_order", len(bounds) + 1, label)


def run_topic(
    spark: SparkSession,
    topic,
    per_trigger: int | None,
    settings: StreamSettings,
    label: str = "arrivals",
    output_mode: str = "append",
) -> StreamRun:
    """One run over a published topic (a ``FileTopic`` or ``KafkaTopic``),
    ``per_trigger`` files or offsets per micro-batch, into a fresh sink and
    checkpoint. Several runs (consumers) can read the same topic."""
    root = run_dir(spark, label)
    sink, ckpt = f"{root}/sink", f"{root}/checkpoint"
    progress = run_count(
        spark, topic.read_stream(per_trigger=per_trigger), sink, ckpt, settings, output_mode
    )
    return StreamRun(sink, ckpt, topic.path, progress)


def run_arrivals(
    spark: SparkSession,
    records: DataFrame,
    batch_col: str,
    n_batches: int,
    settings: StreamSettings,
    label: str = "arrivals",
    output_mode: str = "append",
) -> StreamRun:
    """As one run over the arrival batches: one micro-batch per batch, back to back."""
    arr = publish_arrivals(spark, records, batch_col, n_batches, label)
    return run_per_batch(spark, arr, settings, label, output_mode=output_mode, one_run=True)


def run_per_arrival(
    spark: SparkSession,
    records: DataFrame,
    batch_col: str,
    n_batches: int,
    settings: StreamSettings,
    label: str = "resume",
) -> StreamRun:
    """A separate run after each arrival, all on one checkpoint."""
    arr = publish_arrivals(spark, records, batch_col, n_batches, label)
    return run_per_batch(spark, arr, settings, label)


def run_per_batch(
    spark: SparkSession,
    arr: Arrivals,
    settings: StreamSettings,
    label: str = "resume",
    first: int = 1,
    last: int | None = None,
    root: str | None = None,
    output_mode: str = "append",
    one_run: bool = False,
    start: Callable | None = None,
    after: Callable[[int, StreamRun], None] | None = None,
    plan: Callable | None = None,
    log: ProgressLog | None = None,
    start_at: int = 0,
) -> StreamRun:
    """W7 over a published topic: run ``b`` sees the first ``b`` batches, in
    place, and takes up the checkpoint of the run before (see the module for ``one_run``).

    With the ``root`` of an interrupted series (its sink and checkpoint) and ``first``, the
    series goes on where it ended. ``start`` and ``plan`` name another sink and
    other rows (see ``run_count``); ``after`` is called with the number of each batch (from 0) and
    the run so far; ``log`` keeps the progress of every batch. ``start_at``: the consumer came when that
    many batches had gone by, and starts behind them (S2).

    Every run loads the state anew, so it is kept as snapshots: what a run loads is the state that the
    run before left, not the changes of all runs before.
    """
    settings = replace(settings, snapshots=True)
    root = root or run_dir(spark, label)
    run = StreamRun(f"{root}/sink", f"{root}/checkpoint", arr.topic.path, [])
    between = replace(settings, no_data_batches=False) if one_run else settings
    keep = logged(log, settings.query_name, run.checkpoint) if log else contextlib.nullcontext()
    filled = [b + 1 for b in arr.topic.batches()]  # a batch without records is no micro-batch
    with keep:
        for b in [b for b in filled if max(first, start_at + 1) <= b <= (last or arr.n_batches)]:
            now = settings if b == filled[-1] else between
            records = arr.topic.read_stream(batches=b, start=start_at)
            run.progress += run_count(
                spark, records, run.sink, run.checkpoint, now, output_mode, start=start, plan=plan
            )
            if after:
                after(b - 1, run)
    return run
