"""The flagship over a backlog in time order: its registered name, and its run in bounded
micro-batches. The other plans know no backlog: they run one way at every size."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.plans.scenarios import default_settings, events_records
from tidemark.streaming.replay import StreamRun, publish_in_time_order, run_per_batch

NAME = "stream_backlog"
BATCHES = 4


def time_ordered_run(spark: SparkSession, sf_dir: str) -> StreamRun:
    """The events as a backlog in time order: the flagship in bounded micro-batches."""
    arr = publish_in_time_order(spark, events_records(spark, sf_dir), BATCHES)
    return run_per_batch(spark, arr, default_settings(spark), "backlog", one_run=True)
