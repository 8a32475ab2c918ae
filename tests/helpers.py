"""Hand-built replays for the semantic tests (small fixtures, tests only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.records import counter_records
from tidemark.streaming.flow import StreamSettings


# Event seconds are offsets from this instant (2023-11-14T22:13:20Z). A record
# at the epoch itself is always dropped: the first late watermark is the
# epoch and the drop is inclusive (see test_semantics).
BASE = 1_700_000_000


def fixture_records(
    spark: SparkSession, batches: list[list[tuple[int, int]]], base: int = BASE
) -> DataFrame:
    """(key, event second) pairs per arrival batch -> envelopes with ``batch``;
    partition = key % 2 as in FIXTURES.md."""
    rows = [(k, base + t, b) for b, batch in enumerate(batches) for k, t in batch]
    df = spark.createDataFrame(rows, "k long, t long, batch int").select(
        "k", F.timestamp_seconds("t").alias("ts"), "batch"
    )
    return counter_records(df, "k", "ts", carry=["batch"])


def keys_out(spark: SparkSession, sink: str) -> list[int]:
    df = spark.read.parquet(sink)
    return sorted(r[0] for r in df.select(F.decode("key", "UTF-8").cast("int")).collect())


def small_settings(**kw) -> StreamSettings:
    return StreamSettings(state_partitions=2, timeout_s=300, **kw)
