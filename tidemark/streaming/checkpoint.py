"""What a streaming query has done so far, read from its checkpoint.

A checkpoint says how far a query has come even when no query runs: the last
committed batch, the watermark that batch worked with, and the source's position.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sinks.folders import Folder

ALLOW_MULTIPLE = "spark.sql.streaming.statefulOperator.allowMultiple"


@dataclass(frozen=True)
class Position:
    """The last committed batch, its watermark and the source's offset after it."""

    batch: int
    watermark_ms: int
    offset: dict


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return [int(n) for n in names if n.isdigit()]


def position(spark: SparkSession, checkpoint: str) -> Position | None:
    """``None`` before the first commit. Spark keeps the last 100 batches' logs, so
    the listing is short."""
    done = _numbers(spark, f"{checkpoint}/commits")
    if not done:
        return None
    batch = max(done)
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{batch}").collect()]
    # A version line, the batch's metadata, then one offset per source.
    return Position(batch, int(json.loads(lines[1])["batchWatermarkMs"]), json.loads(lines[2]))


def _metadata(spark: SparkSession, checkpoint: str, batch: int) -> dict:
    """What the write-ahead log says of a batch: its watermark and the settings it runs with."""
    return json.loads(Folder(spark, checkpoint).text(f"offsets/{batch}").split("\n")[1])


def late_watermark_ms(spark: SparkSession, checkpoint: str, batch: int, allow_multiple: bool = True) -> int:
    """The watermark (ms) at and below which a batch drops records; known before it starts. That of
    the batch before, or with ``allow_multiple`` off the batch's own (W5)."""
    told_by = max(batch - 1, 0) if allow_multiple else batch
    return int(_metadata(spark, checkpoint, told_by)["batchWatermarkMs"])


def committed_watermarks(spark: SparkSession, checkpoint: str) -> list[tuple[int, int]]:
    """Each committed batch that the logs still hold, with its watermark (ms)."""
    done = set(_numbers(spark, f"{checkpoint}/commits")) & set(_numbers(spark, f"{checkpoint}/offsets"))
    return [(b, int(_metadata(spark, checkpoint, b)["batchWatermarkMs"])) for b in sorted(done)]


_NAME = "(([^/]+/){0,2}[^/]+)$"


def file_of(path: str) -> Column:
    """A file's name with the two folders that it lies in: one job gives files in several
    folders the same name."""
    return F.regexp_extract(path, _NAME, 1)


def file_name(path: str) -> str:
    """:func:`file_of` on the driver."""
    return re.search(_NAME, path).group(1)


def files_read(spark: SparkSession, checkpoint: str, at: Position) -> dict[str, int]:
    """Name (see :func:`file_of`) of every file that a file source had read by then, with the
    number under which its log holds it. The source keeps as much on the driver."""
    log = spark.read.text(f"{checkpoint}/sources/0").where("value LIKE '{%'")
    entry = F.from_json("value", "path string, batchId bigint")
    read = (
        log.select(entry.alias("e"))
        .where(F.col("e.batchId") <= int(at.offset["logOffset"]))
        .select(file_of("e.path").alias("file"), "e.batchId")
        .distinct()
    )
    return {r["file"]: r["batchId"] for r in read.collect()}


def offsets_read(at: Position, topic: str) -> Column:
    """Whether a Kafka record lies before the position."""
    read = F.lit(False)
    for part, offset in at.offset.get(topic, {}).items():
        read = read | ((F.col("partition") == int(part)) & (F.col("offset") < int(offset)))
    return read


def withheld_groups(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``partition, timestamp, key, cnt`` of the groups that a count's state still holds after its
    last committed batch: Spark's reader of the state store, one task for each state
    partition; no query needs to run."""
    state = spark.read.format("statestore").load(checkpoint)
    # The grouping columns in their order; the time carries the watermark's name.
    partition, timestamp, key = [F.col("key")[f.name] for f in state.schema["key"].dataType.fields]
    count = F.col("value")[state.schema["value"].dataType.fields[-1].name]
    return state.select(
        partition.alias("partition"), timestamp.alias("timestamp"), key.alias("key"), count.alias("cnt")
    )
