"""W3 with commits: update-mode batches, and the latest value of each group.

A micro-batch writes the groups it changed into ``batch_id=<n>`` and then a commit record
``commits/<n>``. Readers take committed batches only, so one who reads while a batch is written
sees the state before it; a batch that is committed is never written again, so a re-run
changes nothing. The latest value of a group is that of its last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.envelope import GROUP_KEY, SINK_SCHEMA
from tidemark.sinks.folders import Folder
from tidemark.streaming.flow import trigger_args

CHANGES_SCHEMA = T.StructType([*SINK_SCHEMA.fields, T.StructField("batch_id", T.LongType(), True)])


class UpdateSink:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.files = Folder(spark, path)
        self.path = self.files.path

    def committed(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("commits") if n.isdigit())

    def write(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.committed():
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        self.files.put_new(f"commits/{batch_id}", "")

    def changes(self) -> DataFrame:
        """Every change of the committed batches, with ``batch_id``."""
        paths = [f"{self.path}/batch_id={b}" for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], CHANGES_SCHEMA)
        reader = self.spark.read.schema(CHANGES_SCHEMA).option("basePath", self.path)
        return reader.parquet(*paths)

    def latest(self, keys: list[str] | None = None) -> DataFrame:
        """Each group once, with its last count and the batch that gave it: partial aggregates
        by key, one shuffle."""
        last = F.max(F.struct("batch_id", "cnt")).alias("last")
        rows = self.changes().groupBy(*(keys or GROUP_KEY)).agg(last)
        return rows.select(*(keys or GROUP_KEY), F.col("last.cnt").alias("cnt"), F.col("last.batch_id").alias("batch_id"))


def start_committed_updates(
    counted: DataFrame, sink: str, checkpoint: str, query_name: str, trigger: dict | None = None
) -> StreamingQuery:
    """Update mode into an :class:`UpdateSink`."""
    target = UpdateSink(counted.sparkSession, sink)

    def write(batch: DataFrame, batch_id: int) -> None:
        target.write(batch, batch_id)

    return (
        counted.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .queryName(query_name)
        .trigger(**(trigger or trigger_args()))
        .start()
    )
