"""Late records kept aside, in the micro-batch that drops them.

The count and the records that it is made of come out of one streaming query as one
frame: finished groups, and every record of the batch. ``foreachBatch`` keeps the groups and those records that
the batch's late watermark excludes, in a single write (``batch_id=<n>/kind=<group or late>``)
with a commit record, so that both appear together or not at all. The watermark is the one the engine
works with: it stands in the checkpoint's write-ahead log before the batch starts, and is the same when
the batch is run again.

Both halves are of one source, so a batch holds the same records for both; its scan runs
twice, once for the count, once for the records. Of these only the late ones are written. A record
without a time is never late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.envelope import ENVELOPE_SCHEMA, GROUP_KEY, WATERMARK_DELAY
from tidemark.operators.aggregate import group_count
from tidemark.operators.audit import watermark_at
from tidemark.operators.records import project_records
from tidemark.sinks.updates import UpdateSink
from tidemark.streaming.checkpoint import ALLOW_MULTIPLE, late_watermark_ms
from tidemark.streaming.flow import trigger_args

GROUP, LATE = "group", "late"

ROW_SCHEMA = T.StructType(
    [*ENVELOPE_SCHEMA.fields, T.StructField("cnt", T.LongType()),
     T.StructField("batch_id", T.LongType()), T.StructField("kind", T.StringType())]
)


def count_and_records(records: DataFrame, delay: str = WATERMARK_DELAY) -> DataFrame:
    """The watermarked count (``kind`` = group) and the records themselves (late, until the
    sink has judged them), under one watermark."""
    marked = records.withWatermark("timestamp", delay)
    counted = group_count(project_records(marked), GROUP_KEY).withColumn("kind", F.lit(GROUP))
    kept = marked.select(*ENVELOPE_SCHEMA.names, F.lit(LATE).alias("kind"))
    return counted.unionByName(kept, allowMissingColumns=True)


class AsideSink(UpdateSink):
    """Groups and late records of committed batches."""

    def __init__(self, spark, path: str, checkpoint: str):
        super().__init__(spark, path)
        self.spark, self.checkpoint = spark, checkpoint

    def write(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.committed():
            return
        # The stream's own copy of the session, with the settings that it started with.
        allow_multiple = batch.sparkSession.conf.get(ALLOW_MULTIPLE, "true") == "true"
        late_ms = late_watermark_ms(self.spark, self.checkpoint, batch_id, allow_multiple)
        wanted = (F.col("kind") == GROUP) | (F.col("timestamp") <= watermark_at(late_ms))
        out = batch.where(wanted).write.mode("overwrite").partitionBy("kind")
        out.parquet(f"{self.path}/batch_id={batch_id}")
        self.files.put_new(f"commits/{batch_id}", "")

    def changes(self) -> DataFrame:
        paths = [f"{self.path}/batch_id={b}" for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], ROW_SCHEMA)
        return self.spark.read.schema(ROW_SCHEMA).option("basePath", self.path).parquet(*paths)

    def groups(self) -> DataFrame:
        """The finished groups (what the Parquet sink would hold)."""
        return self.changes().where(F.col("kind") == GROUP).select("partition", "timestamp", "key", "cnt")

    def late(self) -> DataFrame:
        """The late records, whole, with the batch that dropped them."""
        return self.changes().where(F.col("kind") == LATE).select(*ENVELOPE_SCHEMA.names, "batch_id")


def start_aside(
    rows: DataFrame, sink: str, checkpoint: str, query_name: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append mode into an :class:`AsideSink`; ``rows`` are :func:`count_and_records`."""
    target = AsideSink(rows.sparkSession, sink, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        target.write(batch, batch_id)

    return (
        rows.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .queryName(query_name)
        .trigger(**(trigger or trigger_args()))
        .start()
    )
