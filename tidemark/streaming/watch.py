"""The audit of a query on its way that a poll every few seconds can afford.

The query reads a file topic into a sink by day; its checkpoint says which files it has read, and
in which order. A poll reads the files that are new since the poll before, whole, and of the older ones those
that hold records of a day that was still open; of the sink it reads the open days. The rest of the answer is in
the stored totals (:class:`SliceAudit`). A file's newest time is noted when it is first read, so files
of closed days are not opened again.

Read in this order: position, topic, sink. What commits meanwhile makes rows appear persisted, never
late; its records count as unread until the next poll.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.slices import Progress, SliceAudit
from tidemark.sinks.daily import DailySink
from tidemark.sources.topic import FileTopic
from tidemark.streaming.checkpoint import file_of, files_read, position

OPEN_FILES = "file string, newest timestamp, untimed boolean"


class Watch:
    """The audit of one query; its totals lie below ``totals``, which any session can go on with."""

    def __init__(self, spark: SparkSession, topic: FileTopic, sink: str, checkpoint: str, totals: str):
        self.spark = spark
        self.topic = topic
        self.sink = DailySink(spark, sink)
        self.checkpoint = checkpoint
        self.store = SliceAudit(spark, totals)

    def _open_files(self, poll: int) -> DataFrame:
        return self.spark.read.schema(OPEN_FILES).parquet(f"{self.store.files.path}/files-{poll}")

    def _note(self, new: list[str], last: Progress | None, open_from) -> None:
        """Which files hold records of days that the next poll finds open."""
        number = last.poll + 1 if last else 0
        found = self.spark.createDataFrame([], OPEN_FILES)
        if new:
            records = self.topic.read_files(new).select(file_of("_metadata.file_path").alias("file"), "timestamp")
            found = records.groupBy("file").agg(
                F.max("timestamp").alias("newest"), F.max(F.col("timestamp").isNull()).alias("untimed")
            )
        if last:
            found = found.unionByName(self._open_files(last.poll))
        found = found.where(F.col("untimed") | (F.to_date("newest") >= F.lit(open_from)))
        found.coalesce(1).write.mode("overwrite").parquet(f"{self.store.files.path}/files-{number}")

    def to_read(self, last: Progress | None, new: list[str], there: dict[str, str]) -> DataFrame:
        """The records of new files, and those of open days in the older ones."""
        sent = self.topic.read_files(new)
        if last is None:
            return sent
        old = [there[r["file"]] for r in self._open_files(last.poll).select("file").collect() if r["file"] in there]
        is_open = F.col("timestamp").isNull() | (F.col("timestamp") >= F.lit(last.open_from).cast("timestamp"))
        return sent.unionByName(self.topic.read_files(old).where(is_open))

    def poll(self) -> Row | None:
        """The summary row of the full audit at the query's position (``audit_now`` with its
        checkpoint), ``None`` before the first commit."""
        at = position(self.spark, self.checkpoint)
        if at is None:
            return None
        last = self.store.progress()
        upto = int(at.offset["logOffset"])
        read, there = files_read(self.spark, self.checkpoint, at), self.topic.files()
        seen = last.upto if last else -1
        new = [there[n] for n, batch in read.items() if batch > seen and n in there]
        sent = self.to_read(last, new, there)
        persisted = self.sink.read(since=str(last.open_from) if last else None)
        self._note(new, last, self.store.open_from(at.watermark_ms, last))
        row = self.store.poll(sent, persisted, upto, at.watermark_ms).first().asDict()
        unread = self.topic.read_files([f for n, f in there.items() if n not in read]).count()
        self._vacuum()
        row |= {"sent": row["sent"] + unread, "complete": row["complete"] and not unread}
        return Row(**row, missing_unread=unread)

    def _vacuum(self) -> None:
        """The poll before stays, for one that reads it now."""
        self.store.vacuum()
        kept = self.store.polls()
        for name in self.store.files.names():
            if name.startswith("files-") and int(name.removeprefix("files-")) < kept[0]:
                self.store.files.delete(name)
