"""A topic kept as envelope Parquet files: publish, consume, replay.

This is the stand-in for a broker. Publishing appends envelope files;
consuming reads them back in batch (S6) or as a stream (S1) with the same
schema as Spark's Kafka source. Arrival batches are folders, written in one job; a
stream that is run once for each folder sees them as its micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.envelope import ENVELOPE_COLUMNS, ENVELOPE_SCHEMA
from tidemark.sinks.folders import Folder
from tidemark.sources.tables import ANY_AGE
from tidemark.streaming.checkpoint import Position, file_name, file_of, files_read

# Each arrival batch has its own directory; readers glob over the topic's data files
# and batch directories only (never its marker files).
DATA_GLOB = "{*.parquet,batch=*}"


class FileTopic:
    """Envelope records under one directory (any Hadoop path)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.by_day = False

    # -- publish ---------------------------------------------------------
    def publish(self, records: DataFrame, files: int | None = None) -> None:
        """Append records in one job. ``files`` fixes the number of files;
        by default every upstream partition writes its own file in parallel."""
        out = records.select(*ENVELOPE_COLUMNS)
        if files:
            out = out.repartition(files)
        out.write.mode("append").parquet(self.path)

    def publish_batches(self, records: DataFrame, batch_col: str, by_day: bool = False) -> None:
        """Append records in one job, those of each arrival batch to a folder of its own
        (and in it, with ``by_day``, those of each day of their time)."""
        self.by_day = by_day
        folders = {"batch": F.col(batch_col)} | ({"day": F.to_date("timestamp")} if by_day else {})
        out = records.select(*ENVELOPE_COLUMNS, *[c.alias(n) for n, c in folders.items()])
        out.write.mode("append").partitionBy(*folders).parquet(self.path)

    def batches(self) -> list[int]:
        """The arrival batches that have records."""
        names = Folder(self.spark, self.path).names()
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def read_batches(self, by_day: bool = False) -> DataFrame:
        """Every record with its arrival ``batch`` (and ``day``), the partition columns."""
        return self.spark.read.schema(self._foldered(by_day)).parquet(self.path)

    @staticmethod
    def _foldered(by_day: bool) -> T.StructType:
        fields = [T.StructField("batch", T.IntegerType())] + [T.StructField("day", T.DateType())] * by_day
        return T.StructType([*ENVELOPE_SCHEMA.fields, *fields])

    def publish_clustered(self, records: DataFrame, files: int | None = None) -> None:
        """Append records in files by range of partition and offset, so that a reader of some
        offsets skips the other files by their statistics."""
        place = ["partition", "offset"]
        ranges = [files, *place] if files else place
        out = records.select(*ENVELOPE_COLUMNS).repartitionByRange(*ranges).sortWithinPartitions(*place)
        out.write.mode("append").parquet(self.path)

    # -- consume ---------------------------------------------------------
    def read(self) -> DataFrame:
        """Every record published so far (top-level files and batch
        directories alike)."""
        reader = self.spark.read.schema(ENVELOPE_SCHEMA).option("recursiveFileLookup", "true")
        return reader.parquet(f"{self.path}/{DATA_GLOB}")

    def read_offsets(self, bounds: dict[int, tuple[int | None, int | None]]) -> DataFrame:
        """S6 between offsets: of each partition named, the records from the first up to,
        but not with, the second; None is no bound. The filter reaches the scan."""
        wanted = F.lit(False)
        for part, (start, end) in bounds.items():
            one = F.col("partition") == int(part)
            if start is not None:
                one = one & (F.col("offset") >= int(start))
            if end is not None:
                one = one & (F.col("offset") < int(end))
            wanted = wanted | one
        return self.read().where(wanted)

    def files(self) -> dict[str, str]:
        """The paths of all data files by their name (see ``checkpoint.file_name``): what Spark's
        own listing of the topic holds on the driver anyway."""
        return {file_name(f): f for f in self.read().inputFiles()}

    def read_files(self, paths: Iterable[str]) -> DataFrame:
        """The records of some files (paths as :meth:`files` gives them), and of no other."""
        paths = [unquote(p) for p in paths]
        if not paths:
            return self.spark.createDataFrame([], ENVELOPE_SCHEMA)
        reader = self.spark.read.schema(ENVELOPE_SCHEMA).option("recursiveFileLookup", "true")
        return reader.parquet(*paths)

    def read_marked(self, checkpoint: str, at: Position) -> DataFrame:
        """Every record with ``is_read``: whether the query of that checkpoint had read it.
        A record's file tells, so the two sets of files are scanned side by side."""
        there, read = self.files(), files_read(self.spark, checkpoint, at)
        sides = [([f for n, f in there.items() if (n in read) == mark], mark) for mark in (True, False)]
        one, two = [self.read_files(files).withColumn("is_read", F.lit(mark)) for files, mark in sides]
        return one.unionByName(two)

    def read_stream(
        self, per_trigger: int | None = None, batches: int | None = None, start: int = 0
    ) -> DataFrame:
        """S1 stand-in: the topic as a stream. ``per_trigger``: files of one micro-batch.
        ``batches``: only the first arrival batches, for a consumer that
        runs before the others are there; ``start``: but those below it, for one that came to
        the topic when they had gone by (S2).

        Files are read whatever their age, so the source remembers all it has seen."""
        reader = self.spark.readStream.schema(ENVELOPE_SCHEMA).option("maxFileAge", ANY_AGE)
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(per_trigger))
        if batches is None:
            return reader.option("recursiveFileLookup", "true").parquet(f"{self.path}/{DATA_GLOB}")
        names = ",".join(str(b) for b in range(start, batches))
        reader = reader.schema(self._foldered(self.by_day)).option("basePath", self.path)
        return reader.parquet(f"{self.path}/batch={{{names}}}").select(*ENVELOPE_COLUMNS)
