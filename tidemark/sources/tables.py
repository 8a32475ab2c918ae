"""Batch sources: the driver's Parquet tables, S4 (range) and S5 (Parquet scan)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions.envelope import SINK_SCHEMA


# The file source skips files that are older than the newest one by more than
# this (7 days unless told otherwise). A record's age is the watermark's business.
ANY_AGE = "36500d"


def file_status(spark: SparkSession, path: str):
    """Hadoop's status of one path: no listing of what is below it."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(where)


def table_version(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """What changes when a table is rewritten: number, size, newest time and a digest of
    path, time and size of its files, those in folders of folders as well."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    found = where.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(where, True)
    n, size, newest, digest = 0, 0, 0, 0
    while found.hasNext():
        f = found.next()
        told = (f.getPath().toString(), f.getModificationTime(), f.getLen())
        n, size, newest = n + 1, size + told[2], max(newest, told[1])
        # A sum, as a listing has no order.
        digest = (digest + int.from_bytes(hashlib.sha256(repr(told).encode()).digest())) % 2**256
    return n, size, newest, digest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, e.g. ``events`` or ``lineitem``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table read as a stream: its files form the first micro-batch,
    with the table's own schema. A table stored as a folder of part files is
    streamed as that folder; a single ``<name>.parquet`` file (the stream
    source wants a folder) through its parent, filtered to that file name."""
    batch = table(spark, sf_dir, name)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(batch.schema).option("maxFileAge", ANY_AGE)
    if file_status(spark, path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir.rstrip("/"))
    return reader.parquet(path)


def id_range(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """``id`` 0..n-1 as bigint, generated in parallel on the executors."""
    if partitions:
        return spark.range(0, n, 1, partitions)
    return spark.range(n)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet directory or file.

    A directory written by the streaming file sink is read through its
    ``_spark_metadata`` log, so files of uncommitted batches stay invisible.
    Column pruning and filter pushdown reach the scan through Catalyst.
    """
    return spark.read.parquet(path)


def read_sink(spark: SparkSession, path: str, batch_partitioned: bool = False) -> DataFrame:
    """S5 on a sink of the flow: its schema is known, so no job is spent
    inferring it from file footers. ``batch_partitioned`` for the update-mode
    sink, whose rows sit under ``batch_id=<n>`` directories."""
    schema = SINK_SCHEMA
    if batch_partitioned:
        schema = T.StructType([*SINK_SCHEMA.fields, T.StructField("batch_id", T.IntegerType(), True)])
    return spark.read.schema(schema).parquet(path)
