"""K2: batch Parquet writes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def overwrite_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` to ``path``, replacing what was there. Tasks write in
    parallel; a failed task is retried and the job commit is atomic."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
