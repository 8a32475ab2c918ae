"""Aggregations: A1 grouped count (batch twin of the streaming count),
A2 latest timestamp, A4 mean.

Catalyst plans each as partial aggregation before the exchange and a final
merge after it, so a hot key is combined on the map side and never crosses
the shuffle as more than one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.envelope import GROUP_KEY


def group_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1: ``count(*)`` per group, named ``cnt``."""
    return df.groupBy(*(keys or GROUP_KEY)).agg(F.count(F.lit(1)).alias("cnt"))


def latest(df: DataFrame, col: str = "timestamp", name: str = "latest") -> DataFrame:
    """A2: one row holding ``max(col)``; null on empty input."""
    return df.agg(F.max(col).alias(name))


def mean_of(df: DataFrame, col: str = "id", name: str = "mean_id") -> DataFrame:
    """A4: one row holding the mean of ``col``."""
    return df.agg(F.avg(col).alias(name))
