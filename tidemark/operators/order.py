"""O1 (ordered ids) and O2 (first rows by a key, as ``show`` displays them)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sorted_by(df: DataFrame, col: str = "id", tiebreak: list[str] | None = None) -> DataFrame:
    """O1: a total order on ``col`` (numeric, not text order).

    Spark range-partitions by the sort key and sorts each range. Equal
    values cannot be split across ranges, so a value held by a large share
    of rows (null ids of undecodable keys, say) would land in one task;
    ``tiebreak`` columns that are unique per row let the range bounds fall
    inside such a run. The result is still ordered by ``col``.
    """
    return df.orderBy(col, *(tiebreak or []))


def first_rows(df: DataFrame, col: str = "id", n: int = 20) -> DataFrame:
    """O2: the first ``n`` rows by ``col``; planned as a top-k
    (TakeOrderedAndProject), each task keeps only ``n`` rows."""
    return df.orderBy(col).limit(n)
