"""What the running query reports about itself, as a table.

Progress events are metadata (one small record per micro-batch), kept by the
driver anyway; turning them into a DataFrame lets the audit join or print
them like any other result.
"""

from __future__ import annotations

import calendar
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS_SCHEMA = (
    "batch_id bigint, input_rows bigint, watermark_ms bigint, state_rows bigint, "
    "state_rows_updated bigint, dropped_by_watermark bigint, duration_ms bigint"
)


def iso_to_millis(text: str | None) -> int | None:
    """``2024-01-30T23:56:52.194Z`` -> epoch milliseconds (exact)."""
    if not text:
        return None
    dt = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return calendar.timegm(dt.utctimetuple()) * 1000 + dt.microsecond // 1000


def watermark_ms(progress: dict) -> int | None:
    return iso_to_millis((progress.get("eventTime") or {}).get("watermark"))


def final_watermark_ms(progress: list[dict]) -> int | None:
    """The eviction watermark the run ended with (it never moves back)."""
    marks = [m for m in (watermark_ms(p) for p in progress) if m is not None]
    return max(marks) if marks else None


def progress_rows(progress: list[dict]) -> list[tuple]:
    rows = []
    for p in progress:
        ops = p.get("stateOperators") or [{}]
        op = ops[0] if ops else {}
        rows.append(
            (
                int(p.get("batchId", -1)),
                int(p.get("numInputRows", 0) or 0),
                watermark_ms(p),
                int(op.get("numRowsTotal", 0) or 0),
                int(op.get("numRowsUpdated", 0) or 0),
                int(op.get("numRowsDroppedByWatermark", 0) or 0),
                int((p.get("durationMs") or {}).get("triggerExecution", 0) or 0),
            )
        )
    return rows


def progress_table(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """One row per micro-batch: input rows, watermark, state size, drops.

    Raises if a batch between the first and the last is not among the events: the
    run then kept too few of them (``StreamSettings.progress_retention``).

    ``dropped_by_watermark`` counts rows after partial aggregation, so use it
    for monitoring, not as an exact count of late records.
    """
    rows = progress_rows(progress)
    ids = {r[0] for r in rows}
    if ids and ids != set(range(max(ids) + 1)):
        raise ValueError(f"progress of {max(ids) + 1 - len(ids)} micro-batches was not kept")
    df = spark.createDataFrame(rows, PROGRESS_SCHEMA)
    return df.select(
        "batch_id",
        "input_rows",
        F.timestamp_millis("watermark_ms").cast("timestamp_ntz").alias("watermark"),
        "state_rows",
        "state_rows_updated",
        "dropped_by_watermark",
        "duration_ms",
    )
