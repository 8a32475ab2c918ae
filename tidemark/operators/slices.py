"""An audit that reads only what is new, for a poll every few seconds.

The day of a record is its slice. A day that ended before the watermark is closed: all its
groups are in the sink, and a record of it that arrives later is dropped as late. So the totals of
a closed day are stored once, and a poll reads, of the topic, the arrivals since the last poll
and the open days of those before; of the sink, the open days. The stored totals and what it
found add up to the answer of the full audit (``audit.summary``).

A poll's totals are one folder of the store, written as a whole and holding those of the closed
days of all polls before, a row a day: a poll reads the folder of the one before it, no other. A poll
that failed is run again under the same number. Records without a timestamp have no day and stay open.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.envelope import GROUP_KEY, as_wall_clock, key_to_id
from tidemark.operators import audit
from tidemark.sinks.folders import Folder

SUMS = ("sent", "sink_rows", "persisted", "malformed", "late", "withheld")
SCHEMA = "day date, " + ", ".join(f"{c} long" for c in SUMS) + ", latest timestamp, closed boolean, upto long, open_from date"


def day_of(watermark_ms: int) -> dt.date:
    """The first day that is open under a watermark."""
    return (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=watermark_ms)).date()


def slice_totals(sent: DataFrame, persisted: DataFrame, watermark_ms: int) -> DataFrame:
    """``day`` and the audit's sums of its groups."""
    gap = F.greatest(F.col("sent") - F.col("persisted"), F.lit(0).cast("bigint"))
    is_late = F.coalesce(F.col("timestamp") <= audit.watermark_at(watermark_ms), F.lit(False))
    zero = F.lit(0).cast("bigint")
    groups = audit.reconcile(sent, persisted).select(
        F.to_date("timestamp").alias("day"),
        "sent",
        "sink_rows",
        "persisted",
        F.when((F.col("sink_rows") > 0) & key_to_id("key").isNull(), F.col("sink_rows")).otherwise(zero).alias("malformed"),
        F.when(is_late, gap).otherwise(zero).alias("late"),
        F.when(is_late, zero).otherwise(gap).alias("withheld"),
        F.when(F.col("sink_rows") > 0, F.col("timestamp")).alias("latest"),
    )
    return groups.groupBy("day").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("latest").alias("latest"))


@dataclass(frozen=True)
class Progress:
    """The last poll: its number, the arrivals it has read, the first day it left open."""

    poll: int
    upto: int
    open_from: dt.date | None


class SliceAudit:
    """The stored totals below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.files = Folder(spark, path)

    def polls(self) -> list[int]:
        # A folder without its success mark belongs to a poll that failed.
        found = [int(n.removeprefix("poll-")) for n in self.files.names() if n.startswith("poll-")]
        return sorted(n for n in found if "_SUCCESS" in self.files.names(f"poll-{n}"))

    def _read(self, polls: list[int]) -> DataFrame:
        reader = self.spark.read.schema(SCHEMA)
        return reader.parquet(*[f"{self.files.path}/poll-{n}" for n in polls])

    def progress(self) -> Progress | None:
        polls = self.polls()
        if not polls:
            return None
        row = self._read(polls[-1:]).agg(F.max("upto").alias("u"), F.max("open_from").alias("d")).first()
        return Progress(polls[-1], row["u"], row["d"])

    @staticmethod
    def open_from(watermark_ms: int, last: Progress | None) -> dt.date:
        """The first day that a poll under a watermark leaves open."""
        first_open = day_of(watermark_ms)
        if last and last.open_from and last.open_from > first_open:
            return last.open_from  # a watermark never moves back
        return first_open

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the folders of all polls but the ``keep`` last."""
        for n in self.polls()[:-keep]:
            self.files.delete(f"poll-{n}")

    def to_read(self, topic: DataFrame, arrival: str, day: str, upto: int) -> DataFrame:
        """The arrivals since the last poll, and the open days of those before: filters on
        the topic's partition columns."""
        last = self.progress()
        if last is None:
            return topic.where(F.col(arrival) <= upto)
        is_open = F.col(day).isNull() | (F.col(day) >= F.lit(last.open_from))
        before = topic.where((F.col(arrival) <= last.upto) & is_open)
        return before.unionByName(topic.where((F.col(arrival) > last.upto) & (F.col(arrival) <= upto)))

    def poll(self, sent: DataFrame, persisted: DataFrame, upto: int, watermark_ms: int) -> DataFrame:
        """One row, as of the full audit. ``sent``: from :meth:`to_read`; ``persisted``: the
        sink's open days (from ``progress().open_from`` on); ``upto``: the last arrival read; the
        watermark is that of the last committed batch."""
        last = self.progress()
        n = last.poll + 1 if last else 0
        first_open = self.open_from(watermark_ms, last)
        found = slice_totals(sent.select(*GROUP_KEY), persisted, watermark_ms)
        head = self.spark.range(1).select(
            F.lit(None).cast("date").alias("day"),
            *[F.lit(0).cast("long").alias(c) for c in SUMS],
            F.lit(None).cast("timestamp").alias("latest"),
        )
        rows = found.unionByName(head).withColumn(
            "closed", F.coalesce(F.col("day") < F.lit(first_open), F.lit(False))
        )
        if last:
            held = self._read([last.poll]).where("closed")
            rows = rows.unionByName(held.select(*rows.columns))
        sums = [F.sum(c).alias(c) for c in SUMS]
        rows.groupBy("day", "closed").agg(*sums, F.max("latest").alias("latest")).select(
            "day",
            *SUMS,
            "latest",
            "closed",
            F.lit(upto).cast("long").alias("upto"),
            F.lit(first_open).alias("open_from"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.files.path}/poll-{n}")
        return self._read([n]).agg(
            F.sum("sent").alias("sent"),
            F.sum("sink_rows").alias("persisted_rows"),
            F.sum("persisted").alias("persisted"),
            as_wall_clock(F.max("latest")).alias("latest_persisted"),
            F.sum("late").alias("missing_late"),
            F.sum("withheld").alias("missing_withheld"),
            F.sum("malformed").alias("malformed_keys"),
            (F.sum(F.col("late") + F.col("withheld")) == 0).alias("complete"),
        )
