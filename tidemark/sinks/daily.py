"""K1 for a sink that lives long: finished groups by day, with compaction and retention.

Each micro-batch writes its rows below ``data/batch-<id>/day=<date>`` and then commits a new
manifest, the list of the folders that hold the sink. Readers take the newest manifest and
list the folders of the days they ask for, no others. Compaction writes a day's
rows into one new folder and swaps it in by a manifest; readers that hold the manifest before
still find their folders, until :meth:`DailySink.vacuum` deletes what no recent manifest names.

A batch that is re-run writes the same folder again and is listed once. Writers that commit at the
same time take different numbers: the later one starts again from the newer manifest.
Groups without a timestamp lie under the day ``none``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.envelope import SINK_SCHEMA
from tidemark.sinks.folders import Folder
from tidemark.streaming.flow import trigger_args

NO_DAY = "none"


@dataclass(frozen=True, order=True)
class Part:
    """A folder of the sink: the rows of one day that one batch or compaction wrote."""

    day: str
    folder: str

    @property
    def path(self) -> str:
        return f"data/{self.folder}/day={self.day}"


class DailySink:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.files = Folder(spark, path)
        self.path = self.files.path

    # -- manifests ---------------------------------------------------------
    def _versions(self) -> list[int]:
        return [int(n) for n in self.files.names("manifest") if n.isdigit()]

    def _parts(self, version: int) -> list[Part]:
        return [Part(**p) for p in json.loads(self.files.text(f"manifest/{version:012d}"))]

    def parts(self) -> list[Part]:
        """The folders of the newest manifest."""
        versions = self._versions()
        return self._parts(max(versions)) if versions else []

    def _commit(self, change: Callable[[list[Part]], list[Part]]) -> None:
        while True:
            version = max(self._versions(), default=0)
            parts = self._parts(version) if version else []
            told = json.dumps([vars(p) for p in sorted(change(parts))])
            if self.files.put_new(f"manifest/{version + 1:012d}", told):
                return

    def _written(self, rows: DataFrame, folder: str) -> list[Part]:
        day = F.coalesce(F.to_date("timestamp").cast("string"), F.lit(NO_DAY))
        rows.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(
            f"{self.path}/data/{folder}"
        )
        names = self.files.names(f"data/{folder}")
        return [Part(n.removeprefix("day="), folder) for n in names if n.startswith("day=")]

    # -- writers -----------------------------------------------------------
    def append(self, rows: DataFrame, batch_id: int) -> None:
        """One micro-batch; again with the same number, it replaces itself. A batch that
        was compacted since is there already."""
        folder = f"batch-{batch_id}"
        if self.files.names(f"done/{folder}"):
            return
        new = self._written(rows, folder)
        self._commit(lambda parts: [p for p in parts if p.folder != folder] + new)

    def compact(self, day: str, files: int = 1) -> bool:
        """The day in one folder of ``files`` files; False if it is, or another compaction
        or the retention was faster."""
        old = [p for p in self.parts() if p.day == day]
        if len(old) < 2:
            return False
        new = self._written(self._read(old).repartition(files), f"compact-{uuid.uuid4().hex[:12]}")
        swapped = []

        def swap(parts: list[Part]) -> list[Part]:
            swapped[:] = [set(old) <= set(parts)]
            return [p for p in parts if p not in old] + new if swapped[0] else parts

        for p in old:  # a re-run of these batches must not add them again
            if p.folder.startswith("batch-"):
                self.files.put_new(f"done/{p.folder}/{day}", "")
        self._commit(swap)
        return swapped[0]

    def expire(self, before: str) -> None:
        """Retention: days before that date are no part of the sink any more."""
        self._commit(lambda parts: [p for p in parts if p.day == NO_DAY or p.day >= before])

    def vacuum(self, keep: int = 2) -> None:
        """Deletes older manifests than the ``keep`` newest, and folders that none of those names."""
        versions = sorted(self._versions())
        named = {p.path for v in versions[-keep:] for p in self._parts(v)}
        gone = {p for v in versions[:-keep] for p in self._parts(v)} if versions[:-keep] else set()
        for part in sorted(gone):
            if part.path not in named:
                self.files.delete(part.path)
        for v in versions[:-keep]:
            self.files.delete(f"manifest/{v:012d}")

    # -- readers -----------------------------------------------------------
    def _read(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SINK_SCHEMA)
        return self.spark.read.schema(SINK_SCHEMA).parquet(*[f"{self.path}/{p.path}" for p in parts])

    def days(self) -> list[str]:
        return sorted({p.day for p in self.parts()})

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """The rows of the days from ``since`` up to ``until`` (both in), and of those without a day."""
        kept = [
            p
            for p in self.parts()
            if p.day == NO_DAY or ((since is None or p.day >= since) and (until is None or p.day <= until))
        ]
        return self._read(kept)


def start_daily_sink(
    counted: DataFrame, sink: str, checkpoint: str, query_name: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append mode into a :class:`DailySink`, one manifest for each micro-batch with rows."""
    target = DailySink(counted.sparkSession, sink)

    def write(batch: DataFrame, batch_id: int) -> None:
        target.append(batch, batch_id)

    return (
        counted.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .queryName(query_name)
        .trigger(**(trigger or trigger_args()))
        .start()
    )
