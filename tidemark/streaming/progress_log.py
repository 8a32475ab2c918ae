"""Progress that outlives the driver.

``recentProgress`` dies with its query. Here a listener writes each event, as the engine reports it,
to a small file under a shared folder; any session can read them as a table, also of a
run that was interrupted and taken up elsewhere. The batches of one checkpoint count on across
runs, so the log of a checkpoint has one row a batch. A driver that is lost between a batch's commit
and its event leaves that batch without one: the checkpoint's own logs then give its row
(``reported`` false, counters null).
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.sinks.folders import Folder
from tidemark.streaming.checkpoint import committed_watermarks, position

EVENT_SCHEMA = (
    "batchId bigint, timestamp string, numInputRows bigint, eventTime struct<watermark: string>, "
    "stateOperators array<struct<numRowsTotal: bigint, numRowsUpdated: bigint, numRowsDroppedByWatermark: bigint>>, "
    "durationMs struct<triggerExecution: bigint>"
)
EVENTS, FOLDED = "events", "folded"


class ProgressLog:
    """Progress events of one checkpoint below ``path``: ``events/<batch>-<run>``, and
    ``folded/<id>`` for those put together by :meth:`compact`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.files = Folder(spark, path)
        self.path = self.files.path

    def put(self, event: str) -> None:
        """Keep one event (its JSON); the same batch of the same run is kept once."""
        told = json.loads(event)
        self.files.put_new(f"{EVENTS}/{int(told['batchId'])}-{told['runId']}", json.dumps(told))

    def batches(self) -> set[int]:
        """The batches whose events still have a file of their own."""
        return {int(n.split("-", 1)[0]) for n in self.files.names(EVENTS)}

    def compact(self) -> int:
        """Put the single events into one Parquet folder; returns how many. An event that is there
        twice in between counts once. One reader or writer at a time."""
        names = self.files.names(EVENTS)
        if names:
            singles = self.spark.read.text([f"{self.path}/{EVENTS}/{n}" for n in names])
            singles.coalesce(1).write.parquet(f"{self.path}/{FOLDED}/{uuid.uuid4().hex}")
            for n in names:
                self.files.delete(f"{EVENTS}/{n}")
        return len(names)

    def _events(self) -> DataFrame:
        found = self.spark.createDataFrame([], "value string")
        if self.files.names(EVENTS):
            found = found.unionByName(self.spark.read.text(f"{self.path}/{EVENTS}"))
        folded = [f"{self.path}/{FOLDED}/{n}" for n in self.files.names(FOLDED)]
        if folded:
            found = found.unionByName(self.spark.read.schema("value string").parquet(*folded))
        return found

    def table(self, checkpoint: str | None = None) -> DataFrame:
        """One row a batch (see ``progress_table``), the last event of each, with ``reported``. With the
        ``checkpoint``, the batches committed without an event as well, as far back as
        Spark keeps its logs."""
        event = F.from_json("value", EVENT_SCHEMA)
        last = self._events().select(event.alias("e")).groupBy("e.batchId").agg(F.max_by("e", "e.timestamp").alias("e"))
        state = F.get("e.stateOperators", F.lit(0))
        count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        rows = last.select(
            F.col("batchId").alias("batch_id"),
            count(F.col("e.numInputRows")).alias("input_rows"),
            F.to_timestamp("e.eventTime.watermark").cast("timestamp_ntz").alias("watermark"),
            count(state["numRowsTotal"]).alias("state_rows"),
            count(state["numRowsUpdated"]).alias("state_rows_updated"),
            count(state["numRowsDroppedByWatermark"]).alias("dropped_by_watermark"),
            count(F.col("e.durationMs.triggerExecution")).alias("duration_ms"),
            F.lit(True).alias("reported"),
        )
        if checkpoint is None:
            return rows
        marks = self.spark.createDataFrame(committed_watermarks(self.spark, checkpoint), "batch_id bigint, ms bigint")
        silent = marks.join(rows, "batch_id", "left_anti").select(
            "batch_id",
            F.timestamp_millis("ms").cast("timestamp_ntz").alias("watermark"),
            F.lit(False).alias("reported"),
        )
        return rows.unionByName(silent, allowMissingColumns=True)


class _Keeper(StreamingQueryListener):
    def __init__(self, log: ProgressLog, query_name: str):
        self.log, self.query_name = log, query_name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.query_name:
            self.log.put(event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextlib.contextmanager
def logged(log: ProgressLog, query_name: str, checkpoint: str, wait_s: float = 30.0):
    """Keep the progress of the session's query of that name while the block runs. Events come after their
    batch, so the end waits for that of the last committed one, at most ``wait_s`` seconds."""
    keeper = _Keeper(log, query_name)
    log.spark.streams.addListener(keeper)
    try:
        yield log
        at, until = position(log.spark, checkpoint), time.monotonic() + wait_s
        while at and at.batch not in log.batches() and time.monotonic() < until:
            time.sleep(0.05)
    finally:
        log.spark.streams.removeListener(keeper)
