"""Live operation: a long-running ingest and a periodic audit of its sink.

``start_ingest`` is the flagship as a service: the topic read as a stream,
the watermarked count, the Parquet sink, a processing-time trigger at half
the delay. ``poll`` is the completeness watch: every interval it reconciles
the topic with the sink (A5) and reports the one-row summary together with
the query's latest progress. Each round is one small Spark job; nothing but
the summary row reaches the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.envelope import TRIGGER_INTERVAL
from tidemark.operators import audit
from tidemark.sources.tables import read_sink
from tidemark.streaming.checkpoint import position
from tidemark.streaming.flow import (
    StreamSettings,
    count_per_key,
    session_conf,
    start_parquet_sink,
    trigger_args,
)
from tidemark.streaming.progress import watermark_ms


def start_ingest(
    spark: SparkSession,
    topic,
    sink: str,
    checkpoint: str,
    settings: StreamSettings | None = None,
    interval: str = TRIGGER_INTERVAL,
    start: Callable = start_parquet_sink,
) -> StreamingQuery:
    """Start the flagship on ``topic`` (a ``FileTopic`` or ``KafkaTopic``), into the plain sink
    or, with ``start_daily_sink``, the one by day; returns the running query. Stop
    it with ``query.stop()``."""
    settings = settings or StreamSettings()
    counted = count_per_key(topic.read_stream(), settings.delay)
    with session_conf(spark, settings.conf(spark)):
        return start(
            counted,
            sink,
            checkpoint,
            settings.query_name,
            trigger_args("processing", interval),
        )


def supervise(
    start,
    restarts: int = 3,
    backoff_s: float = 10.0,
    timeout_s: float | None = None,
    healthy_s: float = 600.0,
):
    """Keep a query running: ``start()`` returns a started query; when it or its
    start fails (repeated task failures, a broker out of reach), start it again
    on the same checkpoint, at most ``restarts`` times in a row, waiting ``backoff_s``
    between attempts. A query that ran for ``healthy_s`` seconds begins a new row, so
    that failures weeks apart do not add up. Executor loss alone never gets
    here: Spark retries the lost tasks inside the micro-batch. Returns the last
    query (stopped when ``timeout_s`` ran out)."""
    attempt = 0
    while True:
        q, began = None, time.monotonic()
        try:
            q = start()
            q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
            if q.isActive:
                q.stop()
            return q
        except Exception:
            if time.monotonic() - began >= healthy_s:
                attempt = 0
            if attempt >= restarts:
                raise
            attempt += 1
            if q is not None and q.isActive:
                q.stop()
            time.sleep(backoff_s)


def _progress_dict(p) -> dict:
    if p is None:
        return {}
    return p if isinstance(p, dict) else dict(p)


def audit_now(
    spark: SparkSession,
    topic,
    sink: str,
    query: StreamingQuery | None = None,
    delay: str | None = None,
    checkpoint: str | None = None,
    read: Callable[[SparkSession, str], DataFrame] | None = None,
):
    """One audit round: the summary row of topic vs sink (``None`` before the
    first commit).

    With the ``checkpoint`` of the query (running or not), records it has not read
    are ``missing_unread``. Without it, all of the topic counts as read: right
    for a query that has caught up; the cut-off is then the query's watermark, or the
    one that the data implies.

    ``read`` reads a sink of another kind than the plain one.

    Read in this order: watermark and position, then the topic, then the sink. What
    commits meanwhile makes rows appear persisted, never late.
    """
    at = position(spark, checkpoint) if checkpoint else None
    if checkpoint and at is None:
        return None
    mark = watermark_ms(_progress_dict(query.lastProgress)) if query is not None else None
    try:
        sent = topic.read_marked(checkpoint, at) if at else topic.read()
        persisted = (read or read_sink)(spark, sink)  # both resolved now: fails before the first commit
    except AnalysisException:
        return None
    if at:
        reconciled = audit.reconcile_progress(sent, persisted)
        return audit.summary_progress(reconciled, audit.watermark_at(at.watermark_ms)).first()
    wm = (
        audit.watermark_at(mark)
        if mark is not None
        else audit.expected_watermark(sent, delay or StreamSettings().delay)
    )
    return audit.summary(audit.reconcile(sent, persisted), wm).first()


def poll(
    spark: SparkSession,
    query: StreamingQuery,
    topic,
    sink: str,
    interval_s: float = 10.0,
    rounds: int | None = None,
    checkpoint: str | None = None,
    ask: Callable[[], object] | None = None,
) -> Iterator[tuple[dict, object]]:
    """Every ``interval_s`` seconds while the query runs: (latest progress,
    audit summary row). ``ask`` gives the row in another way than the full audit
    (``Watch.poll``). Failures of one round are reported, not fatal."""
    n = 0
    while query.isActive and (rounds is None or n < rounds):
        try:
            row = ask() if ask else audit_now(spark, topic, sink, query, checkpoint=checkpoint)
            yield _progress_dict(query.lastProgress), row
        except Exception as e:  # keep watching, as a monitor should
            yield {"error": str(e)}, None
        n += 1
        if rounds is None or n < rounds:
            time.sleep(interval_s)
