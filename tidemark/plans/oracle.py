"""Plain-SQL statements of what each registered query must return.

Written for a single-node SQL engine over the same Parquet tables (views
``events``, ``orders``, ``lineitem``, ...). The streaming ones spell out the
watermark rules of ``tidemark.streaming.flow`` in SQL: late watermark of
batch b = max event time (ms) of batches <= b-2 minus the delay, final
watermark = max event time (ms) minus the delay.
"""

from __future__ import annotations

from tidemark.plans import bounded

# Six arrival batches, whatever the number of events.
_NB = "nb AS (SELECT CAST(6 AS BIGINT) AS b, count(*) AS n FROM events)"
NO_DATA_OFF_FILTER = "WHERE batch < 5"


def _arrivals(late_lag: int, final_filter: str = "", among: str = "") -> str:
    """CTEs ``nb`` (batch count, rows), ``a`` (records with batch), ``l``
    (late watermark per batch), ``f`` (final eviction watermark); of some batches only with ``among``."""
    return f"""
{_NB},
a0 AS (
  SELECT event_id, ts,
         CAST(least((SELECT b FROM nb) - 1, event_id * (SELECT b FROM nb) // (SELECT n FROM nb)
                    + CASE WHEN event_id % 10 = 0 THEN 3 ELSE 0 END) AS INTEGER) AS batch
  FROM events),
a AS (SELECT * FROM a0 {among}),
m AS (SELECT batch, max(ts) AS mx FROM a GROUP BY batch),
l AS (SELECT b.batch,
             (SELECT date_trunc('millisecond', max(mx)) - INTERVAL 20 SECOND
              FROM m WHERE m.batch <= b.batch - {late_lag}) AS late
      FROM m b),
f AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 20 SECOND AS wm FROM a {final_filter})"""


def _persisted(late_lag: int, final_filter: str = "", among: str = "") -> str:
    return f"""
WITH {_arrivals(late_lag, final_filter, among)}
SELECT CAST(a.event_id % 2 AS INTEGER) AS "partition", a.ts AS "timestamp",
       a.event_id AS "key", count(*) AS cnt
FROM a JOIN l USING (batch)
WHERE (l.late IS NULL OR a.ts > l.late) AND a.ts <= (SELECT wm FROM f)
GROUP BY ALL"""


def _single(delay: str) -> str:
    return f"""
SELECT CAST(event_id % 2 AS INTEGER) AS "partition", ts AS "timestamp",
       event_id AS "key", count(*) AS cnt
FROM events
WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL {delay}
GROUP BY ALL"""


_FLAGSHIP_IDS = f"""
SELECT event_id AS id FROM events
WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 20 SECOND"""

_ISO = "strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ')"

ORACLE_SQL: dict[str, str] = {
    "stream_append_single": _single("20 SECOND"),
    "stream_append_day": _single("1 DAY"),
    "stream_append_constant": """
SELECT CAST(l_linenumber % 2 AS INTEGER) AS "partition", l_shipdate AS "timestamp",
       'key' AS "key", count(*) AS cnt
FROM lineitem
WHERE l_shipdate <= (SELECT date_trunc('millisecond', max(l_shipdate)) FROM lineitem)
                    - INTERVAL 20 SECOND
GROUP BY ALL""",
    "stream_append_multibatch": _persisted(2),
    "stream_append_strict_late": _persisted(1),
    "stream_nodata_off": _persisted(2, NO_DATA_OFF_FILTER),
    "stream_resume": _persisted(1),
    "stream_from_latest": _persisted(2, among="WHERE batch >= 3"),
    "stream_processing_time": _single("20 SECOND"),
    "stream_late_rows": f"""
WITH {_arrivals(2)}
SELECT a.event_id AS id, a.ts AS "timestamp", CAST(a.event_id % 2 AS INTEGER) AS "partition"
FROM a JOIN l USING (batch) WHERE a.ts <= l.late""",
    "stream_update_foreachbatch": f"""
WITH {_arrivals(2)}
SELECT a.batch AS batch_id, CAST(a.event_id % 2 AS INTEGER) AS "partition",
       a.ts AS "timestamp", a.event_id AS "key", count(*) AS cnt
FROM a JOIN l USING (batch)
WHERE l.late IS NULL OR a.ts > l.late
GROUP BY ALL""",
    "stream_progress": f"""
WITH {_arrivals(2)},
e AS (SELECT r.range AS batch,
             (SELECT date_trunc('millisecond', max(mx)) - INTERVAL 20 SECOND
              FROM m WHERE m.batch <= r.range - 1) AS wm
      FROM (SELECT unnest(generate_series(0, (SELECT b FROM nb))) AS range) r),
k AS (SELECT a.batch, a.ts, coalesce(a.ts <= l.late, false) AS dropped
      FROM a JOIN l USING (batch))
SELECT e.batch AS batch_id,
       (SELECT count(*) FROM k WHERE k.batch = e.batch) AS input_rows,
       coalesce(e.wm, TIMESTAMP '1970-01-01 00:00:00') AS watermark,
       (SELECT count(*) FROM k WHERE k.batch <= e.batch AND NOT k.dropped
                                 AND (e.wm IS NULL OR k.ts > e.wm)) AS state_rows,
       (SELECT count(*) FROM k WHERE k.batch = e.batch AND NOT k.dropped) AS state_rows_updated,
       (SELECT count(*) FROM k WHERE k.batch = e.batch AND k.dropped) AS dropped_by_watermark
FROM e""",
    "audit_missing": f"""
WITH {_arrivals(2)}
SELECT a.event_id AS id, CAST(a.event_id AS VARCHAR) AS key_text, a.ts AS "timestamp",
       CAST(a.event_id % 2 AS INTEGER) AS "partition", CAST(1 AS BIGINT) AS n_missing,
       CASE WHEN a.ts <= (SELECT wm FROM f) THEN 'late' ELSE 'withheld' END AS reason
FROM a JOIN l USING (batch)
WHERE a.ts <= l.late OR a.ts > (SELECT wm FROM f)""",
    "audit_summary": f"""
WITH {_arrivals(2)},
p AS (SELECT a.ts FROM a JOIN l USING (batch)
      WHERE (l.late IS NULL OR a.ts > l.late) AND a.ts <= (SELECT wm FROM f))
SELECT (SELECT count(*) FROM a) AS sent,
       (SELECT count(*) FROM p) AS persisted_rows,
       (SELECT count(*) FROM p) AS persisted,
       (SELECT max(ts) FROM p) AS latest_persisted,
       (SELECT count(*) FROM a JOIN l USING (batch) WHERE a.ts <= l.late) AS missing_late,
       (SELECT count(*) FROM a WHERE a.ts > (SELECT wm FROM f)) AS missing_withheld,
       CAST(0 AS BIGINT) AS malformed_keys,
       (SELECT count(*) FROM a) = (SELECT count(*) FROM p) AS complete""",
    "audit_flagship": """
WITH w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 20 SECOND AS wm FROM events),
p AS (SELECT ts FROM events WHERE ts <= (SELECT wm FROM w))
SELECT (SELECT count(*) FROM events) AS sent,
       (SELECT count(*) FROM p) AS persisted_rows,
       (SELECT count(*) FROM p) AS persisted,
       (SELECT max(ts) FROM p) AS latest_persisted,
       CAST(0 AS BIGINT) AS missing_late,
       (SELECT count(*) FROM events WHERE ts > (SELECT wm FROM w)) AS missing_withheld,
       CAST(0 AS BIGINT) AS malformed_keys,
       (SELECT count(*) FROM events) = (SELECT count(*) FROM p) AS complete""",
    "delivery_check": """
SELECT count(*) AS sent, count(*) AS received, count(*) AS expected,
       count(DISTINCT o_orderkey) AS distinct_keys, true AS ok
FROM orders""",
    "audit_in_progress": f"""
WITH {_arrivals(1, "WHERE batch < 3")}
SELECT a.event_id AS id, CAST(a.event_id AS VARCHAR) AS key_text, a.ts AS "timestamp",
       CAST(a.event_id % 2 AS INTEGER) AS "partition", CAST(1 AS BIGINT) AS n_missing,
       CASE WHEN a.batch >= 3 THEN 'unread'
            WHEN a.ts <= (SELECT wm FROM f) THEN 'late' ELSE 'withheld' END AS reason
FROM a JOIN l USING (batch)
WHERE a.batch >= 3 OR a.ts <= l.late OR a.ts > (SELECT wm FROM f)""",
    "delivery_check_constant": """
WITH c AS (SELECT count(*) AS sent, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS received
           FROM lineitem)
SELECT sent, received, expected, CAST(1 AS BIGINT) AS distinct_keys, received >= expected AS ok
FROM (SELECT sent, received, unnest([received - 1, received, received + 1, sent]) AS expected
      FROM c)""",
    "stream_late_aside": f"""
WITH {_arrivals(2)}
SELECT a.event_id AS id, a.ts AS "timestamp", CAST(a.event_id % 2 AS INTEGER) AS "partition",
       a.event_id // 2 AS "offset", {_ISO} AS "value", CAST(a.batch AS BIGINT) AS batch_id
FROM a JOIN l USING (batch) WHERE a.ts <= l.late""",
    bounded.NAME: _single("20 SECOND"),
    "stream_update_latest": f"""
WITH {_arrivals(2)},
k AS (SELECT a.batch, a.event_id, a.ts FROM a JOIN l USING (batch) WHERE l.late IS NULL OR a.ts > l.late)
SELECT CAST(event_id % 2 AS INTEGER) AS "partition", ts AS "timestamp", event_id AS "key",
       count(*) AS cnt, CAST(max(batch) AS BIGINT) AS batch_id
FROM k GROUP BY ALL""",
    "sink_daily": f"""
SELECT CAST("timestamp" AS DATE) AS day, * FROM ({_persisted(2)})
WHERE "timestamp" >= TIMESTAMP '2024-01-16 00:00:00'""",
    "withheld_state": """
SELECT CAST(event_id % 2 AS INTEGER) AS "partition", ts AS "timestamp", event_id AS "key", count(*) AS cnt
FROM events
WHERE ts > (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 20 SECOND
GROUP BY ALL""",
    "audit_incremental": f"""
WITH {_arrivals(2)},
p AS (SELECT b.batch, (SELECT date_trunc('millisecond', max(mx)) - INTERVAL 20 SECOND FROM m
                       WHERE m.batch < b.batch OR b.batch = 5) AS wm FROM m b),
k AS (SELECT p.batch, p.wm, a.ts, coalesce(a.ts <= l.late, false) AS late, coalesce(a.ts <= p.wm, false) AS closed
      FROM p JOIN a ON a.batch <= p.batch JOIN l ON l.batch = a.batch)
SELECT batch, count(*) AS sent,
       count(*) FILTER (closed AND NOT late) AS persisted_rows,
       count(*) FILTER (closed AND NOT late) AS persisted,
       max(ts) FILTER (closed AND NOT late) AS latest_persisted,
       count(*) FILTER (late) AS missing_late,
       count(*) FILTER (NOT closed) AS missing_withheld,
       CAST(0 AS BIGINT) AS malformed_keys,
       count(*) FILTER (late OR NOT closed) = 0 AS complete
FROM k GROUP BY batch""",
    "audit_watch": f"""
WITH {_arrivals(2)},
p AS (SELECT b.batch, (SELECT date_trunc('millisecond', max(mx)) - INTERVAL 20 SECOND FROM m
                       WHERE m.batch < b.batch) AS wm FROM m b WHERE b.batch < 3),
k AS (SELECT p.batch, a.batch > p.batch AS unread, a.ts, coalesce(a.ts <= l.late, false) AS late,
             coalesce(a.ts <= p.wm, false) AS closed
      FROM p, a JOIN l ON l.batch = a.batch)
SELECT batch, count(*) AS sent,
       count(*) FILTER (NOT unread AND closed AND NOT late) AS persisted_rows,
       count(*) FILTER (NOT unread AND closed AND NOT late) AS persisted,
       max(ts) FILTER (NOT unread AND closed AND NOT late) AS latest_persisted,
       count(*) FILTER (NOT unread AND late) AS missing_late,
       count(*) FILTER (NOT unread AND NOT closed) AS missing_withheld,
       CAST(0 AS BIGINT) AS malformed_keys, false AS complete,
       count(*) FILTER (unread) AS missing_unread
FROM k GROUP BY batch""",
    "delivery_fingerprint": """
WITH c AS (SELECT CAST(o_orderkey % 2 AS INTEGER) AS "partition", count(*) AS sent,
                  count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 100 = 0) AS lost,
                  count(*) FILTER (o_orderkey % 2 = 1 AND o_orderkey % 100 = 1) AS twice
           FROM orders GROUP BY ALL)
SELECT "partition", sent, sent - lost + twice AS received,
       CASE WHEN lost > twice THEN 'lost' WHEN twice > lost THEN 'copied' ELSE 'same' END AS verdict
FROM c""",
    "consume_range": f"""
WITH n AS (SELECT count(*) AS n FROM events)
SELECT CAST(event_id AS VARCHAR) AS "key", {_ISO} AS "value",
       CAST(event_id % 2 AS INTEGER) AS "partition", event_id // 2 AS "offset"
FROM events, n
WHERE (event_id % 2 = 0 AND event_id // 2 >= n // 8 AND event_id // 2 < n // 4)
   OR (event_id % 2 = 1 AND event_id // 2 >= n // 4 AND event_id // 2 < 3 * n // 8)""",
    "decode_key": _FLAGSHIP_IDS,
    "sorted_ids": _FLAGSHIP_IDS,
    "max_timestamp": """
SELECT max(ts) AS latest FROM events
WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 20 SECOND""",
    "envelope_encode": f"""
SELECT hex(CAST(event_id AS VARCHAR)) AS key_hex, hex({_ISO}) AS value_hex,
       'test_topic' AS topic, CAST(event_id % 2 AS INTEGER) AS "partition",
       event_id // 2 AS "offset", ts AS "timestamp", 0 AS "timestampType"
FROM events""",
    "envelope_encode_pair": """
SELECT 'key_' || CAST(o_orderkey AS VARCHAR) AS "key", 'val_' || CAST(o_custkey AS VARCHAR) AS "value",
       CAST(o_orderkey % 2 AS INTEGER) AS "partition", o_orderkey // 2 AS "offset",
       o_orderdate AS "timestamp"
FROM orders""",
    "envelope_decode": f"""
SELECT CAST(event_id AS VARCHAR) AS "key", {_ISO} AS "value",
       CAST(event_id % 2 AS INTEGER) AS "partition", event_id // 2 AS "offset"
FROM events""",
    "project_envelope": """
SELECT CAST(event_id AS VARCHAR) AS "key", ts AS "timestamp", CAST(event_id % 2 AS INTEGER) AS "partition"
FROM events""",
    "group_count": """
SELECT CAST(event_id % 2 AS INTEGER) AS "partition", ts AS "timestamp", event_id AS "key", count(*) AS cnt
FROM events GROUP BY ALL""",
    "group_count_wide": """
SELECT CAST(l_suppkey % 4 AS INTEGER) AS "partition", l_shipdate AS "timestamp",
       l_returnflag AS "key", count(*) AS cnt
FROM lineitem GROUP BY ALL""",
    "parquet_scan": "SELECT * FROM events",
    "range_roundtrip": "SELECT event_id AS id FROM events",
    "top20": "SELECT event_id AS id FROM events ORDER BY id LIMIT 20",
    "mean_id": "SELECT avg(event_id) AS mean_id FROM events",
}
# The engine reports the same, whoever reads it.
ORACLE_SQL["stream_progress_log"] = f"SELECT *, true AS reported FROM ({ORACLE_SQL['stream_progress']})"
