"""tidemark: watermarked stream ingest and its audit, written as Spark jobs.

Records arrive in the shape of Spark's Kafka source (a live topic, or a table
replayed as one), are counted per key in event time with Structured
Streaming, written to Parquet exactly once per finished group, and then
audited with batch DataFrame queries: what was sent, what was persisted, what
the watermark still withholds and what was dropped as late.

    from tidemark import build_session, FileTopic, StreamSettings, run_count, audit
"""

from tidemark.operators import audit
from tidemark.operators.records import (
    constant_records,
    counter_records,
    decode_records,
    pair_records,
)
from tidemark.session import build_session, run_dir, shared_root
from tidemark.sources.kafka import KafkaTopic
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import StreamSettings, count_per_key, run_count
from tidemark.streaming.live import poll, start_ingest, supervise

__all__ = [
    "FileTopic",
    "KafkaTopic",
    "StreamSettings",
    "audit",
    "build_session",
    "constant_records",
    "count_per_key",
    "counter_records",
    "decode_records",
    "pair_records",
    "poll",
    "run_count",
    "run_dir",
    "shared_root",
    "start_ingest",
    "supervise",
]
