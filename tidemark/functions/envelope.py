"""Record envelope: schema and the scalar functions around it.

All functions return Columns built from ``pyspark.sql.functions`` so they stay
inside whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values of the system we reproduce.
TOPIC = "test_topic"
ISO_MILLIS_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
WATERMARK_DELAY = "20 seconds"
TRIGGER_INTERVAL = "10 seconds"
TOPIC_PARTITIONS = 2
PAIR_KEY_PREFIX = "key_"
PAIR_VALUE_PREFIX = "val_"
CONSTANT_KEY = "key"
CONSTANT_VALUE = "value"
# ---------------------------------------------------------------------------

# S3: the fixed record schema of Spark's Kafka source; shared by the live
# source, the replay source and the consumer.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("timestampType", T.IntegerType(), True),
    ]
)
ENVELOPE_COLUMNS = [f.name for f in ENVELOPE_SCHEMA.fields]

# The group key of the per-record count (A1) and of the sink rows.
GROUP_KEY = ["partition", "timestamp", "key"]

# What the flow writes: one row per finished group.
SINK_SCHEMA = T.StructType(
    [
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("key", T.BinaryType(), True),
        T.StructField("cnt", T.LongType(), False),
    ]
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bytes_to_text(c: Column | str) -> Column:
    """bytes -> text (UTF-8)."""
    return F.decode(_col(c), "UTF-8")


def text_to_long(c: Column | str) -> Column:
    """text -> integer; malformed text gives null instead of failing."""
    return _col(c).try_cast("bigint")


def key_to_id(c: Column | str = "key") -> Column:
    """F1 then F2: the decode applied to every persisted key."""
    return text_to_long(bytes_to_text(c))


def text_to_bytes(c: Column | str) -> Column:
    """any value -> its text -> UTF-8 bytes."""
    return F.encode(_col(c).cast("string"), "UTF-8")


def prefixed(prefix: str, c: Column | str) -> Column:
    """``key_<k>`` / ``val_<v>`` formatting."""
    return F.concat(F.lit(prefix), _col(c).cast("string"))


def iso_millis(c: Column | str) -> Column:
    """timestamp -> ``yyyy-MM-dd'T'HH:mm:ss.SSS'Z'``.

    Renders in the session zone, which tidemark pins to UTC; sub-millisecond
    digits are truncated.
    """
    return F.date_format(_col(c), ISO_MILLIS_UTC)


def as_event_time(c: Column | str) -> Column:
    """Event-time columns must be TIMESTAMP (LTZ) for ``withWatermark``."""
    return _col(c).cast("timestamp")


def as_wall_clock(c: Column | str) -> Column:
    """Results carry TIMESTAMP_NTZ so that plain-timestamp engines compare equal."""
    return _col(c).cast("timestamp_ntz")
