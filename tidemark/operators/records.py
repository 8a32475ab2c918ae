"""Record operators: encode rows into envelopes, decode and project them.

K3 (encode), S6 (decode), P1 (project), P2/P3 (key projection and decode).
All are single projections: no shuffle, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.envelope import (
    CONSTANT_KEY,
    CONSTANT_VALUE,
    PAIR_KEY_PREFIX,
    PAIR_VALUE_PREFIX,
    TOPIC,
    TOPIC_PARTITIONS,
    as_event_time,
    bytes_to_text,
    iso_millis,
    key_to_id,
    prefixed,
    text_to_bytes,
)


def encode_records(
    df: DataFrame,
    key: Column,
    value: Column,
    timestamp: Column,
    record_id: str,
    topic: str = TOPIC,
    partitions: int = TOPIC_PARTITIONS,
    carry: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """K3: one envelope per input row.

    ``record_id`` is an integer column that places the record in the topic:
    partition ``id mod P`` and offset ``id div P``. Ids 0, 1, 2, ... give offsets
    that are dense within each partition, as a broker would assign them; ids
    that repeat give offsets that repeat, and (partition, offset) is then no key.
    """
    rid = F.col(record_id)
    return df.select(
        text_to_bytes(key).alias("key"),
        text_to_bytes(value).alias("value"),
        F.lit(topic).alias("topic"),
        F.pmod(rid, F.lit(partitions)).cast("int").alias("partition"),
        F.expr(f"`{record_id}` div {int(partitions)}").cast("bigint").alias("offset"),
        as_event_time(timestamp).alias("timestamp"),
        F.lit(0).alias("timestampType"),
        *carry,
    )


def counter_records(df: DataFrame, id_col: str, time_col: str, **kw) -> DataFrame:
    """Counter form: key = the sequence number as text, value = send time as
    UTC ISO text with milliseconds, record time = the same instant."""
    ts = as_event_time(time_col)
    return encode_records(df, F.col(id_col), iso_millis(ts), ts, id_col, **kw)


def pair_records(
    df: DataFrame, key_col: str, value_col: str, time_col: str, id_col: str, **kw
) -> DataFrame:
    """Pair form: ``key_<k>`` -> ``val_<v>``."""
    return encode_records(
        df,
        prefixed(PAIR_KEY_PREFIX, key_col),
        prefixed(PAIR_VALUE_PREFIX, value_col),
        F.col(time_col),
        id_col,
        **kw,
    )


def constant_records(df: DataFrame, time_col: str, id_col: str, **kw) -> DataFrame:
    """Constant form: the same ``("key", "value")`` pair for every row."""
    return encode_records(
        df, F.lit(CONSTANT_KEY), F.lit(CONSTANT_VALUE), F.col(time_col), id_col, **kw
    )


def decode_records(records: DataFrame) -> DataFrame:
    """What a consumer sees of each record."""
    return records.select(
        bytes_to_text("key").alias("key"),
        bytes_to_text("value").alias("value"),
        "partition",
        "offset",
    )


def project_records(records: DataFrame) -> DataFrame:
    """The three columns the per-key count needs."""
    return records.select("key", "timestamp", "partition")


def decode_ids(table: DataFrame, key_col: str = "key") -> DataFrame:
    """P2 + P3: project the key and decode bytes -> text -> integer.

    Keys that are not decimal text (``key_0``, ``key``) decode to null
    rather than failing the job; ``malformed_keys`` counts them.
    """
    return table.select(key_to_id(key_col).alias("id"))
