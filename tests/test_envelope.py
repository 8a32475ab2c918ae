"""S3, K3 forms, S6, F1-F5 on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.envelope import (
    ENVELOPE_COLUMNS,
    ENVELOPE_SCHEMA,
    bytes_to_text,
    iso_millis,
    key_to_id,
    prefixed,
    text_to_bytes,
)
from tidemark.operators.records import (
    constant_records,
    counter_records,
    decode_ids,
    decode_records,
    pair_records,
    project_records,
)


def test_schema_is_the_kafka_source_schema():
    assert ENVELOPE_COLUMNS == [
        "key", "value", "topic", "partition", "offset", "timestamp", "timestampType"
    ]
    types = {f.name: f.dataType.simpleString() for f in ENVELOPE_SCHEMA.fields}
    assert types == {
        "key": "binary", "value": "binary", "topic": "string", "partition": "int",
        "offset": "bigint", "timestamp": "timestamp", "timestampType": "int",
    }


def test_scalar_functions(spark):
    df = spark.createDataFrame(
        [(7, dt.datetime(2024, 1, 2, 3, 4, 5, 678901))], "i long, ts timestamp_ntz"
    )
    r = df.select(
        text_to_bytes("i").alias("b"),
        bytes_to_text(text_to_bytes("i")).alias("t"),
        key_to_id(text_to_bytes("i")).alias("back"),
        prefixed("key_", "i").alias("p"),
        iso_millis(F.col("ts").cast("timestamp")).alias("iso"),
    ).first()
    assert bytes(r.b) == b"7" and r.t == "7" and r.back == 7 and r.p == "key_7"
    assert r.iso == "2024-01-02T03:04:05.678Z"  # truncated, not rounded


def test_malformed_keys_decode_to_null(spark):
    df = spark.createDataFrame([("12",), ("key_0",), ("key",), (" 5",)], "k string")
    ids = [r.id for r in decode_ids(df.select(text_to_bytes("k").alias("key"))).collect()]
    assert ids[:3] == [12, None, None]


def test_three_forms(spark):
    base = spark.createDataFrame(
        [(0, 5, dt.datetime(2024, 1, 1)), (3, 9, dt.datetime(2024, 1, 1, 0, 0, 1))],
        "id long, v long, ts timestamp_ntz",
    )
    c = decode_records(counter_records(base, "id", "ts")).orderBy("offset").collect()
    assert [(r.key, r.value, r.partition, r.offset) for r in c] == [
        ("0", "2024-01-01T00:00:00.000Z", 0, 0),
        ("3", "2024-01-01T00:00:01.000Z", 1, 1),
    ]
    p = decode_records(pair_records(base, "id", "v", "ts", "id")).collect()
    assert sorted((r.key, r.value) for r in p) == [("key_0", "val_5"), ("key_3", "val_9")]
    k = decode_records(constant_records(base, "ts", "id")).collect()
    assert {(r.key, r.value) for r in k} == {("key", "value")}
    enc = counter_records(base, "id", "ts")
    assert enc.columns == ENVELOPE_COLUMNS
    assert project_records(enc).columns == ["key", "timestamp", "partition"]
    assert enc.where(F.col("topic") != "test_topic").count() == 0
