"""S2, K4, W4 and the stream settings: pure option builders."""

import os

import pytest

from tidemark.sources.kafka import kafka_sink_options, kafka_source_options
from tidemark.sources.objectstore import s3a_conf
from tidemark.streaming.flow import (
    HDFS_PROVIDER,
    ROCKSDB_CHANGELOG,
    ROCKSDB_PROVIDER,
    StreamSettings,
    trigger_args,
)


def test_kafka_source_options():
    o = kafka_source_options(["broker1:9092", "broker2:9092"])
    assert o == {
        "kafka.bootstrap.servers": "broker1:9092,broker2:9092",
        "subscribe": "test_topic",
        "startingOffsets": "earliest",
    }
    o = kafka_source_options(
        "b:1", topic="t", isolation_level="read_committed", max_offsets_per_trigger=1000,
        fail_on_data_loss=False, min_partitions=64,
    )
    assert o["minPartitions"] == "64"
    assert kafka_source_options("b:1", group_id="group_1")["kafka.group.id"] == "group_1"
    assert o["kafka.isolation.level"] == "read_committed"
    assert o["maxOffsetsPerTrigger"] == "1000"
    assert o["failOnDataLoss"] == "false"
    assert "offset" not in o  # not a Kafka-source option
    assert kafka_sink_options("b:1") == {"kafka.bootstrap.servers": "b:1", "topic": "test_topic"}


def test_s3a_conf():
    c = s3a_conf("user", "secret", "http://store:9000/")
    assert c["spark.hadoop.fs.s3a.access.key"] == "user"
    assert c["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000/"
    assert c["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert c["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "true"
    assert c["spark.hadoop.fs.s3a.attempts.maximum"] == "1"
    assert c["spark.hadoop.fs.s3a.connection.establish.timeout"] == "5000"
    assert c["spark.hadoop.fs.s3a.connection.timeout"] == "10000"
    assert c["spark.hadoop.fs.s3.impl"] == "org.apache.hadoop.fs.s3a.S3AFileSystem"
    assert "fs.s3a.endpoint" in s3a_conf("a", "b", "e", prefix="")


def test_triggers_and_settings():
    assert trigger_args("processing") == {"processingTime": "10 seconds"}
    assert trigger_args() == {"availableNow": True}
    s = StreamSettings(state_partitions=16, allow_multiple=False, no_data_batches=False,
                       state_store="rocksdb")
    c = s.conf()
    assert c["spark.sql.shuffle.partitions"] == "16"
    assert "spark.sql.streaming.numRecentProgressUpdates" not in c
    assert c["spark.sql.streaming.statefulOperator.allowMultiple"] == "false"
    assert c["spark.sql.streaming.noDataMicroBatches.enabled"] == "false"
    assert c["spark.sql.streaming.stateStore.providerClass"] == ROCKSDB_PROVIDER
    assert c[ROCKSDB_CHANGELOG] == "true"
    assert c["spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"] == "true"
    assert StreamSettings().delay == "20 seconds"
    assert StreamSettings().state_store == "rocksdb"
    assert StreamSettings(state_store="hdfs").conf()[
        "spark.sql.streaming.stateStore.providerClass"
    ] == HDFS_PROVIDER
    with pytest.raises(ValueError):
        StreamSettings(state_store="memory").conf()


def test_submitted_settings_survive():
    """What spark-submit says about partitions holds; only a local master gets 8."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "from tidemark.session import build_session;"
        "s = build_session({});"
        "print('got', s.conf.get('spark.sql.shuffle.partitions'),"
        " s.conf.get('spark.sql.files.maxPartitionBytes')); s.stop()"
    )
    env = dict(os.environ, PYSPARK_SUBMIT_ARGS="--master local[1] --conf spark.sql.shuffle.partitions=5000 pyspark-shell")
    root = Path(__file__).resolve().parents[1]
    for args, want in (("None", "5000"), ("None, shuffle_partitions=3", "3"), ("'local[1]'", "8")):
        out = subprocess.run([sys.executable, "-c", code.format(args)], cwd=root, env=env,
                             capture_output=True, text=True, timeout=120)
        line = [x for x in out.stdout.splitlines() if x.startswith("got")]
        assert line and line[0].split()[1] == want, out.stderr[-1000:]


def test_a_cluster_must_name_its_shared_folder_and_state_partitions(spark, monkeypatch):
    import tidemark.session as session
    from tidemark.streaming import flow

    monkeypatch.setattr(session, "is_local", lambda s: False)
    monkeypatch.setattr(flow, "is_local", lambda s: False)
    sc = spark.sparkContext
    monkeypatch.setattr(type(sc), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(sc), "getConf", lambda self: {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(spark)
    with pytest.raises(ValueError, match="state_partitions"):
        StreamSettings().conf(spark)
    assert StreamSettings(state_partitions=64).conf(spark)["spark.sql.shuffle.partitions"] == "64"
