"""W4 + W8: a live processing-time trigger, driven with processAllAvailable."""

from helpers import fixture_records, keys_out

from tidemark.session import run_dir
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import count_per_key, session_conf, start_parquet_sink, trigger_args


def test_processing_time_trigger(spark):
    root = run_dir(spark, "live")
    topic = FileTopic(spark, f"{root}/topic")
    topic.publish(fixture_records(spark, [[(0, 0), (1, 5), (2, 100)]]).drop("batch"))
    with session_conf(spark, {"spark.sql.shuffle.partitions": "2"}):
        q = start_parquet_sink(
            count_per_key(topic.read_stream()),
            f"{root}/sink",
            f"{root}/checkpoint",
            "live_count",
            trigger_args("processing", "1 second"),
        )
    try:
        assert q.name == "live_count"
        q.processAllAvailable()
        topic.publish(fixture_records(spark, [[(3, 200)]]).drop("batch"))
        q.processAllAvailable()
    finally:
        q.stop()
    # Watermark 100 - 20 = 80 s emits 0 and 1; then 200 - 20 = 180 s emits 2.
    assert keys_out(spark, f"{root}/sink") == [0, 1, 2]
