"""Live ingest with a processing-time trigger and the audit poll."""

from helpers import fixture_records

from tidemark.session import run_dir
from tidemark.sources.kafka import KafkaTopic
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import StreamSettings
from tidemark.streaming.live import audit_now, poll, start_ingest


def test_ingest_and_poll(spark):
    root = run_dir(spark, "live-poll")
    topic = FileTopic(spark, f"{root}/topic")
    sink = f"{root}/sink"
    assert audit_now(spark, topic, sink) is None  # nothing committed yet
    topic.publish(fixture_records(spark, [[(0, 0), (1, 5), (2, 100)]]).drop("batch"))
    q = start_ingest(
        spark, topic, sink, f"{root}/checkpoint",
        StreamSettings(state_partitions=2, query_name="live_poll"), interval="1 second",
    )
    try:
        q.processAllAvailable()
        (progress, row), = list(poll(spark, q, topic, sink, interval_s=0, rounds=1))
    finally:
        q.stop()
    assert progress["name"] == "live_poll"
    assert (row.sent, row.persisted, row.missing_late, row.missing_withheld) == (3, 2, 0, 1)
    assert row.complete is False


def test_a_lagging_stream_has_unread_records_not_late_ones(spark):
    from tidemark.streaming.replay import publish_arrivals, run_per_batch

    rows = [[(i, i) for i in range(200)], [(i, i) for i in range(200, 1000)]]
    arr = publish_arrivals(spark, fixture_records(spark, rows), "batch", 2)
    run = run_per_batch(spark, arr, StreamSettings(state_partitions=2), last=1)
    row = audit_now(spark, arr.topic, run.sink, checkpoint=run.checkpoint)
    assert (row.sent, row.missing_unread, row.missing_late) == (1000, 800, 0)
    assert row.persisted + row.missing_withheld == 200 and row.complete is False
    run_per_batch(spark, arr, StreamSettings(state_partitions=2), first=2,
                  root=run.sink.rsplit("/", 1)[0])
    row = audit_now(spark, arr.topic, run.sink, checkpoint=run.checkpoint)
    assert (row.missing_unread, row.missing_late, row.persisted) == (0, 0, 980)


def test_a_batch_that_commits_during_the_audit_makes_nothing_late(spark, monkeypatch):
    import tidemark.streaming.live as live
    from tidemark.streaming.replay import publish_arrivals, run_per_batch

    rows = [[(i, i) for i in range(50)], [(i, i) for i in range(50, 100)]]
    arr = publish_arrivals(spark, fixture_records(spark, rows), "batch", 2)
    settings = StreamSettings(state_partitions=2)
    run = run_per_batch(spark, arr, settings, last=1)
    read = live.read_sink

    def late_read(*a, **k):  # the second batch commits between the topic and the sink
        run_per_batch(spark, arr, settings, first=2, root=run.sink.rsplit("/", 1)[0])
        return read(*a, **k)

    monkeypatch.setattr(live, "read_sink", late_read)
    row = audit_now(spark, arr.topic, run.sink, checkpoint=run.checkpoint)
    assert row.missing_late == 0 and row.sent == 100


def test_both_topics_have_one_interface():
    import inspect

    for name in ("publish", "read", "read_stream", "read_marked"):
        one = inspect.signature(getattr(FileTopic, name)).parameters
        two = inspect.signature(getattr(KafkaTopic, name)).parameters
        assert set(two) <= set(one) and ("per_trigger" in two) == (name == "read_stream")


def test_kafka_records_before_the_position_are_read(spark):
    from tidemark.streaming.checkpoint import Position, offsets_read

    at = Position(3, 0, {"t": {"0": 5, "1": 2}})
    df = spark.createDataFrame([(0, 4), (0, 5), (1, 1), (1, 2), (2, 0)], "partition int, offset long")
    assert [r[0] for r in df.select(offsets_read(at, "t")).collect()] == [True, False, True, False, False]


def test_supervise_counts_failures_in_a_row_and_failed_starts():
    import pytest

    from tidemark.streaming.live import supervise

    calls = []

    def start():
        calls.append(1)
        raise RuntimeError("broker out of reach")

    with pytest.raises(RuntimeError):
        supervise(start, restarts=2, backoff_s=0)
    assert len(calls) == 3
    calls.clear()

    def weekly():
        calls.append(1)
        if len(calls) < 9:
            raise RuntimeError("once a week")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):  # each attempt counts as healthy
        supervise(weekly, restarts=1, backoff_s=0, healthy_s=0)


def test_kafka_topic_shape(spark):
    t = KafkaTopic(spark, ["b1:9092", "b2:9092"], max_offsets_per_trigger=None)
    assert t.path == "kafka://b1:9092,b2:9092/test_topic"


def test_poll_reports_a_failing_round_and_goes_on(spark, monkeypatch):
    import tidemark.streaming.live as live

    root = run_dir(spark, "live-fail")
    topic = FileTopic(spark, f"{root}/topic")
    topic.publish(fixture_records(spark, [[(0, 0)]]).drop("batch"))
    q = start_ingest(
        spark, topic, f"{root}/sink", f"{root}/checkpoint",
        StreamSettings(state_partitions=2, query_name="live_fail"), interval="1 second",
    )
    calls = []

    def boom(*a, **k):
        calls.append(1)
        raise RuntimeError("store unreachable")

    monkeypatch.setattr(live, "audit_now", boom)
    try:
        rounds = list(poll(spark, q, topic, f"{root}/sink", interval_s=0, rounds=2))
    finally:
        q.stop()
    assert len(rounds) == 2 and len(calls) == 2
    assert all(p == {"error": "store unreachable"} and row is None for p, row in rounds)


def test_supervise_restarts_a_failed_query():
    import pytest

    from tidemark.streaming.live import supervise

    class Fake:
        def __init__(self, fail):
            self.fail, self.isActive = fail, True

        def awaitTermination(self, timeout=None):
            if self.fail:
                self.isActive = False
                raise RuntimeError("query failed")
            return True

        def stop(self):
            self.isActive = False

    plan = iter([True, True, False])
    q = supervise(lambda: Fake(next(plan)), restarts=3, backoff_s=0, timeout_s=1)
    assert q.isActive is False and q.fail is False
    with pytest.raises(RuntimeError):
        supervise(lambda: Fake(True), restarts=1, backoff_s=0, timeout_s=1)
