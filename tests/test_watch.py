"""The audit of a live query that reads what is new: equal to the full one, poll by poll."""

import json

import pytest
from conftest import SF_SMALL
from helpers import fixture_records, keys_out, small_settings

from tidemark.__main__ import main
from tidemark.plans import scenarios as sc
from tidemark.session import pin_utc, run_dir
from tidemark.sinks.daily import DailySink, start_daily_sink
from tidemark.sources.tables import table_version
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import run_count
from tidemark.streaming.live import audit_now
from tidemark.streaming.replay import publish_arrivals, run_per_batch
from tidemark.streaming.watch import Watch

DAY = 86_400
BATCHES = [
    [(0, 0), (1, DAY), (2, DAY + 50)],
    [(3, 2 * DAY), (4, 2 * DAY + 5)],
    [(5, 3), (6, 3 * DAY), (6, 3 * DAY)],  # 5 is late by days
    [(7, DAY + 1), (8, 5 * DAY), (9, 5 * DAY + 19)],
]


def full_audit(spark, topic, sink, checkpoint):
    return audit_now(spark, topic, sink, checkpoint=checkpoint, read=lambda s, path: DailySink(s, path).read())


def test_every_poll_equals_the_full_audit(spark, monkeypatch):
    arr = publish_arrivals(spark, fixture_records(spark, BATCHES), "batch", 4)
    totals, polls, opened = run_dir(spark, "watch"), [], []
    read_files = FileTopic.read_files
    monkeypatch.setattr(FileTopic, "read_files", lambda t, fs: opened.append(list(fs)) or read_files(t, fs))

    def poll(b, run):
        opened.clear()
        # A new session each time: nothing is remembered but what is stored.
        fresh = spark.newSession()
        pin_utc(fresh)
        got = Watch(fresh, FileTopic(fresh, arr.topic.path), run.sink, run.checkpoint, totals).poll()
        files = [p for fs in opened for p in fs]
        polls.append((got, files))
        assert got.asDict() == full_audit(spark, arr.topic, run.sink, run.checkpoint).asDict()

    run_per_batch(spark, arr, small_settings(), one_run=True, start=start_daily_sink, after=poll)
    assert [row["missing_unread"] for row, _ in polls] == [8, 6, 3, 0]
    assert polls[-1][0]["missing_late"] == 2 and not polls[-1][0]["complete"]
    # The last poll opens none of the first batch's files: its days were closed.
    assert not any("batch=0/" in f for f in polls[-1][1]) and any("batch=0/" in f for f in polls[1][1])


def test_a_poll_without_news_repeats_the_answer(spark):
    arr = publish_arrivals(spark, fixture_records(spark, BATCHES), "batch", 4)
    run = run_per_batch(spark, arr, small_settings(), start=start_daily_sink)
    watch = Watch(spark, arr.topic, run.sink, run.checkpoint, run_dir(spark, "watch"))
    rows = [watch.poll() for _ in range(4)]
    assert rows == [rows[0]] * 4 and rows[0]["sent"] == 11
    # The stored totals do not grow with the polls.
    assert [n for n in watch.store.files.names() if n.startswith("poll-")] == ["poll-2", "poll-3"]
    assert [n for n in watch.store.files.names() if n.startswith("files-")] == ["files-2", "files-3"]


def test_a_poll_that_failed_is_run_again(spark, monkeypatch):
    arr = publish_arrivals(spark, fixture_records(spark, BATCHES), "batch", 4)
    root, run = run_dir(spark, "watch-again"), None
    watch = None

    def poll(b, run):
        nonlocal watch
        watch = Watch(spark, arr.topic, run.sink, run.checkpoint, root)
        if b == 1:  # dies after the open files are noted, before the totals are
            monkeypatch.setattr(watch.store, "poll", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                watch.poll()
        else:
            assert watch.poll() == full_audit(spark, arr.topic, run.sink, run.checkpoint)

    run = run_per_batch(spark, arr, small_settings(), one_run=True, start=start_daily_sink, after=poll)
    assert run.progress and watch.store.progress().poll == 2


def test_nothing_to_say_before_the_first_commit(spark):
    root = run_dir(spark, "watch-early")
    topic = FileTopic(spark, f"{root}/topic")
    topic.publish(fixture_records(spark, BATCHES))
    watch = Watch(spark, topic, f"{root}/sink", f"{root}/ck", f"{root}/totals")
    assert watch.poll() is None
    run_count(spark, topic.read_stream(), f"{root}/sink", f"{root}/ck", small_settings(), start=start_daily_sink)
    row = watch.poll()
    assert row["sent"] == 11 and row["missing_withheld"] == 2 and row["missing_unread"] == 0
    # Records without a timestamp stay open and are withheld for ever.
    assert watch.poll() == row


def test_read_files_of_none_is_empty(spark):
    topic = FileTopic(spark, f"{run_dir(spark, 'none')}/a b%20c/topic")
    topic.publish(fixture_records(spark, BATCHES))
    assert topic.read_files([]).count() == 0
    assert topic.read_files(topic.files().values()).count() == 11  # a path that wants decoding


def test_a_newcomer_starts_behind_what_was_there(spark):
    arr = publish_arrivals(spark, fixture_records(spark, BATCHES), "batch", 4)
    run = run_per_batch(spark, arr, small_settings(), one_run=True, start_at=2)
    assert sum(p["numInputRows"] for p in run.progress) == 6
    # The third batch comes first: its record of long ago is late for nobody, the last batch's neither.
    assert keys_out(spark, run.sink) == [5, 6, 7]


def test_a_change_in_a_folder_of_a_table_is_seen(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 AS part").write.partitionBy("part").parquet(f"{tmp_path}/t.parquet")
    before = table_version(spark, str(tmp_path), "t")
    assert before == table_version(spark, str(tmp_path), "t") and before[0] >= 2
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t.parquet/part=1")
    assert table_version(spark, str(tmp_path), "t") != before


def test_command_line_of_a_sink_by_day(spark, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    root = run_dir(spark, "cli-daily")
    FileTopic(spark, f"{root}/topic").publish(sc.events_records(spark, SF_SMALL))
    sink = ["--sink", f"{root}/sink"]
    args = ["--topic", f"{root}/topic", *sink, "--daily", "--state-partitions", "2"]
    assert main(["drain", *args]) == 0
    assert main(["audit", *args, "--rounds", "2", "--every", "0"]) == 0
    drained, one, two = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert drained["input_rows"] == 1000 and one == two
    assert (one["sent"], one["persisted"], one["missing_withheld"], one["missing_unread"]) == (1000, 999, 1, 0)
    days = DailySink(spark, f"{root}/sink").days()
    assert main(["compact", *sink, "--expire-before", days[1]]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["days"] == len(days) - 1


def test_ingest_by_day_polls_what_is_new(spark, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    root = run_dir(spark, "cli-daily-live")
    FileTopic(spark, f"{root}/topic").publish(sc.events_records(spark, SF_SMALL))
    args = ["--topic", f"{root}/topic", "--sink", f"{root}/sink", "--daily", "--state-partitions", "2"]
    assert main(["ingest", *args, "--for", "30", "--poll", "--every", "2"]) == 0
    assert DailySink(spark, f"{root}/sink").read().count() == 999
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert rows and rows[-1]["sent"] == 1000 and rows[-1]["missing_late"] == 0
