"""The 11-message timeline: two bursts separated by a pause, one checkpoint.

Ids 0..10 at -10, 0, 10, 20, 30, 40 | 90, 100, 110, 120, 130 seconds.
"""

from pathlib import Path

from helpers import fixture_records, keys_out, small_settings

from tidemark.session import run_dir
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import run_count
from tidemark.streaming.replay import publish_arrivals, run_per_batch

T0 = 10  # burst 1 starts 10 s after the fixture base
TIMES = [-10, 0, 10, 20, 30, 40, 90, 100, 110, 120, 130]


def test_two_bursts_on_one_checkpoint(spark):
    root = run_dir(spark, "timeline")
    topic = FileTopic(spark, f"{root}/topic")
    sink, ckpt = f"{root}/sink", f"{root}/checkpoint"
    settings = small_settings()
    burst1 = [[(i, T0 + TIMES[i]) for i in range(6)]]
    burst2 = [[(i, T0 + TIMES[i]) for i in range(6, 11)]]

    topic.publish(fixture_records(spark, burst1).drop("batch"))
    run_count(spark, topic.read_stream(), sink, ckpt, settings)
    assert keys_out(spark, sink) == [0, 1, 2, 3]

    # Idle rerun: no new data, the watermark cannot move, nothing comes out.
    run_count(spark, topic.read_stream(), sink, ckpt, settings)
    assert keys_out(spark, sink) == [0, 1, 2, 3]

    topic.publish(fixture_records(spark, burst2).drop("batch"))
    run_count(spark, topic.read_stream(), sink, ckpt, settings)
    assert keys_out(spark, sink) == list(range(9))  # 9 and 10 stay in state


def test_a_series_of_runs_loads_snapshots_not_all_changes_so_far(spark):
    """Each run of a series loads the state anew: replaying the changes of every batch before
    would cost more with each batch."""
    batches = [[(i, T0 + TIMES[i])] for i in range(6)]
    arr = publish_arrivals(spark, fixture_records(spark, batches), "batch", 6)
    run = run_per_batch(spark, arr, small_settings(), one_run=True)
    assert keys_out(spark, run.sink) == [0, 1, 2, 3]
    for part in range(2):
        stored = [f.name for f in Path(run.checkpoint.removeprefix("file:"), "state/0", str(part)).iterdir()]
        assert {f"{v}.zip" for v in range(1, 7)} <= set(stored)
        assert not [f for f in stored if f.endswith(".changelog")]


def test_a_live_run_takes_up_the_checkpoint_of_a_series_and_back(spark):
    batches = [[(i, T0 + TIMES[i])] for i in range(6)]
    arr = publish_arrivals(spark, fixture_records(spark, batches), "batch", 6)
    settings = small_settings(no_data_batches=False)
    run = run_per_batch(spark, arr, settings, last=2)
    for b in (3, 4):  # with a log of changes
        run_count(spark, arr.topic.read_stream(batches=b), run.sink, run.checkpoint, settings)
    root = run.sink.removesuffix("/sink")
    run_per_batch(spark, arr, small_settings(), first=5, root=root)
    assert keys_out(spark, run.sink) == [0, 1, 2, 3]
