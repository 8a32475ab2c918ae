"""FileTopic: publish, consume, arrival batches, offsets."""

import os
import re
import time

from helpers import fixture_records, small_settings

from tidemark.session import run_dir
from tidemark.sources.topic import FileTopic
from tidemark.streaming.checkpoint import position
from tidemark.streaming.flow import run_count
from tidemark.streaming.replay import publish_arrivals, run_per_batch


def test_batches_are_folders_of_one_write(spark):
    topic = FileTopic(spark, f"{run_dir(spark, 'topic')}/topic")
    recs = fixture_records(spark, [[(i, i) for i in range(50)], [(50, 60)], [], [(51, 90_000)]])
    topic.publish_batches(recs, "batch", by_day=True)
    assert topic.read().count() == topic.read_batches().count() == 52
    rows = topic.read_batches(by_day=True).groupBy("batch", "day").count().collect()
    assert sorted((r["batch"], str(r["day"]), r["count"]) for r in rows) == [
        (0, "2023-11-14", 50), (1, "2023-11-14", 1), (3, "2023-11-15", 1),
    ]


def test_offsets_are_skipped_by_file(spark):
    topic = FileTopic(spark, f"{run_dir(spark, 'topic')}/topic")
    recs = fixture_records(spark, [[(i, i) for i in range(4000)]])
    topic.publish_clustered(recs, files=4)
    got = topic.read_offsets({0: (10, 20), 1: (None, 5)})
    assert sorted((r["partition"], r["offset"]) for r in got.select("partition", "offset").collect()) == [
        *[(0, o) for o in range(10, 20)], *[(1, o) for o in range(5)],
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[Or\(", plan) and "GreaterThanOrEqual(offset,10)" in plan
    files = topic.read().select("_metadata.file_path").distinct().count()
    assert got.select("_metadata.file_path").distinct().count() < files
    assert topic.read_offsets({}).count() == 0 and topic.read_offsets({1: (None, None)}).count() == 2000


def test_files_of_one_name_are_told_apart(spark):
    """Batches written by one job hold files of the same name."""
    recs = fixture_records(spark, [[(0, 0)], [(1, 5)], [(2, 9)]])
    arr = publish_arrivals(spark, recs, "batch", 3)
    run = run_per_batch(spark, arr, small_settings(), last=2)
    marked = arr.topic.read_marked(run.checkpoint, position(spark, run.checkpoint))
    assert {bytes(r["key"]).decode(): r["is_read"] for r in marked.collect()} == {"0": True, "1": True, "2": False}


def test_old_files_are_read(spark):
    """A file that comes with the modification time of long ago loses nothing."""
    root = run_dir(spark, "topic-age")
    topic = FileTopic(spark, f"{root}/topic")
    topic.publish(fixture_records(spark, [[(i, i) for i in range(20)]]))
    settings = small_settings()
    run_count(spark, topic.read_stream(), f"{root}/sink", f"{root}/ck", settings)
    before = set(os.listdir(topic.path.removeprefix("file:")))
    topic.publish(fixture_records(spark, [[(i, 100 + i) for i in range(20, 820)]]))
    old = time.time() - 8 * 86_400
    for name in set(os.listdir(topic.path.removeprefix("file:"))) - before:
        os.utime(os.path.join(topic.path.removeprefix("file:"), name), (old, old))
    prog = run_count(spark, topic.read_stream(), f"{root}/sink", f"{root}/ck", settings)
    assert sum(p["numInputRows"] for p in prog) == 800


def test_an_interrupted_series_goes_on_with_its_checkpoint(spark):
    recs = fixture_records(spark, [[(0, 0), (1, 5)], [(2, 100)], [(3, 200)]])
    arr = publish_arrivals(spark, recs, "batch", 3)
    root = run_dir(spark, "resume")
    part = run_per_batch(spark, arr, small_settings(), last=2, root=root)
    assert sum(p["numInputRows"] for p in part.progress) == 3
    rest = run_per_batch(spark, arr, small_settings(), first=3, root=root)
    assert sum(p["numInputRows"] for p in rest.progress) == 1
    assert spark.read.parquet(rest.sink).count() == 3
