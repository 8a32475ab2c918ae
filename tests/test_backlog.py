"""A backlog published in time order, in any number of batches: same output, bounded state."""

import pytest
from conftest import SF_SMALL
from helpers import BASE, fixture_records, keys_out, small_settings

from tidemark.plans import scenarios as sc
from tidemark.streaming.replay import publish_in_time_order, run_per_batch


@pytest.mark.parametrize("n", [1, 4, 9])
def test_batches_give_the_single_batch_result(spark, n):
    arr = publish_in_time_order(spark, sc.events_records(spark, SF_SMALL), n)
    run = run_per_batch(spark, arr, small_settings(), one_run=True)
    data_batches = [p for p in run.progress if p["numInputRows"] > 0]
    assert arr.n_batches == len(data_batches) == n
    assert sum(p["numInputRows"] for p in data_batches) == 1000
    assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in run.progress)
    # State never holds the whole backlog.
    assert n == 1 or max(p["stateOperators"][0]["numRowsTotal"] for p in run.progress) < 2500 / n
    assert len(keys_out(spark, run.sink)) == 999


def test_one_time_on_most_records(spark):
    records = fixture_records(spark, [[(i, 50) for i in range(40)] + [(100 + i, i) for i in range(9)]])
    arr = publish_in_time_order(spark, records, 5)
    assert arr.topic.read().count() == 49 and BASE > 0
    run = run_per_batch(spark, arr, small_settings(), one_run=True)
    assert keys_out(spark, run.sink) == list(range(100, 109))


def test_no_shuffle_and_the_time_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    records = sc.events_records(spark, SF_SMALL)
    bound = F.timestamp_micros(F.lit(1_704_100_000_000_000))
    plan = records.where(F.col("timestamp") > bound)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThan(ts" in plan
