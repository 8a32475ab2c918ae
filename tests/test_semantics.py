"""Exact watermark semantics on hand-built arrivals (FIXTURES.md)."""

from helpers import BASE, fixture_records, keys_out, small_settings

from tidemark.streaming.progress import iso_to_millis

from tidemark.streaming.replay import run_arrivals, run_per_arrival

# Delay 20 s, one file per batch, event seconds.
BOUNDARY = [
    [(0, 0), (1, 10), (2, 30)],
    [(3, 9), (4, 10), (5, 11), (6, 31)],
    [(7, 10), (8, 11), (9, 12), (10, 60)],
    [(11, 200)],
]


def test_boundary_default_one_batch_behind(spark):
    # Late watermark lags one batch (allowMultiple=true): 3, 4 and 5 arrive
    # one batch late but are kept; 7 is at the late watermark (inclusive) and
    # dropped; 11 is within the delay of the maximum and stays in state.
    run = run_arrivals(spark, fixture_records(spark, BOUNDARY), "batch", 4, small_settings())
    assert keys_out(spark, run.sink) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_boundary_allow_multiple_off(spark):
    run = run_arrivals(
        spark,
        fixture_records(spark, BOUNDARY),
        "batch",
        4,
        small_settings(allow_multiple=False),
    )
    assert keys_out(spark, run.sink) == [0, 1, 2, 5, 6, 9, 10]


def test_boundary_one_run_per_file(spark):
    run = run_per_arrival(spark, fixture_records(spark, BOUNDARY), "batch", 4, small_settings())
    assert keys_out(spark, run.sink) == [0, 1, 2, 5, 6, 9, 10]


def test_no_data_batches_off_single_batch_emits_nothing(spark):
    batches = [[(0, 0), (1, 10), (2, 100)]]
    run = run_arrivals(
        spark, fixture_records(spark, batches), "batch", 1, small_settings(no_data_batches=False)
    )
    assert keys_out(spark, run.sink) == []
    run = run_arrivals(spark, fixture_records(spark, batches), "batch", 1, small_settings())
    assert keys_out(spark, run.sink) == [0, 1]


def test_inclusive_edges_around_ten_second_watermark(spark):
    # Batch 0 moves the watermark to 30 - 20 = 10 s. In batch 1 rows at 9, 10
    # and 11 s are kept (late watermark still at epoch); 9 and 10 are at or
    # below the eviction watermark and come out, 11 waits for the final
    # no-data batch (watermark 11 s: 31 - 20).
    batches = [[(0, 30)], [(1, 9), (2, 10), (3, 11), (4, 31)]]
    run = run_arrivals(spark, fixture_records(spark, batches), "batch", 2, small_settings())
    assert keys_out(spark, run.sink) == [1, 2, 3]
    marks = [iso_to_millis(p["eventTime"].get("watermark")) for p in run.progress]
    assert marks == [0, (BASE + 10) * 1000, (BASE + 11) * 1000]
    assert run.final_watermark_ms == (BASE + 11) * 1000


def test_record_at_the_epoch_is_always_dropped(spark):
    # The first late watermark is the epoch and the drop is inclusive, so a
    # record stamped 1970-01-01T00:00:00 never comes out.
    batches = [[(0, 0), (1, 5), (2, 100)]]
    run = run_arrivals(
        spark, fixture_records(spark, batches, base=0), "batch", 1, small_settings()
    )
    assert keys_out(spark, run.sink) == [1]
    assert run.progress[0]["stateOperators"][0]["numRowsDroppedByWatermark"] == 1


def test_in_memory_state_store_gives_the_same_rows(spark):
    run = run_arrivals(
        spark, fixture_records(spark, BOUNDARY), "batch", 4, small_settings(state_store="hdfs")
    )
    assert keys_out(spark, run.sink) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_dropped_metric_counts_groups_the_audit_counts_records(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import audit
    from tidemark.sources.topic import FileTopic

    # Three copies of one record arrive two batches late: all three are
    # dropped, but the engine's metric counts them after partial
    # aggregation, as one row.
    batches = [[(0, 100)], [(1, 101)], [(5, 10), (5, 10), (5, 10), (2, 102)]]
    run = run_arrivals(spark, fixture_records(spark, batches), "batch", 3, small_settings())
    dropped = [p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in run.progress]
    assert dropped[2] == 1
    rec = audit.reconcile(FileTopic(spark, run.topic).read(), spark.read.parquet(run.sink))
    miss = audit.missing(rec, audit.watermark_at(run.final_watermark_ms)).where(F.col("id") == 5)
    assert [(r.n_missing, r.reason) for r in miss.collect()] == [(3, "late")]
