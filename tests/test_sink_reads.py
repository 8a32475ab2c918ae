"""S5 and A2 behaviours the audit relies on."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from tidemark.operators.aggregate import latest
from tidemark.plans import scenarios as sc
from tidemark.sources.tables import scan_parquet
from tidemark.streaming.flow import StreamSettings
from tidemark.streaming.replay import run_single_batch


def test_files_outside_the_commit_log_stay_invisible(spark):
    run = run_single_batch(
        spark, sc.events_records(spark, SF_SMALL), StreamSettings(state_partitions=2)
    )
    committed = scan_parquet(spark, run.sink).count()
    # A stray file in the sink directory, as a failed batch could leave.
    scan_parquet(spark, run.sink).limit(5).write.mode("append").parquet(run.sink)
    assert scan_parquet(spark, run.sink).count() == committed
    # A plain read of the files, bypassing the log, sees it.
    assert spark.read.parquet(f"{run.sink}/*.parquet").count() == committed + 5


def test_latest_on_empty_input_is_one_null_row(spark):
    empty = spark.range(0).select(F.current_timestamp().alias("timestamp"))
    rows = latest(empty).collect()
    assert len(rows) == 1 and rows[0].latest is None


def test_stream_table_reads_a_folder_table_too(spark):
    from tidemark.session import run_dir
    from tidemark.sources.tables import stream_table
    from tidemark.streaming.flow import run_count

    # The same events, stored as a folder of part files.
    root = run_dir(spark, "folder-table")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(
        f"{root}/tables/events.parquet"
    )
    records = sc.events_records(spark, f"{root}/tables", stream=True)
    progress = run_count(spark, records, f"{root}/sink", f"{root}/ck",
                         StreamSettings(state_partitions=2))
    assert progress[0]["numInputRows"] == 1000
    assert stream_table(spark, SF_SMALL, "events").isStreaming
