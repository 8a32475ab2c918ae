"""Physical plans: pruning, pushdown, partial aggregation, top-k."""

import re

from conftest import SF_SMALL

from tidemark.plans import catalog
from tidemark.plans import scenarios as sc
from tidemark.streaming.flow import count_per_key


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_count_is_partial_then_final(spark):
    p = plan(catalog.group_count_wide(spark, SF_SMALL))
    assert "partial_count" in p and "Exchange hashpartitioning" in p
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_returnflag:string,l_shipdate", p) or \
        "ReadSchema: struct<l_suppkey" in p


def test_projection_reaches_the_scan(spark):
    p = plan(catalog.project_envelope(spark, SF_SMALL))
    m = re.search(r"ReadSchema: struct<([^>]*)>", p)
    assert m and set(x.split(":")[0] for x in m.group(1).split(",")) == {"event_id", "ts"}


def test_top20_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(catalog.top20(spark, SF_SMALL))


def test_sink_read_prunes_to_key(spark):
    p = plan(catalog.decode_key(spark, SF_SMALL))
    m = re.search(r"ReadSchema: struct<([^>]*)>", p)
    assert m and m.group(1) == "key:binary"


def test_stream_plan_is_watermarked_partial_aggregate(spark):
    from tidemark.sources.topic import FileTopic
    from tidemark.session import run_dir

    topic = FileTopic(spark, f"{run_dir(spark, 'plan')}/topic")
    topic.publish(sc.events_records(spark, SF_SMALL))
    counted = count_per_key(topic.read_stream())
    assert counted.isStreaming
    logical = counted._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in logical and "20 seconds" in logical


def test_audit_is_one_shuffle_without_join(spark):
    p = plan(catalog.audit_missing(spark, SF_SMALL))
    assert "Join" not in p and "BroadcastExchange" not in p
    assert p.count("Exchange hashpartitioning") == 1


def test_sort_with_a_hot_value_is_split_over_ranges(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.order import sorted_by
    from tidemark.streaming.flow import session_conf

    # A third of the rows share one id: the tiebreak spreads them. (AQE
    # would merge these small ranges, so it is off for the measurement.)
    df = spark.range(0, 30000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("v"),
        F.col("id").alias("row"),
    )
    with session_conf(spark, {"spark.sql.adaptive.enabled": "false"}):
        for tie, hot in ((["row"], False), ([], True)):
            out = sorted_by(df, "v", tie)
            sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert (max(r["count"] for r in sizes) >= 10000) == hot
        vals = [r.v for r in sorted_by(df, "v", ["row"]).collect()]
    assert vals[:10000] == [None] * 10000 and vals[10000:] == sorted(vals[10000:])


def test_streamed_table_scan_is_pruned(spark):
    import contextlib
    import io

    from tidemark.session import run_dir
    from tidemark.streaming.flow import session_conf, start_parquet_sink

    root = run_dir(spark, "plan-stream")
    # Without the closing no-data batch the last plan is the data batch's.
    with session_conf(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": "false",
                              "spark.sql.shuffle.partitions": "2"}):
        q = start_parquet_sink(
            count_per_key(sc.events_records(spark, SF_SMALL, stream=True)),
            f"{root}/sink", f"{root}/ck", "plan_stream",
        )
        try:
            q.processAllAvailable()
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                q.explain()
        finally:
            q.stop()
    scan = [line for line in buf.getvalue().splitlines() if "FileScan parquet" in line]
    assert scan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in scan[0]
