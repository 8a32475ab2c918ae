"""Flow pieces: settings scope, idempotent update batches, watermark agreement."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.plans import scenarios as sc
from tidemark.session import run_dir
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import _write_update_batch, session_conf


def test_session_conf_is_restored(spark):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    with session_conf(spark, {key: "false", "tidemark.test.flag": "1"}):
        assert spark.conf.get(key) == "false"
        assert spark.conf.get("tidemark.test.flag") == "1"
    assert spark.conf.get(key) == before
    assert spark.conf.get("tidemark.test.flag", None) is None


def test_update_batches_are_idempotent(spark):
    sink = f"{run_dir(spark, 'update')}/sink"
    write = _write_update_batch(sink)
    batch = spark.range(5).select(F.col("id").alias("k"))
    write(batch, 3)
    write(batch, 3)  # the same batch again, as after a failure
    write(batch.limit(2), 4)
    out = spark.read.parquet(sink)
    assert out.where("batch_id = 3").count() == 5
    assert out.count() == 7


def test_engine_and_data_agree_on_the_final_watermark(spark):
    run = sc.single_run(spark, SF_SMALL)
    sent = sc.events_records(spark, SF_SMALL)
    derived = sent.select(audit.expected_watermark(sent, "20 seconds").alias("wm"))
    reported = derived.select(
        (F.col("wm") == audit.watermark_at(run.final_watermark_ms)).alias("same")
    ).first()
    assert reported.same is True


def test_parquet_sink_rejects_update_mode(spark):
    import pytest
    from pyspark.errors import AnalysisException

    from tidemark.streaming.flow import count_per_key

    root = run_dir(spark, "update-reject")
    topic = FileTopic(spark, f"{root}/topic")
    topic.publish(sc.events_records(spark, SF_SMALL))
    counted = count_per_key(topic.read_stream())
    with pytest.raises(AnalysisException, match="(?i)output mode|update"):
        q = (
            counted.writeStream.format("parquet").outputMode("update")
            .option("path", f"{root}/sink").option("checkpointLocation", f"{root}/ck")
            .start()
        )
        q.stop()


def test_progress_of_every_batch_is_kept(spark):
    from helpers import fixture_records

    from tidemark.streaming.flow import StreamSettings
    from tidemark.streaming.replay import run_arrivals

    batches = [[(i, i)] for i in range(3)]
    short = run_arrivals(spark, fixture_records(spark, batches), "batch", 3,
                         StreamSettings(state_partitions=1, progress_retention=2))
    full = run_arrivals(spark, fixture_records(spark, batches), "batch", 3,
                        StreamSettings(state_partitions=1))
    assert len(short.progress) < 4 and len(full.progress) == 4


def test_registered_runs_do_not_inherit_the_semantic_switches(spark):
    off = {
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.streaming.statefulOperator.allowMultiple": "false",
    }
    with session_conf(spark, off):
        s = sc.default_settings(spark)
    assert s.allow_multiple is True and s.no_data_batches is True
    c = s.conf()
    assert c["spark.sql.streaming.noDataMicroBatches.enabled"] == "true"
    assert c["spark.sql.streaming.statefulOperator.allowMultiple"] == "true"
    assert sc.default_settings(spark, no_data_batches=False).no_data_batches is False


def test_await_query_bounds_the_wait_only_when_asked():
    import pytest

    from tidemark.streaming.flow import await_query

    class Slow:
        name, isActive, recentProgress = "slow", True, []

        def awaitTermination(self, timeout=None):
            return None if timeout is None else False

        def exception(self):
            return None

        def stop(self):
            self.isActive = False

    q = Slow()
    with pytest.raises(TimeoutError):
        await_query(q, 0.1)
    assert q.isActive is False  # stopped on the way out
    assert await_query(Slow(), None) == []
