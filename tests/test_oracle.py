"""Every registered query against its SQL statement (DuckDB), at sf0.001
(``TIDEMARK_ORACLE_SF=/root/testdata/sf0.01`` runs it at another scale)."""

import os
import sys
from pathlib import Path

import pytest
from conftest import SF_SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare  # noqa: E402

from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.plans.oracle import ORACLE_SQL as SQL  # noqa: E402


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


ORACLE_SF = os.environ.get("TIDEMARK_ORACLE_SF", SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    r = compare(spark, name, QUERIES[name], SQL[name], ORACLE_SF)
    assert r["ok"], r


@pytest.mark.parametrize(
    "conf",
    [
        {"tidemark.statePartitions": "1"},
        {"tidemark.statePartitions": "7", "tidemark.stateStore": "hdfs"},
        {"tidemark.backlogRowsPerBatch": "100", "spark.sql.files.maxPartitionBytes": "4096"},
    ],
)
@pytest.mark.parametrize("name", ["stream_append_multibatch", "stream_late_rows", "audit_missing"])
def test_settings_do_not_change_the_rows(spark, name, conf):
    plans = Path(__file__).resolve().parents[1] / "tidemark" / "plans"
    assert not any("backlog" in f.read_text() for f in plans.glob("*.py"))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        r = compare(spark, name, QUERIES[name], SQL[name], SF_SMALL)
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert r["ok"], r


def test_a_stream_query_runs_its_stream_at_every_call(spark, monkeypatch):
    from tidemark.plans import scenarios as sc

    runs = []
    run = sc.run_stream
    monkeypatch.setattr(sc, "run_stream", lambda *a, **k: runs.append(1) or run(*a, **k))
    for _ in range(2):
        QUERIES["stream_append_single"](spark, SF_SMALL)
    assert len(runs) == 2


def test_a_finished_run_is_not_taken_for_a_changed_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.where("event_id < 500").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["decode_key"](spark, str(tmp_path)).count() == 499
    events.where("event_id < 300").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["decode_key"](spark, str(tmp_path)).count() == 299


def test_progress_reports_each_batch(spark):
    df = QUERIES["stream_progress"](spark, SF_SMALL)
    rows = df.orderBy("batch_id").collect()
    assert [r.batch_id for r in rows] == list(range(7))  # six data batches + no-data
    assert sum(r.input_rows for r in rows) == 1000 and rows[-1].input_rows == 0
    assert rows[-1].state_rows == 1  # the newest record waits for newer data


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["partition", "timestamp", "key", "cnt"]
    assert df.count() == 999


def test_sorted_ids_are_in_numeric_order(spark):
    ids = [r.id for r in QUERIES["sorted_ids"](spark, SF_SMALL).collect()]
    assert ids == sorted(ids) and len(ids) == 999


def test_entry_loads_by_path_from_another_folder(tmp_path):
    import subprocess
    import sys as _sys

    entry_file = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    code = (
        "import importlib.util;"
        f"spec=importlib.util.spec_from_file_location('e', {str(entry_file)!r});"
        "m=importlib.util.module_from_spec(spec);spec.loader.exec_module(m);"
        "print(len(m.queries()), len(m.oracle_sql()))"
    )
    out = subprocess.run(
        [_sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120
    )
    sizes = [str(len(entry.queries())), str(len(entry.oracle_sql()))]
    assert out.stdout.split() == sizes, out.stderr[-2000:]


def test_every_query_named_in_the_survey_is_registered():
    named = {
        "stream_append_single", "range_roundtrip", "parquet_scan", "envelope_decode",
        "envelope_encode", "envelope_encode_pair", "project_envelope", "decode_key",
        "stream_late_rows", "group_count", "group_count_wide", "max_timestamp",
        "audit_summary", "mean_id", "audit_missing", "delivery_check", "sorted_ids", "top20",
        "stream_append_multibatch", "stream_update_foreachbatch", "stream_nodata_off",
        "stream_resume", "stream_progress",
    }
    assert named <= set(QUERIES), named - set(QUERIES)
