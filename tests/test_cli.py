"""The command line: drain a file topic, then audit the sink."""

import json

import pytest
from conftest import SF_SMALL

from tidemark.__main__ import main
from tidemark.plans import scenarios as sc
from tidemark.session import run_dir
from tidemark.sources.topic import FileTopic


def test_drain_then_audit(spark, capsys, monkeypatch):
    root = run_dir(spark, "cli")
    FileTopic(spark, f"{root}/topic").publish(sc.events_records(spark, SF_SMALL))
    # The command stops its session at the end; keep the shared test session.
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    args = ["--topic", f"{root}/topic", "--sink", f"{root}/sink", "--state-partitions", "2"]
    assert main(["drain", *args]) == 0
    assert main(["audit", *args]) == 0
    drained, audited = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert drained == {"batches": 2, "input_rows": 1000}
    assert audited["sent"] == 1000 and audited["persisted"] == 999
    assert audited["missing_withheld"] == 1 and audited["missing_late"] == 0


def test_publish_consume_and_roundtrip(spark, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    root = run_dir(spark, "cli-pub")
    topic = ["--topic", f"{root}/topic"]
    assert main(["publish", *topic, "--table", f"{SF_SMALL}/orders.parquet", "--form", "pair",
                 "--id-col", "o_orderkey", "--time-col", "o_orderdate",
                 "--key-col", "o_orderkey", "--value-col", "o_custkey"]) == 0
    assert main(["consume", *topic, "--expect", "1000"]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    n = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    assert got["received"] == n and got["distinct_keys"] == n and got["ok"] is True
    for sent, ok in (("orders", True), ("lineitem", False)):
        assert main(["consume", *topic, "--sent", f"{SF_SMALL}/{sent}.parquet"]) == 0
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["ok"] is ok
    assert main(["roundtrip", "--path", f"{root}/range", "--n", "50"]) == 0
    assert spark.read.parquet(f"{root}/range").count() == 50


def test_ingest_runs_for_a_while_then_stops(spark, monkeypatch, capsys):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    root = run_dir(spark, "cli-ingest")
    FileTopic(spark, f"{root}/topic").publish(sc.events_records(spark, SF_SMALL))
    args = ["--topic", f"{root}/topic", "--sink", f"{root}/sink", "--state-partitions", "2"]
    # The trigger fires every 10 s; the second batch writes what the first has read.
    assert main(["ingest", *args, "--for", "25", "--poll", "--every", "2"]) == 0
    assert not spark.streams.active
    assert spark.read.parquet(f"{root}/sink").count() == 999
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert rows and rows[-1]["sent"] == 1000 and rows[-1]["missing_unread"] == 0
    assert main(["audit", *args, "--checkpoint", f"{root}/sink_checkpoint"]) == 0
    row = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (row["persisted"], row["missing_withheld"], row["missing_unread"]) == (999, 1, 0)


@pytest.mark.parametrize("flags", [
    ["consume", "--topic", "t"],
    ["publish", "--kafka", "b:1", "--table", "t", "--id-col", "i", "--time-col", "ts"],
])
def test_flags_that_would_promise_too_much(flags, capsys):
    with pytest.raises(SystemExit):
        main(flags)
    capsys.readouterr()


def test_kafka_flags_reach_the_source_options(spark):
    import argparse

    from tidemark.__main__ import _topic

    args = argparse.Namespace(
        kafka="b1:9092,b2:9092", topic=None, topic_name="t", starting_offsets="latest",
        isolation_level="read_committed", max_offsets_per_trigger=5000,
    )
    t = _topic(spark, args)
    assert t.source_options == {
        "starting_offsets": "latest", "isolation_level": "read_committed",
        "max_offsets_per_trigger": 5000,
    }
