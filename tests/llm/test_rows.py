"""Tables that each job reads in other partitions, as when executors come or go."""

import itertools

import pytest
from llm import brute
from llm.helpers import documents
from llm.test_quotes import linked

import corpus_pipeline
from tidemark.llm import exact, near, quotes, repeats, util

PARTS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def restless(spark, monkeypatch):
    """After each stored table a scan has either one partition or one a file."""
    turn, keep = itertools.cycle(["1", "64"]), util.saved

    def saved(df, label):
        out = keep(df, label)
        spark.conf.set(PARTS, next(turn))
        return out

    for module in (util, exact, near, quotes, repeats):
        monkeypatch.setattr(module, "saved", saved)
    yield spark
    spark.conf.unset(PARTS)


def texts():
    words = [f"{k} " + " ".join(f"w{(k * 37 + i * i) % 997}" for i in range(90)) for k in range(12)]
    return [t + end for t in words for end in ("", " end")] + words[:5]


def test_repeats(restless):
    docs = documents(restless, texts())
    got = {r["id"]: sum(s["hi"] - s["lo"] for s in r["removed"]) for r in repeats.without_repeats(docs, 200).collect()}
    assert got == dict(enumerate(x[0] for x in brute.removed(texts(), 200)))


@pytest.mark.parametrize("stage, kept", [("exact", 24), ("near", 12)])
def test_stages(restless, stage, kept):
    docs = documents(restless, texts())
    out = getattr(corpus_pipeline, stage)(restless, docs, None).select("doc_id").collect()
    assert sorted(r[0] for r in out) == list(range(0, 24, 24 // kept))


def test_colliding_chunks(restless):
    docs = documents(restless, ["one", "two", "one", "three", "two", "four", "one", "five"])
    out = exact.exact_dedup(docs, chunk_hash=lambda c: util.F.lit(1).cast("long")).where("kept").collect()
    assert sorted(r["id"] for r in out) == [0, 1, 3, 5, 7]


def test_quotes(restless):
    rows = [(c, t, "u", f"Message {c} says this.") for c in range(8) for t in (0,)]
    rows += [(c, 1, "u", f"> Message {c} says this.\nAn answer.") for c in range(8)]
    got, _ = linked(restless, rows)
    assert all(got[c, 1][0] == (c, 0) and got[c, 1][3] == "An answer." for c in range(8))
