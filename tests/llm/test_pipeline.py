import collections
import gc
import re

import public_tokenizers
import pyarrow as pa
import pytest
from llm import brute

import __spark_entry__
import corpus_pipeline
from tidemark.llm.catalog import QUERIES, quality_model
from tidemark.llm.near import Params, _Words, signatures
from tidemark.llm.packing import WordEncoder, pieces
from tidemark.llm.quality import features, score, scored_rows
from tidemark.llm.util import numbered, read, saved

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, as rows."""
    docs = read(spark, SF, "documents")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = saved(stage(spark, docs, SF), "test-stage")
        if k < 4:
            assert after.columns == read(spark, SF, "documents").columns
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_rejected_texts_go(spark, stages):
    before, after = stages[0]
    model = quality_model(read(spark, SF, "documents"), read(spark, SF, "labels"))
    kept = [r for r in before if score(model, features(r["text"])[None])[0] >= 0.5]
    assert sorted(map(tuple, after)) == sorted(map(tuple, kept))
    good = {r["doc_id"] for r in read(spark, SF, "labels").where("quality = 1").collect()}
    good &= {r["doc_id"] for r in before}
    # Some 50 trusted texts are all that these 200 rows give; see test_quality for more.
    assert len(good & {r["doc_id"] for r in after}) >= 0.95 * len(good)


def test_one_of_each_text_stays(stages):
    before, after = stages[1]
    least = {}
    for r in before:
        norm = re.sub("[\x20\x09-\x0d]+", " ", r["text"])
        least[norm] = min(least.get(norm, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    sets = [brute.shingles(r["text"], 5) for r in before]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if brute.similar(sets[i], sets[j], 80)]
    comp = brute.components(len(sets), links)
    least = {}
    for r, c in zip(before, comp):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())


def words(text):
    return len(text.encode().split())


def test_the_mix_takes_its_targets(stages):
    before, after = stages[3]
    size, got = collections.Counter(), collections.Counter()
    texts = {}
    for r in before:
        size[r["source"]] += words(r["text"])
        texts[r["doc_id"]] = r
    for r in after:
        got[r["source"]] += words(r["text"])
        whole = texts[r["doc_id"]]
        assert r["text"] == whole["text"] or set(r["text"].split()) <= set(whole["text"].split())
        assert r["n_chars"] == len(r["text"])
    order = sorted(size)
    for source, target in zip(order, brute.targets([size[s] for s in order])):
        assert abs(got[source] - target) <= 1


def test_all_is_packed(stages):
    before, after = stages[4]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert sum(r["piece"] == 0 for r in after) == len(before)
    fill = collections.defaultdict(list)
    for r in after:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in fill.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("most, join", [("16k", "BroadcastHashJoin"), ("-1", "SortMergeJoin")])
def test_documents_stay_in_place_where_few_go(spark, most, join):
    docs = numbered(spark.range(20_000).selectExpr("id doc_id", "repeat('word ', 20) text"))
    judged = docs.selectExpr(f"{docs.row_column} row", "doc_id % 1000 <> 7 kept")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        out = corpus_pipeline._kept_rows(docs, judged)
        plan = out._jdf.queryExecution().executedPlan().toString()
        kept = [r["doc_id"] for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert join in plan and ("hashpartitioning" in plan) == (join == "SortMergeJoin"), plan
    assert out.columns == ["doc_id", "text"]
    assert sorted(kept) == [i for i in range(20_000) if i % 1000 != 7]


@pytest.mark.parametrize("share", ["true", "false"])
def test_all_or_none_may_go(spark, share):
    docs = numbered(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"))
    judged = docs.selectExpr(f"{docs.row_column} row", f"{share} kept")
    got = corpus_pipeline._kept_rows(docs, judged).collect()
    assert sorted(map(tuple, got), key=str) == ([(1, "a"), (1, "a"), (None, None)] if share == "true" else [])


def test_workers_do_not_keep_what_earlier_stages_used(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id long, text string")
    told, given = [], pa.RecordBatch.from_pylist(
        [{"row": r["doc_id"], "id": r["doc_id"], "text": r["text"]} for r in docs.collect()]
    )
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema: told.append(fn))
    pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    signatures(docs, Params(), "doc_id", "text")
    scored_rows(docs, None)
    cut, sign, scored = told

    def kept(kind):
        gc.collect()
        return sum(isinstance(o, kind) for o in gc.get_objects())

    # As in a worker that runs a task of each stage, then a task of one of them again.
    first = list(cut([given, given]))
    assert kept(WordEncoder) == 1
    assert list(cut([given, given])) == first and kept(WordEncoder) == 1
    signed = list(sign([given]))
    assert kept(WordEncoder) == 0 and kept(_Words) == 1
    assert list(scored([given.select(["id", "text"])]))[0].num_rows == 2
    assert kept(_Words) == 0
    assert list(cut([given, given])) == first and list(sign([given])) == signed


def test_registered(spark):
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_nothing_else_imports_this_part():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for path in [*root.glob("tidemark/**/*.py"), *root.glob("tests/*.py"), *root.glob("tools/*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"tidemark\.llm|corpus_pipeline", path.read_text()), path
