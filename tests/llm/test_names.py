"""Columns of the input with the names that operators use themselves."""

import pytest
from llm.helpers import documents
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact, mixing, near, packing, quality, quotes, repeats, rules, secrets, sharding, vectors
from tidemark.llm.catalog import PACKING, public_tokenizers

NAMES = """
row row_number row_number_ __row __path __size __words __spans __parent __root __depth __linked __clean id_ key node
group bucket left right a b n hub least family met file signature n_shingles shingles hash recipe sha256 at chunk shard
slot grp size src pass block words first taken anchor hi lo start windows lead copies suffix before reach spans removed
piece length offset sequence_id ids tile code score label kept component component_id path parent root depth linked clean
""".split()
TEXTS = [f"{k} " + " ".join(f"w{(k * 37 + i * i) % 997}" for i in range(90)) + end for k in range(4) for end in ("", " x")]
TEXTS += [TEXTS[0], None, ""]


def clashing(df):
    taken = {c.lower() for c in df.columns}
    more = [n for n in dict.fromkeys(NAMES) if n.lower() not in taken]
    upper = [n.upper() if k % 2 else n for k, n in enumerate(more)]
    return df.select("*", *[F.lit(0).alias(n) for n in upper])


OPERATORS = {
    "secrets": secrets.scan_secrets,
    "repeats": repeats.without_repeats,
    "near": near.near_dedup,
    "exact": exact.exact_dedup,
    "exact-collide": lambda d: exact.exact_dedup(d, chunk_hash=lambda c: F.lit(1).cast("long")),
    "shards": lambda d: sharding.shard_documents(d, shards=3),
    "mix": lambda d: mixing.mix(d)[0].drop("row"),
    "pack": lambda d: packing.best_fit(d, public_tokenizers.path("word_bpe_49k.json"), PACKING).select("id", "piece", "ids_crc32"),
    "rules": rules.judge,
}


@pytest.fixture(scope="module")
def plain(spark):
    return documents(spark, TEXTS).select("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(plain, name):
    apply = OPERATORS[name]
    got, want = apply(clashing(plain)), apply(plain)
    columns = [c for c in want.columns if c != "row"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


@pytest.mark.parametrize("stage", ["exact", "near", "mixed"])
def test_stages(spark, plain, stage):
    apply = getattr(corpus_pipeline, stage)
    want = sorted(map(tuple, apply(spark, plain, None).collect()))
    got = apply(spark, clashing(plain), None)
    assert got.columns == clashing(plain).columns
    assert sorted(map(tuple, got.select(plain.columns).collect())) == want


def test_quotes(spark):
    rows = [(c, 0, "u", f"Message {c} says this.") for c in range(3)] + [(0, 1, "u", "> Message 0 says this.\nYes.")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    columns = ["given.conv_id", "given.turn", "depth", "linked", "clean"]
    got, want = (sorted(map(tuple, quotes.link_quotes(t).select(columns).collect())) for t in (clashing(table), table))
    assert got == want and max(r[2] for r in got) == 1


def test_vectors(spark):
    table = spark.createDataFrame([(k, [1.0, k / 9]) for k in range(5)], "vec_id long, embedding array<double>")
    got, want = (sorted(map(tuple, vectors.near_vectors(t, least=0.999).collect())) for t in (clashing(table), table))
    assert got == want


def test_quality(spark, plain):
    model = quality.fit(plain, plain.select(F.col("doc_id").alias("id")).limit(4))
    got, want = (sorted(map(tuple, quality.score_quality(t, model).collect())) for t in (clashing(plain), plain))
    assert got == want
