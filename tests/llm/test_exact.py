import hashlib
import random
import re

import duckdb
from llm.helpers import documents
from pyspark.sql import functions as F

from tidemark.llm.catalog import ORACLE_SQL, QUERIES
from tidemark.llm.exact import chunk_store, chunks, exact_dedup

SF = "/root/testdata/sf0.001"


def expected(rows):
    groups = {}
    for i, text in rows:
        norm = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        groups.setdefault(norm, []).append(i)
    return sorted(
        (i is None, i or 0, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(n.encode()).hexdigest())
        for n, g in groups.items()
        for i in g
    )


def got(out):
    return sorted(
        (r["id"] is None, r["id"] or 0, r["keep_id"], r["group_size"], r["text_sha256"]) for r in out.collect()
    )


TEXTS = [
    None, "", " ", "\t\n", "a  b", "a b", "a\tb", "a b ", "A b", " a b", "x" * 20_000, "x" * 20_000,
    "One. " * 5_000, "One. " * 5_000 + "!", "no stops " * 3_000, "no stops " * 3_000, "a b",
]


def test_groups_of_equal_texts(spark):
    ids = [None, 5, 9, 8, 3, 2, 2, 12, 13, 14, 21, 20, 30, 31, 41, 40, 50]
    docs = documents(spark, TEXTS, ids=ids)
    out = exact_dedup(docs)
    assert got(out) == expected(zip(ids, TEXTS))
    # One row stays of each group, of repeated rows too.
    assert out.where("kept").count() == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in TEXTS})
    assert out.where("kept AND id <> keep_id").count() == 0


def test_colliding_chunk_hashes_are_told_apart(spark):
    ids = list(range(len(TEXTS)))
    docs = documents(spark, TEXTS)
    for weak in (lambda c: F.lit(7).cast("long"), lambda c: F.length(c).cast("long")):
        out = exact_dedup(docs, chunk_hash=weak)
        assert got(out) == expected(zip(ids, TEXTS))


def test_hashes_and_ordinals_are_kept_apart(spark):
    # Every hash is 0 and so could be an ordinal: only their number tells these texts apart.
    part = "y" * 4096
    docs = documents(spark, [part, part * 2, part * 3, part * 2])
    out = exact_dedup(docs, chunk_hash=lambda c: F.lit(0).cast("long") * F.length(c))
    told = sorted((r["id"], r["group_size"], r["n_chunks"]) for r in out.collect())
    assert told == [(0, 1, 1), (1, 2, 2), (2, 1, 3), (3, 2, 2)]


def test_chunks_make_up_the_text_and_are_shared(spark):
    rng = random.Random(0)
    text = "".join(f"Sentence {i} {'x' * rng.randint(1, 40)}{rng.choice('abcdefghijklmnop')}. " for i in range(900))
    df = documents(spark, [text, "Another beginning, then the same. " + text])
    parts = [r[0] for r in df.select(chunks(F.col("text"))).collect()]
    assert ["".join(p) for p in parts] == [r["text"] for r in df.select("text").collect()]
    assert all(len(c) <= 4096 for p in parts for c in p)
    copies = chunk_store(df).select("copies").collect()
    assert len(parts[0]) > 20 and sum(r[0] > 1 for r in copies) >= min(map(len, parts)) - 4


def test_empty_table(spark):
    assert exact_dedup(documents(spark, ["a"]).where("false")).count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = QUERIES["op8_exact_dedup"](spark, SF)
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({ORACLE_SQL['op8_exact_dedup']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
