import collections
import zlib

import pytest
from llm.helpers import documents

from tidemark.llm.catalog import op5_balanced_shards
from tidemark.llm.sharding import shard_documents

SF = "/root/testdata/sf0.001"


def check(rows, shards):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    n = [len(slots.get(s, ())) for s in range(shards)]
    assert max(n) - min(n) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def spread(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        if r["grp"] is not None:
            groups[r["grp"]].append(r["shard"])
    return [len(set(g)) for g in groups.values() if len(g) > 1]


def test_query(spark):
    rows = op5_balanced_shards(spark, SF).collect()
    check(rows, 40)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "rows")


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_edge_rows(spark, shards):
    texts = [None, None, "", "", "a", "a", "b", "c"] + ["hot"] * 40 + [f"t{i}" for i in range(30)]
    ids = [None, 1, 1, 1] + list(range(4, len(texts)))
    rows = shard_documents(documents(spark, texts, ids=ids), shards).collect()
    assert len(rows) == len(texts)
    check(rows, shards)
    assert sum(r["grp"] is None and r["size"] == 16 for r in rows) == 2


def test_copies_come_together(spark):
    texts = [f"pair {i // 2}" for i in range(200)] + [f"single {i}" for i in range(400)]
    rows = shard_documents(documents(spark, texts), 10).collect()
    check(rows, 10)
    assert sum(n > 1 for n in spread(rows)) <= 10  # of 100 pairs; 90 are parted when dealt by hash


def test_large_group_fills_few_shards(spark):
    texts = ["hot"] * 300 + [f"single {i}" for i in range(700)]
    rows = shard_documents(documents(spark, texts), 10).collect()
    check(rows, 10)
    assert spread(rows)[0] <= 6


def test_empty(spark):
    assert shard_documents(documents(spark, ["a"]).where("false"), 4).count() == 0


def test_large_group_fills_many_shards(spark):
    texts = ["hot"] * 800 + [f"single {i}" for i in range(1600)]
    rows = shard_documents(documents(spark, texts), 40).collect()
    check(rows, 40)
    assert spread(rows)[0] <= 20  # it fills 14; six rounds left it in all 40
