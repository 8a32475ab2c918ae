import math
import random

import pytest
from llm import brute
from llm.helpers import documents

from tidemark.llm.components import components
from tidemark.llm.near import Params, Shingler, near_dedup
from tidemark.llm.util import read, saved

SF = "/root/testdata/sf0.001"


def check(docs, texts, ids, params):
    sets = [brute.shingles(t, params.words) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if brute.similar(sets[i], sets[j], params.percent)]
    comp = brute.components(len(sets), links)
    least = {}
    for i, c in enumerate(comp):
        least[c] = min((x for x in (ids[i], least.get(c)) if x is not None), default=None)
    want = sorted((str(ids[i]), len(sets[i]), str(least[comp[i]])) for i in range(len(sets)))
    out = near_dedup(docs, params).collect()
    assert sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in out) == want
    assert sum(r["kept"] for r in out) == len(set(comp))
    return len(links)


@pytest.mark.parametrize("words", [4, 5])
def test_whole_table(spark, words):
    docs = read(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    assert check(docs, [r[1] for r in rows], [r[0] for r in rows], Params(words=words))


def drifting(seed, n, step):
    """A text that changes by ``step`` words at a time: neighbours are similar, ends are not."""
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    texts = []
    for _ in range(n):
        texts.append(" ".join(words))
        for _ in range(step):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 5000)}"
    return texts


def test_chains_join(spark):
    texts = drifting(1, 25, 1) + drifting(2, 25, 2) + drifting(3, 12, 3) + drifting(4, 10, 6)
    random.Random(0).shuffle(texts)
    assert check(documents(spark, texts), texts, list(range(len(texts))), Params(words=4)) > 40


def test_edge_rows(spark):
    long = " ".join(str(i) for i in range(60_000))
    texts = [
        None, "", " \n\t", "one two", "ONE\ttwo", "one two three", "Émile", "émile", long, long + " end", "one two",
        "a b c d e f g h", "a b c d e f g h",
    ]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]
    check(documents(spark, texts, ids=ids), texts, ids, Params(words=4))
    assert near_dedup(documents(spark, texts).where("false")).count() == 0


def test_shingle_sets():
    cut = Shingler(4)
    for text in [None, "", "a", "a b c", "a b c d", "a a a a a a", "b A c D e f " * 50]:
        assert len(cut(text)) == len(brute.shingles(text, 4))
    assert cut("A b\tC d").tolist() == cut("a B c  D").tolist()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7), (3, 2), (2, 3)]
    rng.shuffle(edges)
    table = saved(spark.createDataFrame(edges, "a long, b long"), "test-links")
    want = brute.components(301, edges)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["component"] for r in components(table).collect()} == {x: want[x] for x in linked}
    assert components(table.where("false")).count() == 0


def test_chance_to_miss_a_borderline_pair():
    p = Params()
    s = p.percent / 100
    missed = sum(math.comb(p.coordinates, k) * s**k * (1 - s) ** (p.coordinates - k) for k in range(p.matches))
    assert missed < 2e-9
