import collections
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm.helpers import documents
from tokenizers import Tokenizer

from tidemark.llm.catalog import op10_best_fit_packing
from tidemark.llm.packing import Capacity, WordEncoder, best_fit, plan

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def bins(runs, histogram):
    """Sequence -> [(offset, length)] of a plan."""
    out = collections.defaultdict(list)
    by = collections.defaultdict(list)
    for length, rank, seq, offset in sorted(runs):
        by[length].append((rank, seq, offset))
    for length, n in histogram.items():
        for k in range(n):
            rank, seq, offset = [r for r in by[length] if r[0] <= k][-1]
            out[seq + k - rank].append((offset, length))
    return out


def sound(packed, capacity):
    for content in packed.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(content) <= capacity.documents
        assert sum(n * n for _, n in content) <= capacity.attention
    assert sorted(packed) == list(range(len(packed)))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents_, attention", [(4096, 4096.0**2), (3, 4096.0**2), (50, 9e6)])
def test_every_constraint_holds(rule, documents_, attention):
    rng = random.Random(1)
    for n in (1, 10, 400):
        histogram = collections.Counter(min(3000, 1 + int(rng.expovariate(1 / 500))) for _ in range(n))
        capacity = Capacity(4096, documents_, attention, rule)
        packed = bins(plan(dict(histogram), capacity), histogram)
        assert sum(map(len, packed.values())) == n
        sound(packed, capacity)


def test_few_sequences():
    rng = np.random.default_rng(0)
    histogram = collections.Counter(np.minimum(4096, rng.lognormal(6.5, 1, 20_000).astype(int) + 1).tolist())
    packed = bins(plan(dict(histogram), Capacity(weights=(1, 1e-4, 1e-4))), histogram)
    least = -(-sum(k * n for k, n in histogram.items()) // 4096)
    assert len(packed) <= 1.01 * least


def test_too_large_a_piece():
    with pytest.raises(ValueError):
        plan({100: 1}, Capacity(tokens=4096, attention=99.0**2))


def check(spark, docs, texts, rows, capacity=4096):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter()
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert collections.Counter(tuple(r[:5]) for r in rows) == want
    packed = collections.defaultdict(list)
    for r in rows:
        packed[r[5]].append((r[6], r[3]))
    sound(packed, Capacity(tokens=capacity))
    return len(packed)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in op10_best_fit_packing(spark, SF).collect()]
    n = check(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()], rows)
    assert n <= -(-sum(r[3] for r in rows) // 4096) + 1


def test_edge_rows(spark):
    texts = [
        None, "", " \n\t", "<|endoftext|> and<|startoftext|>x", "don't we'll 123 4,5 ÀÉ ΑΣ ſ ﬁ", "a b" * 3, "a b" * 3,
        "word " * 9_000, "\x1c\x85 odd spaces​", "é " * 20, "😀👍🏽 文字",
    ]
    ids = [None, 1, 2, 3, 4, 5, 5, 7, 8, 9, 10]
    docs = documents(spark, texts, ids=ids)
    out = best_fit(docs, VOCABULARY, Capacity(tokens=64, documents=64, attention=64.0**2))
    rows = [
        tuple(r)
        for r in out.select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    ]
    check(spark, docs, list(zip(ids, texts)), rows, 64)
    assert best_fit(docs.where("false"), VOCABULARY).count() == 0


def test_words_are_encoded_as_in_their_text():
    encoder = WordEncoder(VOCABULARY, 1)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for text in ["It's 12 o'clock -- isn't it?", "foo\x0bbar\x0cbaz", "İstanbul ŞİŞ", "x" * 500, "a\x1cb \x85c\xa0d x²y ½³¹ ªº µM ÀÉßÿ×÷ 'sat don't'll '' 've1",
                 "<|endoftext|>a", "</w> a</w>b", "ABC İabc", "".join(map(chr, range(1, 256)))]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert encoder.encode([text]) == [struct.pack(f"<{len(ids)}I", *ids)]


def test_ids_are_returned(spark):
    out = best_fit(documents(spark, ["some words", None]), VOCABULARY, keep_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in out)


def test_ids_kept_by_a_worker_are_bounded():
    """Workers live on after their stage: what they keep counts against the executor in the next."""
    encoder = WordEncoder(VOCABULARY, 1)
    texts = [" ".join(f"w{i:x}q" for i in range(lo, lo + 1000)) for lo in range(0, 220_000, 1000)]
    for at in range(0, len(texts), 20):
        encoder.encode(texts[at : at + 20])
        assert len(encoder.known) <= 200_000
    assert encoder.encode([texts[0]]) == WordEncoder(VOCABULARY, 1).encode([texts[0]])
