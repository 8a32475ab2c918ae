import hashlib
import random
from functools import partial

import numpy as np
import pytest
from llm import brute
from llm.helpers import documents

from tidemark.llm import repeats
from tidemark.llm.repeats import induce, without_repeats
from tidemark.llm.util import read

SF = "/root/testdata/sf0.001"


def check(spark, docs, texts, ids, length):
    got = without_repeats(docs, length).collect()
    rows = sorted(
        (str(r["id"]), r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["removed"]), len(r["removed"]), r["kept_sha256"])
        for r in got
    )
    want = sorted(
        (str(i), len((t or "").encode()), n, spans, hashlib.sha256(kept).hexdigest())
        for i, t, (n, spans, kept) in zip(ids, texts, brute.removed(texts, length))
    )
    assert rows == want
    return sum(r[2] for r in rows)


def test_whole_table(spark):
    docs = read(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    assert check(spark, docs, [r[1] for r in rows], [r[0] for r in rows], 200) > 1000


def woven(seed, n, alphabet):
    """Texts that share parts of all lengths, cut off and changed at all places."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(60, 400))) for _ in range(12)]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(pool)
            a = rng.randint(0, len(part) - 1)
            text += part[a : rng.randint(a + 1, len(part))]
            if rng.random() < 0.5:
                text += "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90)))
        texts.append(text)
    return texts


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop ", "xyé文 "])
def test_woven_texts(spark, alphabet):
    texts = woven(len(alphabet), 60, alphabet)
    assert check(spark, documents(spark, texts), texts, range(len(texts)), 100) > 0


def test_edge_rows(spark):
    p = "".join(chr(97 + (i * i * 7 + i // 26) % 26) for i in range(199))
    texts = [
        None, "", "a" * 199, "a" * 200, "b" * 201, p, p, p + "!", "0" + p + "!", "q" + p + "!",
        "ab" * 150, "ab" * 101, "x" + "tail " * 60, "tail " * 45, p + "#", p + "#",
    ]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 14]
    check(spark, documents(spark, texts, ids=ids), texts, ids, 200)
    assert without_repeats(documents(spark, texts).where("false")).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    # Pieces of 150 bytes: every text is cut many times.
    monkeypatch.setattr(repeats, "PIECE", 150)
    texts = woven(9, 30, "abcdef")
    check(spark, documents(spark, texts), texts, range(len(texts)), 100)


def test_one_common_anchor(spark):
    rng = random.Random(4)
    line = "the very same line of fifty characters everywhere."
    texts = ["".join(rng.choice("abcd ") for _ in range(120)) + line + "".join(rng.choice("abcd ") for _ in range(120)) for _ in range(80)]
    texts += [t[60:] for t in texts[:10]]
    assert check(spark, documents(spark, texts), texts, range(len(texts)), 100) > 0


def test_shards_larger_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 7)
    texts = woven(5, 50, "abc")
    check(spark, documents(spark, texts), texts, range(len(texts)), 100)


def test_induction_against_comparison():
    rng = random.Random(2)
    length = 24
    for _ in range(30):
        items = []
        for _ in range(rng.randint(1, 40)):
            key = rng.randint(0, 2)
            suffix = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) * rng.randint(1, 12)
            before = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
            items.append((key, suffix[:length], before))
        items.sort(key=lambda x: x[:2])
        keys = np.array([k for k, _, _ in items])
        found = induce(keys, [s for _, s, _ in items], [b for _, _, b in items], length)
        for i, (key, suffix, before) in enumerate(items):
            for t in range(len(before) + 1):
                whole = (before[len(before) - t :] + suffix)[:length]
                want = len(whole) == length and any(
                    j != i and k == key and len(b) >= t and (b[len(b) - t :] + s)[:length] == whole
                    for j, (k, s, b) in enumerate(items)
                )
                assert found[i, t] == want


def shared_passage(n, size):
    """Texts around one passage, each with surroundings of its own."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(size))
    own = lambda: "".join(rng.choice("ijklmnop ") for _ in range(150))
    return [own() + passage[rng.randint(0, 9) :] + own() for _ in range(n)]


@pytest.mark.parametrize("size", [190, 330])
def test_hot_key_is_deepened(spark, monkeypatch, size):
    most, sorted_rows = 20, []
    induced = repeats._induced_spans

    def spied(tuples, length):
        sorted_rows.append(tuples.groupBy("key").count().agg({"count": "max"}).first()[0] or 0)
        return induced(tuples, length)

    monkeypatch.setattr(repeats, "_induced_spans", spied)
    monkeypatch.setattr(repeats, "repeated_spans", partial(repeats.repeated_spans, most=most))
    texts = shared_passage(90, size) + woven(4, 20, "abcdefgh ")
    check(spark, documents(spark, texts), texts, range(len(texts)), 200)
    # Some key was too long, and none that was sorted is.
    assert len(sorted_rows) > 1 and max(sorted_rows) <= most


def test_woven_texts_with_deepened_keys(spark, monkeypatch):
    monkeypatch.setattr(repeats, "repeated_spans", partial(repeats.repeated_spans, most=2))
    texts = woven(6, 60, "xyé文 ")
    assert check(spark, documents(spark, texts), texts, range(len(texts)), 100) > 0
