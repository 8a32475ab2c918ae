import random
import re
import string

import pytest
from llm import brute
from llm.helpers import documents

from tidemark.llm.secrets import ALLOW, THRESHOLDS, Scanner, entropy_windows, scan_secrets
from tidemark.llm.util import read

SF = "/root/testdata/sf0.01"
KEY = "AKIA" + "Q7ZD2M4N6P8R1S3T"


def told(spans, base=True):
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans if not base or s[0] != "entropy")


def test_whole_table_matches_brute_force(spark):
    docs = read(spark, SF, "documents")
    got = {r["id"]: told(r["spans"]) for r in scan_secrets(docs).collect()}
    assert got == {r["doc_id"]: brute.secrets(r["text"]) for r in docs.collect()}
    assert any(got.values())


def test_edge_rows(spark):
    texts = [
        None,
        "",
        "  \n",
        KEY,
        KEY,
        "API_KEY: 'abc.def-1'",
        "paſſword=abcdef123",  # the long s is no s
        "token=abc token = \"abcdef\"",
        "é" * 50 + "secret=0123456789abcdef0123456789abcdef",
        "x " * 300_000 + "passwd:hunter2x",
        "A" * 100_000,
    ]
    docs = documents(spark, texts, ids=[None, 1, 2, 3, 3, 5, 6, 7, 8, 9, 10])
    got = scan_secrets(docs)
    assert sorted(told(r["spans"]) for r in got.collect()) == sorted(brute.secrets(t) for t in texts)
    assert got.where("id IS NULL").count() == 1
    assert scan_secrets(docs.where("false")).count() == 0


def test_entropy_is_counted_incrementally():
    rng = random.Random(1)
    for _ in range(60):
        run = "".join(rng.choice(string.ascii_letters[: rng.randint(2, 52)]) for _ in range(rng.randint(5, 90)))
        least, w = rng.uniform(1, 4), rng.randint(4, 24)
        inside = set()
        for i in range(len(run) - w + 1):
            if brute.entropy(run[i : i + w]) >= least + 1e-7:
                inside |= set(range(i, i + w))
        got = {p for a, b in entropy_windows(run, w, least) for p in range(a, b)}
        assert inside <= got
        loose = {
            p
            for i in range(len(run) - w + 1)
            if brute.entropy(run[i : i + w]) >= least - 1e-7
            for p in range(i, i + w)
        }
        assert got <= loose


@pytest.mark.parametrize(
    "text, found",
    [
        ("key dGhpc0lzQVZlcnlTZWNyZXRLZXk5ODc2 end", True),
        ("key 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15 end", True),
        ("my-example-placeholder-for-the-dummy-key", False),
        ("sha256-dGhpc0lzQVZlcnlTZWNyZXRLZXk5ODc2", False),
        ("Donaudampfschifffahrtsgesellschaftskapitaen", False),
        ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", False),
    ],
)
def test_allow_list_and_classes(text, found):
    spans = Scanner(24, THRESHOLDS, ALLOW).spans(text)
    assert any(k == "entropy" for k, _, _ in spans) == found


def test_allow_list_keeps_base_spans():
    text = "token = example0123456789"
    kinds = [k for k, _, _ in Scanner(24, THRESHOLDS, ALLOW).spans(text)]
    assert "assign" in kinds and "entropy" not in kinds


def test_no_shuffle(spark):
    plan = scan_secrets(read(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("between", ["AAAAAAAAAAAA", "AAAAAAAA", "-" * 8, "=" * 30])
def test_filler_hides_no_neighbour(between):
    secret = "dGhpc0lzQVZlcnlTZWNyZXRLZXk5ODc2"
    text = f"key {secret}{between}Zq8xW3vT1nR6yB9mK2pL7cJ4hF5dS0g end"
    found = {p for k, a, b in Scanner(24, THRESHOLDS, ALLOW).spans(text) if k == "entropy" for p in range(a, b)}
    assert set(range(4, 4 + len(secret))) <= found and len(text) - 5 in found


def test_placeholder_elsewhere_in_the_run():
    text = "example/" + "aaaa/" * 8 + "dGhpc0lzQVZlcnlTZWNyZXRLZXk5ODc2"
    assert any(k == "entropy" for k, _, _ in Scanner(24, THRESHOLDS, ALLOW).spans(text))


SECRET = "".join(random.Random(8).choices(string.ascii_letters + string.digits + "+/", k=120))


@pytest.mark.parametrize(
    "text", [SECRET, f"example/{SECRET}", f"{SECRET}-dummy", f"https-lorem-{SECRET}", f"{SECRET[:60]}example{SECRET[60:]}"]
)
def test_allow_list_hides_itself_only(text):
    found = {p for k, a, b in Scanner(24, THRESHOLDS, ALLOW).spans(text) if k == "entropy" for p in range(a, b)}
    name = re.search("example|dummy|lorem", text)
    assert not found & set(range(*name.span())) if name else found
    for part in (SECRET[:60], SECRET[60:]):
        at = text.index(part)
        assert len(found & set(range(at, at + len(part)))) >= len(part) - 4


def test_digest_by_name_stays_hidden():
    assert not Scanner(24, THRESHOLDS, ALLOW).spans("sha256-" + SECRET[:43].replace("+", "a") + "=")
