"""Secret scans: fixed patterns plus sliding-window entropy.

Candidates are maximal runs of token characters. In each run of one character
class a window of fixed length slides along; the counts of its characters, and
with them its Shannon entropy, are updated for the one character that leaves and
the one that enters. Windows at or over the class's threshold are merged into
spans. A match of the allow-list in the run drops the spans that it touches; a match
of one repeated character is filler and drops only the windows that it lies in.
The fixed patterns are reported whatever the allow-list says.

Defined cases: a null text is an empty one and has no spans; offsets count
code points; repeated rows are each scanned; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

WINDOW = 24
#: Character class -> least entropy of a window, in bits per character.
THRESHOLDS = {"0-9a-fA-F": 3.0, "A-Za-z0-9+/_=-": 4.0}
#: Runs that look random but are not secret: placeholders, alphabets, file digests by name.
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|lorem",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)^sha(1|224|256|384|512)-[A-Za-z0-9+/]+=*",
    r"(.)\1{7}",
)

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is found as such: shorter runs cannot be part of one.
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return found


def entropy_windows(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of ``run`` with at least ``least`` bits a character.

    H = log2(w) - sum(c * log2(c)) / w over the counts c in the window; one
    step changes two counts, so two terms of the sum.
    """
    if len(run) < window or len(set(run)) < 2**least:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - least) + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= window:
            out = run[i - window]
            c = counts[out]
            total += term[c - 1] - term[c]
            counts[out] = c - 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _between(run: str, filler: list[tuple[int, int]], lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The parts of ``run[lo:hi]`` that hold no whole ``filler``, as long as can be: any
    window without one lies in a part."""
    for a, b in sorted(filler):
        if lo <= a and b <= hi:
            yield lo, b - 1
            end = b
            while end < hi and run[end] == run[a]:
                end += 1
            lo = end - (b - a) + 1
    yield lo, hi


def _outside(named: list[tuple[int, int]], lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The parts of ``lo .. hi`` that touch none of ``named``: a window that touches none lies in one."""
    for a, b in sorted(named):
        if a < hi and b > lo:
            yield lo, max(a, lo)
            lo = b
    yield lo, max(hi, lo)


class Scanner:
    """The patterns of one scan, compiled once per task."""

    def __init__(self, window: int, thresholds: Mapping[str, float], allow: Sequence[str]):
        chars = "".join(thresholds)
        self.candidate = re.compile(f"[{chars}]{{{window},}}")
        self.classes = [(re.compile(f"[{c}]{{{window},}}"), h) for c, h in thresholds.items()]
        self.allow = [re.compile(a) for a in allow]
        self.window = window
        self.distinct = 2 ** min(thresholds.values())

    def entropy_spans(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int]] = []
        for m in self.candidate.finditer(text):
            run = m[0]
            if len(set(run)) < self.distinct:
                continue
            hits = [h.span() for a in self.allow for h in a.finditer(run)]
            filler = [(a, b) for a, b in hits if len(set(run[a:b])) == 1]
            named = [(a, b) for a, b in hits if len(set(run[a:b])) > 1]
            spans = [
                (lo + a, lo + b)
                for one, least in self.classes
                for part in one.finditer(run)
                for left, right in _outside(named, *part.span())
                for lo, hi in _between(run, filler, left, right)
                for a, b in entropy_windows(run[lo:hi], self.window, least)
            ]
            found += [(m.start() + a, m.start() + b) for a, b in spans]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return [(a, 3, b) for a, b in merged]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        found = sorted(base_spans(text) + self.entropy_spans(text))
        return [(KINDS[k], a, b) for a, k, b in found]


def scan_secrets(
    docs: DataFrame,
    window: int = WINDOW,
    thresholds: Mapping[str, float] = THRESHOLDS,
    allow: Sequence[str] = ALLOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id`` and ``spans`` (kind, start, end; by start, then kind) of every row.

    No shuffle: each task scans its own rows.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(window, dict(thresholds), list(allow))
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(text.as_py())]
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, _SPANS)], names=["id", "spans"]
            )

    return given.mapInArrow(scan, f"id {given.schema['id'].dataType.simpleString()}, spans {SPANS}")
