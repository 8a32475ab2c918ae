"""Plain Python versions of what the operators must find."""

from __future__ import annotations

import collections
import re

import numpy as np

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def secrets(text: str | None) -> str:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def entropy(text: str) -> float:
    counts = np.array(list(collections.Counter(text).values())) / len(text)
    return float(-(counts * np.log2(counts)).sum())


def shingles(text: str | None, k: int) -> frozenset:
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def similar(a: frozenset, b: frozenset, percent: int) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def removed(texts: list[str | None], length: int) -> list[tuple[int, int, bytes]]:
    """(bytes removed, spans, bytes kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.append(0, gone.astype(int)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((int(gone.sum()), int((edge == 1).sum()), kept))
    return out


def targets(sizes: list[int], weights=(5, 2, 1), share=1.5, most=2.0) -> list[float]:
    """Shares by weight; what is over ``most`` goes to the others, until none is over."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    got = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    budget = share * sum(sizes)
    while open_:
        level = budget / sum(weight[i] for i in open_)
        over = {i for i in open_ if level * weight[i] > most * sizes[i]}
        if not over:
            for i in open_:
                got[i] = level * weight[i]
            return got
        for i in over:
            got[i] = most * sizes[i]
            budget -= got[i]
        open_ -= over
    return got


