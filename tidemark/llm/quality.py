"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts are all that the classifier sees: it
minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` of a small network over
counts of a text's bytes, words and lines. The class prior is estimated from
the same two samples: the least ratio, over the top scores of a first
positive-against-unlabelled fit, between the share of unlabelled texts and the
share of held-back positives (a bound on the prior, as negatives only add to the former).

The fit reads a bounded sample, ``POSITIVES`` and ``UNLABELLED`` texts, chosen by
a hash of the id; every row is scored, each in the task that holds it.

Defined cases: a null text is an empty one; empty texts get the score that the
model gives to a text without words; without any trusted positive all scores
are 0.5; repeated rows are each scored; an empty table gives an empty result;
columns other than the id and the text are no inputs.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import lean

#: Bounds of the samples that the fit reads.
POSITIVES = 10_000
UNLABELLED = 20_000
#: Random halves of the samples for the class prior.
SPLITS = 9
HIDDEN = 16
STEPS = 600
DECAY = 3e-3
N_FEATURES = 22


def features(text: str | None) -> np.ndarray:
    """Counts of a whole text's bytes, words and lines, as shares."""
    out = np.zeros(N_FEATURES)
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        out[0] = 1.0
        return out
    n = len(data)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    blank = seen[32] + seen[9:14].sum()
    marks = seen[33:127].sum() - upper - lower - digits
    full, comma = seen[46], seen[44]
    high = seen[128:].sum()
    letters = upper + lower + high
    m = len(words)
    sizes = np.fromiter(map(len, words), np.int64, m)
    lines = data.split(b"\n")
    share = seen[seen > 0]
    out[1:] = [
        np.log1p(n),
        np.log1p(m),
        upper / max(letters, 1e-9),
        digits,
        marks - full - comma,
        full,
        comma,
        seen[33] + seen[63],
        seen[124],
        blank,
        high,
        -(share * np.log2(share)).sum(),
        sizes.mean(),
        (sizes <= 3).mean(),
        (sizes >= 15).mean(),
        sum(map(operator.eq, words, words[1:])) / m,
        len(set(words)) / m,
        sum(map(bytes.isupper, words)) / m,
        sum(map(bytes.isalpha, words)) / m,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
    ]
    return out


def _forward(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w[0] + w[1])
    return h, h @ w[2] + w[3][0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> list[np.ndarray]:
    """Network weights; ``prior`` None fits positives against unlabelled, both weighing a half."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    w = [
        rng.normal(0, d**-0.5, (d, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN),
        np.zeros(1),
    ]
    first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    x = np.vstack([positive, unlabelled])
    p, u = len(positive), len(unlabelled)
    for step in range(1, STEPS + 1):
        h, z = _forward(w, x)
        s = _sigmoid(z)
        dz = np.empty_like(z)
        if prior is None:
            dz[:p], dz[p:] = (s[:p] - 1) / p / 2, s[p:] / u / 2
        else:
            loss = np.logaddexp(0, z)
            negative = loss[p:].mean() - prior * loss[:p].mean()
            if negative >= 0:
                dz[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
                dz[p:] = s[p:] / u
            else:  # undo the step that overfits the unlabelled texts
                dz[:p], dz[p:] = prior * s[:p] / p, -s[p:] / u
        back = np.outer(dz, w[2]) * (1 - h * h)
        grads = [x.T @ back, back.sum(0), h.T @ dz, np.array([dz.sum()])]
        for i, g in enumerate(grads):
            g = g + DECAY * w[i] * (i in (0, 2))
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            rate = 0.02 * min(1.0, 2 * (1 - step / (STEPS + 1)))
            w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (
                np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
            )
    return w


def _prior_once(positive: np.ndarray, unlabelled: np.ndarray, seed: int) -> float:
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    w = _fit(positive[:half_p], unlabelled[:half_u], None, seed)
    sp = np.sort(_forward(w, positive[half_p:])[1])
    su = np.sort(_forward(w, unlabelled[half_u:])[1])
    cuts = np.quantile(sp, np.linspace(0.0, 0.9, 91))
    tail_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    tail_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(200) / 2 / len(sp)) + np.sqrt(np.log(200) / 2 / len(su))
    best = np.argmin((tail_u + slack) / np.maximum(tail_p, 1e-9))
    return float(np.clip(tail_u[best] / max(tail_p[best], 1e-9), 0.05, 0.99))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """Estimated share of positives among the unlabelled, from both samples' features:
    the median over ``SPLITS`` random halves."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    found = []
    for k in range(SPLITS):
        rng = np.random.default_rng(seed + k)
        found.append(_prior_once(rng.permutation(positive), rng.permutation(unlabelled), seed + k))
    return float(np.median(found))


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> dict:
    """The model: feature scaling, weights and the estimated prior."""
    whole = np.vstack([positive, unlabelled])
    mean, scale = whole.mean(0), whole.std(0) + 1e-6
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    p, u = np.clip(p, -8, 8), np.clip(u, -8, 8)
    prior = class_prior(p, u, seed)
    return {"mean": mean, "scale": scale, "prior": prior, "weights": _fit(p, u, prior, seed)}


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return _sigmoid(_forward(model["weights"], z)[1])


def _feature_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            yield batch, np.array([features(t.as_py()) for t in batch.column("text")])


def fit(
    docs: DataFrame,
    positives: DataFrame,
    max_positives: int = POSITIVES,
    max_unlabelled: int = UNLABELLED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> dict | None:
    """A model from ``docs`` and ``positives``, a column ``id`` of ids of trusted texts.

    Rows whose id has a small enough hash are read, at most about
    ``max_positives`` and ``max_unlabelled`` of them. None without any positive.
    """
    span = 1 << 40

    def drawn(n: int, most: int, seed: int):
        part = min(1.0, most / max(n, 1))
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(span)) < int(part * span)

    rows = docs.count()
    ids = positives.select("id").where("id IS NOT NULL").distinct()
    chosen = ids.where(drawn(ids.count(), max_positives, 1)).withColumn("positive", F.lit(True))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most ``max_positives`` ids, so their size is bounded.
    marked = given.join(F.broadcast(chosen), "id", "left")
    sample = marked.where(F.col("positive") | drawn(rows, max_unlabelled, 2)).select(
        F.coalesce("positive", F.lit(False)).alias("positive"),
        drawn(rows, max_unlabelled, 2).alias("unlabelled"),
        "text",
    )

    def measure(batches):
        for batch, x in _feature_batches(batches):
            rows = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), rows], names=["positive", "unlabelled", "x"]
            )

    told = sample.mapInArrow(lean(measure), "positive boolean, unlabelled boolean, x array<double>").toArrow()
    if not told.num_rows:
        return None
    x = np.array(told["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES)
    kinds = [told[c].to_numpy().astype(bool) for c in ("positive", "unlabelled")]
    # One order of the sample, whatever task told its rows first; then shuffled.
    order = np.lexsort(np.vstack([*kinds, x.T]))
    order = order[np.random.default_rng(0).permutation(len(order))]
    x, kinds = x[order], [k[order] for k in kinds]
    if not kinds[0].any() or not kinds[1].any():
        return None
    return train(x[kinds[0]], x[kinds[1]])


def score_quality(
    docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, score`` of every row of ``docs``. No shuffle."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch, x in _feature_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score(model, x))], names=["id", "score"]
            )

    return given.mapInArrow(lean(run), f"id {given.schema['id'].dataType.simpleString()}, score double")


def scored_rows(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` whose text scores at least 0.5."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                x = np.array([features(t.as_py()) for t in batch.column(at)])
                yield batch.filter(pa.array(score(model, x) >= 0.5))

    return docs.select(*names).mapInArrow(lean(run), docs.schema)
