"""Embedding near-dedup by int8 tile products with rigorous error bounds.

A unit vector x is kept as x' = s * q, q in int8, with e = |x - x'| measured. For
two vectors, x.y lies within e_x |y'| + e_y |x'| + e_x e_y of s_x s_y (q_x . q_y),
and the integer product is exact. Tiles of codes are multiplied with each other:
what lies above the threshold by more than its bound is linked, what lies below
by more is not, and only the vectors of the pairs between are fetched in full and
decided by their cosine in double precision.

Every pair of tiles is compared, so the result is exact for any data; the work is
quadratic in the number of distinct vectors, in tasks of bounded size. Equal
vectors are one node. A tile pair returns counts and a spanning forest of its
links, never the links: at most one row per vector, however many links there are.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do vectors of different lengths with each other;
repeated rows are separate vectors that link with each other; an empty table gives an
empty result; other columns are not read. The table must be stored: its rows are
numbered as they are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import Forest, components
from tidemark.llm.util import saved

TILE = 4096
#: Rows of a tile multiplied at once: bounds the product's memory.
STRIP = 256
#: int8 products of so many terms stay exact in float32.
EXACT_TERMS = 1024


@dataclass(frozen=True)
class Codes:
    """int8 codes of some vectors, with scale, error and norm of the coded vector."""

    codes: np.ndarray  # float32 holding int8 values, for the matrix product
    scale: np.ndarray
    error: np.ndarray
    norm: np.ndarray


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, scale, error, norm)`` of the unit vectors along the rows of ``x``."""
    # Components are scaled first, so that no square over- or underflows.
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    rest = unit - back
    error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) + 1e-12
    norm = np.sqrt(np.einsum("ij,ij->i", back, back)) + 1e-12
    return codes, scale, error, norm


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes, by float matrix products."""
    if a.shape[1] <= EXACT_TERMS:
        return a @ b.T
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_TERMS):
        total += a[:, at : at + EXACT_TERMS] @ b[:, at : at + EXACT_TERMS].T
    return total


def banded(a: Codes, b: Codes, least: float, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """``(i, j, certain)`` of all pairs possibly at or above ``least``, strip by strip;
    with ``same`` (b is a) only pairs i < j."""
    top_scale, top_error, top_norm = b.scale.max(), b.error.max(), b.norm.max()
    for at in range(0, len(a.scale), STRIP):
        rows = slice(at, at + STRIP)
        product = _product(a.codes[rows], b.codes)
        slack = a.error[rows] * top_norm + top_error * a.norm[rows] + a.error[rows] * top_error
        limit = (least - slack - 1e-9) / (a.scale[rows] * top_scale)
        # Where the limit is positive, a smaller scale only lowers the estimate.
        hit = product >= np.minimum(limit, limit * 0.999999).astype(np.float32)[:, None]
        i, j = np.nonzero(hit)
        if same:
            upper = i + at < j
            i, j = i[upper], j[upper]
        value = product[i, j].astype(np.float64)
        i = i + at
        value *= a.scale[i] * b.scale[j]
        bound = a.error[i] * b.norm[j] + b.error[j] * a.norm[i] + a.error[i] * b.error[j] + 1e-9
        possible = value + bound >= least
        yield i[possible], j[possible], (value - bound >= least)[possible]


def _link(i: np.ndarray, j: np.ndarray, links: np.ndarray, copies: np.ndarray, forest: Forest) -> None:
    """Count the links ``i``-``j`` (``i`` sorted) for both ends and join them."""
    n = len(copies)
    links += np.bincount(i, copies[j], n).astype(np.int64)
    links += np.bincount(j, copies[i], n).astype(np.int64)
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
    for lo, hi in zip(starts, np.append(starts[1:], len(i)) if len(i) else []):
        forest.join(int(i[lo]), j[lo:hi])


_OUT = "a long, b long, links long, ask boolean, left long, right long"
_NAMES = ["a", "b", "links", "ask", "left", "right"]


def _answer(nodes, forest, links, asked, left, right) -> pa.Table:
    """A row for every node that has links here or must be seen in full."""
    told = np.flatnonzero((links > 0) | asked)
    n = len(told)
    return pa.table(
        [
            pa.array(nodes[told]),
            pa.array(nodes[forest.roots(told)]),
            pa.array(links[told]),
            pa.array(asked[told]),
            pa.array(np.full(n, left)),
            pa.array(np.full(n, right)),
        ],
        names=_NAMES,
    )


def _side(table: pa.Table, column: str, dtype) -> np.ndarray:
    rows = b"".join(table.column(column).to_pylist())
    return np.frombuffer(rows, dtype).reshape(table.num_rows, -1)


def _sides(nodes: np.ndarray, block: np.ndarray, left: int, right: int):
    if left == right:
        every = np.arange(len(nodes))
        return every, every
    return np.flatnonzero(block == left), np.flatnonzero(block == right)


def _compare(table: pa.Table, least: float, full: bool) -> pa.Table:
    """One pair of tiles. ``full``: the rows carry their vectors, and the pairs that the
    codes leave open are decided; otherwise those are asked for."""
    table = table.sort_by("node")  # ends of links by node number, so the least is a root
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    nodes = table.column("node").to_numpy()
    copies = table.column("copies").to_numpy().astype(np.float64)
    block = table.column("block").to_numpy()
    codes = _side(table, "codes", np.int8).astype(np.float32)
    whole = Codes(codes, *[table.column(c).to_numpy() for c in ("scale", "error", "norm")])
    vectors = _side(table, "vector", np.float64) if full else None
    links, asked = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
    forest = Forest(len(nodes))
    one, two = _sides(nodes, block, left, right)
    if len(one) and len(two):
        a, b = [Codes(*[getattr(whole, k)[s] for k in Codes.__dataclass_fields__]) for s in (one, two)]
        for i, j, certain in banded(a, b, least, left == right):
            i, j = one[i], two[j]
            if full:
                sure = ~certain
                i, j = i[sure], j[sure]
                good = np.concatenate(
                    [_cosines(vectors, i[k : k + 20_000], j[k : k + 20_000]) >= least for k in range(0, len(i), 20_000)]
                    or [np.zeros(0, bool)]
                )
                _link(i[good], j[good], links, copies, forest)
            else:
                _link(i[certain], j[certain], links, copies, forest)
                asked[i[~certain]] = True
                asked[j[~certain]] = True
    return _answer(nodes, forest, links, asked, left, right)


def _cosines(vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x, y = vectors[i], vectors[j]
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def coded(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``row, id, dim, hi, lo, codes, scale, error, norm, vector`` of every row; ``dim`` is 0
    and the rest null where a vector cannot be compared."""
    given = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    kind = given.schema["id"].dataType.simpleString()

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                yield _coded(batch)

    return given.mapInArrow(
        code,
        f"row long, id {kind}, dim int, hi long, lo long, codes binary, scale double, "
        "error double, norm double, vector binary",
    )


def _coded(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    rows = [np.array(v, dtype=np.float64) if v else None for v in batch.column(2).to_pylist()]
    dim = np.zeros(n, np.int32)
    columns: dict[str, list] = {c: [None] * n for c in ("hi", "lo", "codes", "scale", "error", "norm", "vector")}
    by_size: dict[int, list[int]] = {}
    for k, v in enumerate(rows):
        # A null component has become nan.
        if v is not None and np.isfinite(v).all() and v.any():
            by_size.setdefault(len(v), []).append(k)
    for size, at in by_size.items():
        x = np.array([rows[k] for k in at])
        codes, scale, error, norm = quantise(x)
        for m, k in enumerate(at):
            raw = x[m].tobytes()
            hi, lo = np.frombuffer(xxhash.xxh128_digest(raw), "<i8")
            dim[k] = size
            for c, v in zip(columns, (int(hi), int(lo), codes[m].tobytes(), scale[m], error[m], norm[m], raw)):
                columns[c][k] = v
    types = [pa.int64()] * 2 + [pa.binary()] + [pa.float64()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(dim)]
        + [pa.array(v, t) for v, t in zip(columns.values(), types)],
        names=["row", "id", "dim", *columns],
    )


def near_vectors(
    vectors: DataFrame,
    least: float = 0.9,
    tile: int = TILE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``row, id, n_links, component_id, kept`` of every row."""
    rows = saved(coded(vectors, id_col, vector_col), "codes")
    classes = rows.where("dim > 0").groupBy("dim", "hi", "lo").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")
    )
    classes = saved(classes, "vector-classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    nodes = rows.join(classes.select("node", "copies"), rows["row"] == classes["node"]).drop("row", "id", "hi", "lo")
    nodes = saved(nodes, "vectors")

    told = None
    for dim, n in sorted(sizes.items()):
        part = _tiles_linked(nodes.where(F.col("dim") == dim), -(-n // tile), least)
        told = part if told is None else told.unionByName(part)
    if told is None:
        told = rows.sparkSession.createDataFrame([], "a long, b long, links long")
    told = saved(told, "vector-links")
    linked = told.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    group = components(told.select("a", "b"))

    member = rows.select("row", "id", "dim", "hi", "lo").join(classes, ["dim", "hi", "lo"], "left")
    member = member.join(linked, "node", "left").join(group, "node", "left").select(
        "row",
        "id",
        F.coalesce("component", "node", "row").alias("group"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    per_id = member.groupBy("group", "id").agg(F.min("row").alias("row"))
    firsts = per_id.groupBy("group").agg(
        F.min("id").alias("component_id"),
        F.coalesce(F.min_by("row", "id"), F.min("row")).alias("keep_row"),
    )
    return member.join(firsts, "group").select(
        "row", "id", "n_links", "component_id", (F.col("row") == F.col("keep_row")).alias("kept")
    )


def _tiles_linked(nodes: DataFrame, tiles: int, least: float) -> DataFrame:
    """``a, b, links``: links of ``a`` in one pair of tiles, and the least node it reaches there."""
    block = F.pmod(F.xxhash64("node"), F.lit(tiles))
    dealt = nodes.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    )
    pair = [F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")]
    light = ["node", "copies", "block", "codes", "scale", "error", "norm"]
    first = dealt.select(*pair, *light).groupBy("left", "right").applyInArrow(
        lambda table: _compare(table, least, False), _OUT
    )
    first = saved(first, "tiles")
    asked = first.where("ask").select("left", "right", F.col("a").alias("node"))
    again = asked.join(nodes.withColumn("block", block).select(*light, "vector"), "node")
    second = again.select("left", "right", *light, "vector").groupBy("left", "right").applyInArrow(
        lambda table: _compare(table, least, True), _OUT
    )
    return first.where("links > 0").unionByName(second).select("a", "b", "links")
