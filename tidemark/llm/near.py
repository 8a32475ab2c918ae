"""MinHash near-dedup by an inverted join on signature coordinates.

A document's signature has ``Params.coordinates`` minima of its shingle set.
Documents are posted under each (coordinate, value) pair. A document whose
posted values are shared in fewer than ``matches`` coordinates is skipped: it
cannot match anything. The others stay under their rarest shared values only,
as many as a pair with ``matches`` equal coordinates must meet in. Pairs that meet are
retained from ``matches`` equal coordinates on and confirmed on the full shingle sets.

Only links that can join two groups are looked for. Documents with one set are one
node. In each posting list every node is first compared with one hub, so that a
list of n copies costs n comparisons, and the groups found are contracted; this is repeated with
other hubs as long as it joins many. Lists that still meet several groups are
compared in full, in tiles: nodes are dealt to buckets of a family, large groups to their own, and
every two buckets that a list brings together, but those of one group, are compared by signature
and then by set, all pairs of different groups. Buckets are bounded in nodes and in
shingles, but for single larger sets. A tile returns the links that span what it
joins, at most one per node. So no link between two groups is lost but for those of ``matches``
(see ``Params``), and pairs never are rows.

Defined cases: a null, empty or blank text has no shingles and links with
nothing; a text with fewer words than a shingle is one shingle; repeated rows
link with each other if they have words; the row that stays is the one with the
smallest id (null ids last); an empty table gives an empty result; other columns
are not read. Rows are numbered once and stored with their numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import Forest, components
from tidemark.llm.util import dropped, lean, numbered, per_process, row_of, saved

CACHED_WORDS = 100_000


@dataclass(frozen=True)
class Params:
    """A pair at similarity 0.8 has 38 of 48 equal coordinates on average, and
    fewer than 20 with a chance of 1.1e-9."""

    words: int = 5
    percent: int = 80
    coordinates: int = 48
    matches: int = 20
    seed: int = 11


class _Words(dict):
    """Word -> 64-bit hash, for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle sets of whole texts as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.k = words
        self.words = per_process(("words",), _Words)

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know the ASCII letters and white space only.
        words = (text or "").encode("utf-8").lower().split()
        n = len(words)
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        if n == 0:
            return ids
        step = np.uint64(0x100000001B3D4F5)
        k = min(n, self.k)
        got = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            got = _mixed(got * step + ids[i : n - k + 1 + i])
        return np.unique(got)


class Signer:
    def __init__(self, params: Params):
        rng = np.random.default_rng(params.seed)
        top = np.iinfo(np.uint64).max
        self.mul = rng.integers(0, top, (params.coordinates, 1), np.uint64) | np.uint64(1)
        self.add = rng.integers(0, top, (params.coordinates, 1), np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(len(self.mul), np.iinfo(np.uint32).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            seen = (shingles[at : at + 2048] * self.mul + self.add) >> np.uint64(32)
            np.minimum(best, seen.min(axis=1), out=best)
        return best.astype(np.uint32)


def signatures(docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """``row, id, n_shingles, hi, lo`` (digest of the set), ``signature`` of every numbered row."""
    given = docs.select(
        row_of(docs).alias("row"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(params.words), Signer(params)
        for batch in batches:
            sizes, digests, signed = [], [], []
            for text in batch.column(2):
                found = shingler(text.as_py())
                sizes.append(len(found))
                digests.append(xxhash.xxh128_digest(found.tobytes()))
                signed.append(signer(found).tobytes() if len(found) else None)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array(signed, pa.binary()),
                ],
                names=["row", "id", "n_shingles", "hi", "lo", "signature"],
            )

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(
        lean(sign), f"row long, id {kind}, n_shingles long, hi long, lo long, signature binary"
    )


def _postings(nodes: DataFrame, params: Params) -> DataFrame:
    """``key, node``: one row for each coordinate of each node."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = params.coordinates
        place = np.arange(k, dtype=np.int64) << 32
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32)
                keys = values.reshape(-1, k).astype(np.int64) | place
                node = np.repeat(batch.column("node").to_numpy(), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(node)], names=["key", "node"]
                )

    return nodes.select("node", "signature").mapInArrow(lean(post), "key long, node long")


def prefix_postings(nodes: DataFrame, params: Params) -> DataFrame:
    """The rarest shared postings of every node that shares at least ``matches``."""
    posted = _postings(nodes, params)
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # At most ``coordinates`` postings meet in a node.
    listed = posted.join(shared, "key").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys")
    )
    kept = F.slice("keys", 1, F.size("keys") - (params.matches - 1))
    return (
        listed.where(F.size("keys") >= params.matches)
        .select("node", F.explode(kept).alias("k"))
        .select(F.col("k.key").alias("key"), "node")
    )


def _matching(pairs: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """The pairs with at least ``matches`` equal coordinates."""
    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                sides = [
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(
                        -1, params.coordinates
                    )
                    for c in ("sa", "sb")
                ]
                same = (sides[0] == sides[1]).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= params.matches))

    return pairs.join(one, "a").join(two, "b").mapInArrow(lean(count), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for sa, sb in zip(batch.column("sa"), batch.column("sb")):
                x = np.frombuffer(sa.as_buffer(), np.uint64)
                y = np.frombuffer(sb.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= params.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").mapInArrow(lean(confirm), "a long, b long")


#: Nodes of a bucket, and shingles of them.
BUCKET = 2048
BUCKET_SHINGLES = 2_000_000
#: Posting lists longer than this keep their nodes in one family.
LONG_LIST = 16
#: Hubs are drawn anew as long as one of so many comparisons joins two groups.
WORTH = 20


def _grouped(posted: DataFrame, found: DataFrame) -> DataFrame:
    """``key, node, group`` of the lists that meet several groups of those joined so far."""
    group = components(found).withColumnRenamed("component", "group")
    here = posted.join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    several = here.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    return here.join(several.select("key"), "key")


def _hub_links(posted: DataFrame, nodes: DataFrame, sets: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Links with hubs, and the pairs that match by signature in the first round."""
    found = first = None
    turn = 0
    while True:
        here = _grouped(posted, found) if turn else posted.withColumn("group", F.col("node"))
        drawn = F.struct(F.xxhash64("node", F.lit(turn)), "node", "group")
        hubs = here.groupBy("key").agg(F.min(drawn).alias("hub"))
        pairs = here.join(hubs, "key").where("group <> hub.group")
        pairs = pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        near = saved(_matching(pairs.distinct(), nodes, params), "matching")
        first = first or near
        new = saved(_confirmed(near, sets, params), "hub-links")
        n = new.count()
        found = saved(found.unionByName(new), "links") if turn else new
        if n * WORTH < near.count() or not n:
            return found, first
        turn += 1


def _buckets(posted: DataFrame, nodes: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """``node, group, bucket, signature`` of the posted nodes. ``group``: joined so far; ``bucket``:
    a bounded part of a family, or of a large group in it. A family is that of the least node that
    a node meets by equal coordinates or in a long list, and one step on: nodes that will be
    compared come to lie in few buckets. Which nodes share a family changes the work
    only, not the result."""
    group = components(found).withColumnRenamed("component", "group")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"))
    long = posted.join(lists.where(F.col("n") > LONG_LIST), "key")
    met = [
        near.select(F.col("b").alias("node"), F.col("a").alias("met")),
        near.select(F.col("a").alias("node"), F.col("b").alias("met")),
        long.select("node", F.col("hub").alias("met")),
        posted.select("node", F.col("node").alias("met")),
    ]
    least = reduce(DataFrame.unionByName, met).groupBy("node").agg(F.min("met").alias("least"))
    least = saved(least, "least-met")
    step = least.select(F.col("node").alias("least"), F.col("least").alias("family"))
    info = (
        least.join(step, "least")
        .join(nodes.select("node", "n_shingles"), "node")
        .join(group, "node", "left")
        .select("node", F.coalesce("group", "node").alias("group"), "family", "n_shingles")
    )
    full = F.greatest(F.count(F.lit(1)) / BUCKET, F.sum("n_shingles") / BUCKET_SHINGLES)
    groups = info.groupBy("family", "group").agg(full.alias("fills"))
    # The small groups of a family lie together, each of the others by itself.
    small = F.when(F.col("fills") < 0.5, F.col("fills"))
    families = groups.groupBy("family").agg(F.ceil(F.sum(small)).alias("rest"))
    parts = groups.join(families, "family").select("family", "group", F.ceil("fills").alias("own"), small.alias("low"), "rest")
    own = F.xxhash64("family", "group", F.pmod(F.xxhash64("node"), F.col("own")))
    rest = F.xxhash64("family", F.lit(""), F.pmod(F.xxhash64("group"), F.col("rest")))
    bucket = F.when(F.col("low").isNull(), own).otherwise(rest).alias("bucket")
    dealt = info.join(parts, ["family", "group"]).select("node", "group", "n_shingles", bucket)
    return dealt.join(nodes.select("node", "signature"), "node")


def _meetings(posted: DataFrame, dealt: DataFrame) -> DataFrame:
    """``left, right``: buckets that some list brings together, with more than one group."""
    here = posted.join(dealt.select("node", "group", "bucket"), "node")
    per = here.groupBy("key", "bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    several = per.groupBy("key").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    per = saved(per.join(several.where("least <> most").select("key"), "key"), "meeting")
    one = per.select("key", F.col("bucket").alias("left"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = per.select("key", F.col("bucket").alias("right"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    across = one.join(two, "key").where("left < right AND NOT (lo1 = hi1 AND lo2 = hi2 AND lo1 = lo2)")
    inside = per.where("lo <> hi").select(F.col("bucket").alias("left"), F.col("bucket").alias("right"))
    return across.select("left", "right").unionByName(inside).distinct()


def _tile_rows(pairs: DataFrame, dealt: DataFrame) -> DataFrame:
    """The nodes of the tiles: ``left`` a bucket (``side`` 0), ``right`` a part of the smaller
    buckets that it is paired with (``side`` 1), or -1 for a bucket with itself. So a
    large bucket is not read again for every small one that it meets."""
    full = F.greatest(F.count(F.lit(1)) / BUCKET, F.sum("n_shingles") / BUCKET_SHINGLES)
    sizes = dealt.groupBy("bucket").agg(full.alias("fills"))
    one = sizes.select(F.col("bucket").alias("left"), F.struct("fills", "bucket").alias("l"))
    two = sizes.select(F.col("bucket").alias("right"), F.struct("fills", "bucket").alias("r"))
    met = pairs.where("left <> right").join(one, "left").join(two, "right")
    met = met.select(F.greatest("l", "r").alias("host"), F.least("l", "r").alias("guest"))
    met = met.select(F.col("host.bucket").alias("left"), F.col("guest.bucket").alias("bucket"), "guest.fills")
    parts = met.groupBy("left").agg(F.ceil(F.sum("fills")).alias("parts"))
    part = F.pmod(F.xxhash64("bucket"), F.col("parts")).alias("right")
    guests = met.join(parts, "left").select("left", part, "bucket")
    hosts = guests.select("left", "right").distinct()
    alone = pairs.where("left = right").select("left", F.lit(-1).cast("long").alias("right"))
    hosts = hosts.unionByName(alone).withColumn("bucket", F.col("left"))
    sides = hosts.withColumn("side", F.lit(0)).unionByName(guests.withColumn("side", F.lit(1)))
    return sides.join(dealt, "bucket").select("left", "right", "side", "node", "group", "signature")


class _Tile:
    """Candidate pairs of one tile: enough equal coordinates, different groups."""

    def __init__(self, table: pa.Table, params: Params):
        self.table = table = table.sort_by("node")
        self.nodes = table.column("node").to_numpy()
        side, group = table.column("side").to_numpy(), table.column("group").to_numpy()
        alone = table.column("right")[0].as_py() < 0
        rows = b"".join(table.column("signature").to_pylist())
        signed = np.frombuffer(rows, np.uint32).reshape(len(self.nodes), params.coordinates)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))
        self.i, self.j = one[:0], two[:0]
        if len(one) and len(two):
            same = np.zeros((len(one), len(two)), np.uint8 if params.coordinates < 256 else np.uint16)
            for c in range(params.coordinates):
                same += signed[one, c][:, None] == signed[two, c][None, :]
            good = (same >= params.matches) & (group[one][:, None] != group[two][None, :])
            i, j = np.nonzero(good)
            self.i, self.j = one[i], two[j]
            if alone:
                below = self.i < self.j
                self.i, self.j = self.i[below], self.j[below]


def _tile_links(pairs: DataFrame, dealt: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """``a, b``: links that span what the tiles of ``pairs`` join."""
    light = ["left", "right", "side", "node", "group", "signature"]

    def ask(table: pa.Table) -> pa.Table:
        tile = _Tile(table, params)
        told = tile.table.take(pa.array(np.union1d(tile.i, tile.j)))
        return told.select(["left", "right", "side", "node"])

    asked = (
        _tile_rows(pairs, dealt)
        .groupBy("left", "right")
        .applyInArrow(ask, "left long, right long, side int, node long")
    )
    asked = saved(asked, "asked")

    def confirm(table: pa.Table) -> pa.Table:
        tile = _Tile(table, params)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.table.column("shingles")]
        size = np.array([len(x) for x in sets])
        _, name = np.unique(np.concatenate(sets), return_inverse=True)
        names = np.split(name, np.cumsum(size)[:-1])
        seen = np.zeros(len(name) + 1, bool)
        forest = Forest(len(sets))
        starts = np.flatnonzero(np.append(True, tile.i[1:] != tile.i[:-1])) if len(tile.i) else []
        for lo, hi in zip(starts, np.append(starts[1:], len(tile.i)) if len(tile.i) else []):
            i, others = int(tile.i[lo]), tile.j[lo:hi]
            seen[names[i]] = True
            parts = np.concatenate([names[j] for j in others])
            both = np.add.reduceat(seen[parts].astype(np.int64), np.cumsum(size[others]) - size[others])
            seen[names[i]] = False
            linked = others[100 * both >= params.percent * (size[i] + size[others] - both)]
            if len(linked):
                forest.join(i, linked)
        root = forest.roots(np.arange(len(sets)))
        told = np.flatnonzero(root != np.arange(len(sets)))
        return pa.table([pa.array(tile.nodes[root[told]]), pa.array(tile.nodes[told])], names=["a", "b"])

    whole = asked.join(dealt, "node").join(sets, "node")
    return whole.select(*light, "shingles").groupBy("left", "right").applyInArrow(confirm, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, params: Params, text_col: str) -> DataFrame:
    """Confirmed links ``a, b`` between nodes, enough to join all that are reachable."""
    posted = saved(prefix_postings(nodes, params), "postings")
    text = docs.select(row_of(docs).alias("node"), F.col(text_col).alias("text"))
    wanted = text.join(posted.select("node").distinct(), "node", "left_semi")

    def shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params.words)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingler(t.as_py()).tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"]
                )

    sets = saved(wanted.mapInArrow(lean(shingled), "node long, shingles binary"), "shingles")

    found, near = _hub_links(posted, nodes, sets, params)
    dealt = saved(_buckets(posted, nodes, found, near), "buckets")
    meetings = saved(_meetings(posted, dealt), "meetings")
    return found.unionByName(_tile_links(meetings, dealt, sets, params))


def near_dedup(
    docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row, id, n_shingles, component_id, kept`` of every row.

    ``component_id``: smallest id of the documents reachable by links.
    """
    docs = numbered(docs, id_col, text_col)
    signed = saved(signatures(docs, params, id_col, text_col), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "hi", "lo").agg(F.min("row").alias("node"))
    member = signed.join(classes, ["n_shingles", "hi", "lo"], "left").select(
        "row", "id", "n_shingles", F.coalesce("node", "row").alias("node")
    )
    member = saved(member, "members")
    nodes = signed.join(classes.select("node"), signed["row"] == classes["node"])
    nodes = nodes.select("node", signed["n_shingles"], "signature")
    nodes = saved(nodes, "nodes")
    dropped(signed)
    group = components(links(docs, nodes, params, text_col))
    grouped = member.join(group, "node", "left").withColumn("group", F.coalesce("component", "node"))
    per_id = grouped.groupBy("group", "id").agg(F.min("row").alias("row"))
    least = per_id.groupBy("group").agg(
        F.min("id").alias("component_id"),
        F.coalesce(F.min_by("row", "id"), F.min("row")).alias("keep_row"),
    )
    return grouped.join(least, "group").select(
        "row", "id", "n_shingles", "component_id", (F.col("row") == F.col("keep_row")).alias("kept")
    )
