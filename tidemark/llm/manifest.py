"""A Merkle manifest of a table by time-forward processing.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group, in order, are hashed
eight at a time until one node is left, the group's subroot; the subroots, in the order
of their groups, likewise give the root. A proof of a leaf is its siblings on the way.

A node is processed when all it waits for has arrived, and sends on what others
wait for. Upwards, it is labelled by the last leaf below it and its level, so that children come
before parents: a priority queue ordered by label delivers child digests to
parents. Downwards the order is reversed, and parents deliver proof suffixes to children.
The queue is external: a block of ``fanout ** levels`` nodes is swept with a heap in memory
(``_Sweep``), and what leaves a block is a stored message for a block of the next round, brought
there by Spark's sort-based shuffle, label first. A round divides the nodes by 4096, so a few
rounds reach the root; a block is bounded, however large its group.

Defined cases: a null field is hashed as ``-``, which no value is; rows with equal ids come in the order
of their leaf digests (equal rows are interchangeable: their digests are the same); null
ids and the null group come first; a lone leaf is its group's subroot and a lone group's subroot
the root; a leaf without siblings has an empty proof; an empty table gives an empty
result; other columns are not read, clashing names or not.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import saved

#: A step of a proof: the digests of the siblings before and after a node, concatenated.
STEP = "struct<before: string, after: string>"


def _field(c: Column) -> Column:
    text = c.cast("string")
    told = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(told, F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields: ``-`` for a null, else byte count, ``:`` and the value."""
    return F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, s: digest(F.concat(s["before"], d, s["after"])))


def proof_text(proof: Column) -> Column:
    """The siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass(frozen=True)
class Shape:
    """``fanout`` children of a node; a block of the sweep holds ``fanout ** levels`` nodes."""

    fanout: int = 8
    levels: int = 4

    @property
    def block(self) -> int:
        return self.fanout**self.levels


class _Sweep:
    """The nodes above one block's ``digests``, up to ``height`` levels higher.

    A label is (last leaf below, level): children first. Messages wait in a heap.
    """

    def __init__(self, digests: Sequence[str], height: int, fanout: int):
        self.fanout, self.height, self.n = fanout, height, len(digests)
        #: label -> (index of the node on its level, its children's labels and digests)
        self.nodes: dict[tuple, tuple] = {}
        self.top = digests[0] if digests and not height else None
        queue: list[tuple] = []

        def send(level: int, index: int, sender: tuple, value: str) -> None:
            heapq.heappush(queue, (self._label(level + 1, index // fanout), index, sender, value))

        if height:
            for i, d in enumerate(digests):
                send(0, i, (i, 0), d)
                # Whatever ends before the next leaf has all its messages.
                self._forward(queue, i, send)

    def _label(self, level: int, index: int) -> tuple:
        span = self.fanout**level
        return (min((index + 1) * span, self.n) - 1, level)

    def _forward(self, queue: list, until: int, send) -> None:
        while queue and queue[0][0][0] <= until:
            label = queue[0][0]
            got = []
            while queue and queue[0][0] == label:
                _, index, sender, value = heapq.heappop(queue)
                got.append((sender, value))
            value = sha256("".join(v for _, v in got).encode()).hexdigest()
            self.nodes[label] = got
            if label[1] == self.height:
                self.top = value
            else:
                send(label[1], index // self.fanout, label, value)

    def proofs(self, suffix: list) -> list[list]:
        """For each leaf of the block its steps, then ``suffix``: labels in falling order."""
        if not self.height:
            return [suffix] * self.n
        waiting = {max(self.nodes): suffix}
        out: list = [None] * self.n
        for label in sorted(self.nodes, reverse=True):
            above = waiting.pop(label)
            children = self.nodes[label]
            values = [v for _, v in children]
            for k, (child, _) in enumerate(children):
                step = {"before": "".join(values[:k]), "after": "".join(values[k + 1 :])}
                if child[1] == 0:
                    out[child[0]] = [step, *above]
                else:
                    waiting[child] = [step, *above]
        return out


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows``, stored, with ``pos``: the place of each in its group, by ``order``.

    The rows are sorted by range; a group runs over as many partitions as it fills. Only
    the counts of the partitions are added up, one row for each group in each partition.
    """
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Numbers that ascend with the partitions, and within them.
    ranged = saved(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    parts = ranged.groupBy(group, part.alias("part")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy(group).orderBy("part")
    total = Window.partitionBy(group)
    parts = parts.select(
        group,
        "part",
        (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(total).alias("size"),
    )
    return (
        ranged.withColumn("part", part)
        .join(parts, [group, "part"])
        .withColumn("pos", F.col("at") + F.col("shift"))
        .drop("part", "at", "shift")
    )


def _height(sizes: Column, shape: Shape) -> Column:
    """Levels that a block is folded by: all that are left in a group's only block."""
    alone = F.lit(shape.levels)
    for level in reversed(range(shape.levels)):
        alone = F.when(sizes <= shape.fanout**level, F.lit(level)).otherwise(alone)
    return alone


def _blocked(nodes: DataFrame, shape: Shape) -> DataFrame:
    """Nodes ``grp, pos, size, digest`` with their ``block`` and its ``height``."""
    return nodes.withColumn("block", F.floor(F.col("pos") / shape.block)).withColumn(
        "height", _height(F.col("size"), shape)
    )


def _upwards(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """The stored nodes of each round: those given, then the tops of their blocks, down to
    one node for each group."""
    rounds = [nodes]
    fanout = shape.fanout
    while rounds[-1].agg(F.max("size").alias("n")).first()["n"] not in (None, 1):

        def sweep(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            top = _Sweep(table.column("digest").to_pylist(), table.column("height")[0].as_py(), fanout).top
            return pa.table(
                [table.column("grp")[:1], table.column("block")[:1], table.column("size")[:1], pa.array([top])],
                names=["grp", "pos", "size", "digest"],
            )

        tops = (
            _blocked(rounds[-1], shape)
            .select("grp", "block", "pos", "size", "height", "digest")
            .groupBy("grp", "block")
            .applyInArrow(sweep, "grp string, pos long, size long, digest string")
        )
        size = F.ceil(F.col("size") / shape.block)
        rounds.append(saved(tops.withColumn("size", size), "merkle-up"))
    return rounds


def _delivery(fanout: int, named: Sequence[str]):
    """The reversed sweep of a block: its rows with their proofs."""
    steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def deliver(rows: pa.Table, suffix: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        sweep = _Sweep(rows.column("digest").to_pylist(), rows.column("height")[0].as_py(), fanout)
        proofs = pa.array(sweep.proofs(suffix.column("proof")[0].as_py()), steps)
        tail = pa.array([suffix.column("tail")[0].as_py()] * rows.num_rows, pa.string())
        told = rows.select(["grp", "pos", "digest", *named])
        return told.append_column("tail", tail).append_column("proof", proofs)

    return deliver


def _downwards(rounds: list[DataFrame], tops: DataFrame, shape: Shape, carry: Sequence[str]) -> DataFrame:
    """``grp, digest, carry..., tail, proof`` of the nodes of the first round.

    ``tops``: ``grp, pos, tail, proof`` of the nodes of the last round: what their
    groups' tops have above them, and a text that travels with it.
    """
    for k in reversed(range(len(rounds) - 1)):
        below = _blocked(rounds[k], shape)
        extra = [f for f in below.schema.fields if f.name in carry] if k == 0 else []
        named = [f.name for f in extra]
        kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
        message = tops.select("grp", F.col("pos").alias("block"), "tail", "proof")
        told = (
            below.select("grp", "block", "pos", "height", "digest", *named)
            .groupBy("grp", "block")
            .cogroup(message.groupBy("grp", "block"))
            .applyInArrow(
                _delivery(shape.fanout, named),
                f"grp string, pos long, digest string{kinds}, tail string, proof array<{STEP}>",
            )
        )
        tops = saved(told, "merkle-down") if k else told
    return tops


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    id_col: str,
    group_col: str,
    carry: dict[str, Column] | None = None,
    shape: Shape = Shape(),
) -> DataFrame:
    """``id, leaf, subroot, root, proof`` of every row, and the columns ``carry`` made from it.

    ``proof``: an array of ``STEP``, from the leaf to the root.
    """
    carry = carry or {}
    # Null first, then by the bytes of the name.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    made = {f"carry_{k}": c for k, c in carry.items()}
    rows = docs.select(
        grp.alias("grp"),
        F.col(id_col).alias("id"),
        leaf_digest(*[F.col(c) for c in fields]).alias("digest"),
        *[c.alias(name) for name, c in made.items()],
    )
    # Stored first: sorting by range reads its input twice.
    rows = saved(rows, "hashed")
    leaves = saved(placed(rows, "grp", ["id", "digest"]), "leaves")
    up = _upwards(leaves, shape)
    subroots = up[-1].select(F.lit("").alias("all"), F.col("grp").alias("of"), "digest")
    trees = placed(subroots, "all", ["of"]).withColumnRenamed("all", "grp")
    trees = saved(trees, "subroots")
    over = _upwards(trees, shape)

    nothing = F.array().cast(f"array<{STEP}>")
    root = over[-1].select("grp", "pos", F.col("digest").alias("tail"), nothing.alias("proof"))
    if len(over) > 1:
        top = _downwards(over, root, shape, ["of"])
    else:
        top = trees.join(root, ["grp", "pos"])
    # What travels down: the subroot and the root.
    tops = top.select(
        F.col("of").alias("grp"),
        F.lit(0).cast("long").alias("pos"),
        F.concat("digest", "tail").alias("tail"),
        "proof",
    )
    tops = saved(tops, "subroot-proofs")
    out = _downwards(up, tops, shape, ["id", *made])
    if len(up) == 1:
        out = leaves.join(tops.drop("pos"), "grp")
    return out.select(
        "id",
        F.col("digest").alias("leaf"),
        F.substring("tail", 1, 64).alias("subroot"),
        F.substring("tail", 65, 64).alias("root"),
        "proof",
        *[F.col(name).alias(k) for name, k in zip(made, carry)],
    )
