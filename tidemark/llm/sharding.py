"""Balanced label propagation: documents to shards (DataFrame functions only).

Rows with equal texts are linked. Every linked row begins in a hashed shard; in
each round, until none asks to move, the rows of a group move towards the shards that
hold most of the group, as many as it fills, as far as the quotas allow. Rows that are equal in text are equal
for this, so a round works on the number of a group's rows in each shard, and rows are
told their shard at the end. Rows without links fill the shards
up. In the end the shards' row counts are at most one apart.

Defined cases: a null text is linked with nothing and counts 16 bytes; empty
texts are equal; a group larger than a shard is gathered in
as many shards as it fills; repeated rows are separate rows of one group; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import buckets_for, dropped, running, saved, small_table


def _by_shard(parts: DataFrame, column: str, value: str) -> dict[int, int]:
    """Sum of ``value`` for each shard: as many rows as there are shards."""
    rows = parts.groupBy(column).agg(F.sum(value).alias("v")).collect()
    return {r[column]: r["v"] for r in rows if r[column] is not None}


def _wishes(parts: DataFrame, shards: int, free: list[int], k: int) -> DataFrame:
    """Adds ``goal`` and ``ask``, the rows that want to move there in round ``k``. The goals of a
    group are the shards with room that hold most of it, as many as its rows fill; each of
    its other parts asks for one of them. A group has at most ``shards`` rows here."""
    turn = F.pmod(F.xxhash64("grp"), F.lit(shards))
    room = F.element_at(F.array(*[F.lit(f) for f in free]), F.col("shard") + 1)
    # Rows of the group in the shard, then a place that differs by group; null without room.
    place = F.pmod(F.col("shard") + turn, F.lit(shards))
    rank = F.when(room > 0, F.struct("n", place.alias("place"), "shard"))
    per = Window.partitionBy("grp")
    wish = parts.withColumn("rank", rank).withColumn("fits", F.when(room > 0, F.col("n") + room))
    wish = wish.withColumn("best", F.max("rank").over(per))
    staying = F.col("rank").isNull() & (F.col("n") > F.col("best.n"))
    wish = wish.withColumn("moving", F.sum(F.when(staying, 0).otherwise(F.col("n"))).over(per))
    higher = per.orderBy(F.col("rank").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("fits").over(higher), F.lit(0))
    wish = wish.withColumn("first", F.col("rank").isNotNull() & (before < F.col("moving")))
    wish = wish.withColumn("goals", F.sort_array(F.collect_list(F.when(F.col("first"), F.col("rank"))).over(per)))
    drawn = F.get("goals", F.pmod(F.xxhash64("grp", "shard", F.lit(-k)), F.greatest(F.size("goals"), F.lit(1))).cast("int"))
    goal = F.when(F.col("n") <= drawn["n"], drawn).otherwise(F.col("best"))
    wish = wish.withColumn("to", goal)
    moves = ~F.col("first") & (F.col("n") <= F.col("to.n"))
    wish = wish.withColumn("ask", F.when(moves, F.col("n")).otherwise(0)).withColumn("goal", F.col("to.shard"))
    return wish.select("grp", "shard", "n", "goal", "ask")


def propagate(linked: DataFrame, shards: int, quota: int) -> DataFrame:
    """``grp, shard, n``: how many rows of each group of ``linked`` (``row, grp``) go to each shard.

    A round moves, for each shard, as many of the rows that ask to join it as
    fit under ``quota``: each part of a group moves its share, rounded by a hash. Rows
    only move to a part that is not smaller, so the squares of the parts grow and the
    rounds end.
    """
    first = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    now = linked.groupBy("grp", first.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    now = saved(now, "parts")
    for k in count():
        load = _by_shard(now, "shard", "n")
        free = [quota - load.get(s, 0) for s in range(shards)]
        # A shard that is all but full draws nobody, so that its groups turn to another.
        wishes = _wishes(now, shards, [f if f > quota // 20 else 0 for f in free], k)
        asked = _by_shard(wishes.where("ask > 0"), "goal", "ask")
        if not asked:
            return now
        part = [min(1.0, max(0, free[s]) / asked.get(s, 1)) for s in range(shards)]
        share = F.element_at(F.array(*[F.lit(float(x)) for x in part]), F.col("goal") + 1)
        draw = F.pmod(F.xxhash64("grp", "shard", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        going = F.least(F.col("ask"), F.floor(F.col("ask") * share + draw))
        moved = wishes.withColumn("going", F.when(F.col("ask") > 0, going).otherwise(0)).select(
            "grp",
            F.explode(
                F.array(
                    F.struct(F.col("shard"), (F.col("n") - F.col("going")).alias("n")),
                    F.struct(F.col("goal").alias("shard"), F.col("going").alias("n")),
                )
            ).alias("to"),
        )
        after = moved.where("to.n > 0").groupBy("grp", F.col("to.shard").alias("shard"))
        after = saved(after.agg(F.sum("to.n").alias("n")), "parts")
        dropped(now)
        now = after


def _labelled(linked: DataFrame, parts: DataFrame, buckets: int) -> DataFrame:
    """``row, shard``: the rows of each group dealt to its shards, in order of their rank."""
    per = Window.partitionBy("grp").orderBy("shard")
    ends = F.sum("n").over(per.rowsBetween(Window.unboundedPreceding, 0))
    ranges = parts.select("grp", "shard", (ends - F.col("n")).alias("lo"), ends.alias("hi"))
    ranked = running(linked, ["grp"], ["row"], buckets, "rank")
    inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(ranges, "grp").where(inside).select("row", "shard")


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, size, text_crc32, grp, shard, slot`` for every row.

    ``size``: UTF-8 bytes plus 16; ``grp``: SHA-256 of the text (null for a null
    text); ``slot``: place in the shard, gapless from 0.
    """
    text = F.col(text_col).cast("binary")
    slim = saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
            F.sha2(text, 256).alias("grp"),
        ),
        "shard-rows",
    )
    rows = slim.count()
    buckets = buckets_for(rows)
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    groups = slim.where("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    linked = slim.select("row", "grp").join(groups.where("n > 1").select("grp"), "grp")
    linked = saved(linked.select("row", "grp"), "linked")
    parts = propagate(linked, shards, quota[-1])
    labels = _labelled(linked, parts, buckets)

    # What is over a shard's quota joins the rows without links ...
    limit = F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard") + 1)
    placed = saved(
        running(labels, ["shard"], ["row"], buckets, "slot").where(
            F.col("slot") < limit
        ),
        "placed",
    )
    held = _by_shard(placed.withColumn("one", F.lit(1)), "shard", "one")
    rest = slim.select("row").join(placed.select("row"), "row", "left_anti")
    rest = running(rest, [], ["row"], buckets, "rank")
    # ... and they fill the shards up in turn: a table of ``shards`` rows says where each begins.
    gaps, at = [], 0
    for s in range(shards):
        gap = quota[s] - held.get(s, 0)
        if gap:
            gaps.append((s, at, at + gap, held.get(s, 0)))
            at += gap
    gaps = small_table(docs.sparkSession, gaps, shard="int", lo="long", hi="long", held="long")
    filled = rest.join(
        F.broadcast(gaps), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    ).select("row", "shard", (F.col("held") + F.col("rank") - F.col("lo")).alias("slot"))
    return slim.join(placed.unionByName(filled), "row").drop("row")
