"""Mixing sources to target weights (DataFrame functions only).

The words of each source, documents in a hashed order, are packed into blocks
of a fixed length. A source takes whole passes over its blocks and part of a
last pass, each pass in the order of a pseudorandom permutation of the block
index. All slots of all sources are dealt to output shards by one more
permutation: the source counts of a shard are a multinomial draw conditioned
on every source reaching its target. Blocks are then joined by index.

Defined cases: a null text has no words and is never taken; a null source is a
source of its own, ordered last; repeated rows are separate documents with
words of their own; an empty table, or one without words, gives targets of 0;
other columns are not read. The same input gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import WORD, buckets_for, permuted, row_of, running, saved

BLOCK_WORDS = 512
SLOTS_PER_SHARD = 4096


def target_sizes(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Adds ``src`` (0-based place), ``weight`` and ``target`` to ``(source, source_size)``.

    The sources share ``share`` times all sizes by weight; none gets more than
    ``most`` times its own size, and what is cut goes to the others by weight.
    In closed form: sources are capped in the order of size by weight, up to
    the level at which the rest is shared. One row per source, so the
    table is small.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = sizes.withColumn(
        "src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    listed = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.withColumn(
        "weight", F.element_at(listed, (F.col("src") % len(weights) + 1).cast("int"))
    ).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = placed.withColumn(
        "budget", share * F.sum("source_size").over(whole)
    ).withColumn("all_weight", F.sum("weight").over(whole)).withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    first_free = F.first(free, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least("cap", F.coalesce(first_free * F.col("weight"), F.col("cap")))
    return levels.withColumn("target", target).drop("cap", "budget", "all_weight", "level")


def word_blocks(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int
) -> tuple[DataFrame, DataFrame]:
    """``(documents, sources)``: documents with ``row, id, src, size`` and
    ``at``, the words of the source before the document; sources with
    ``source, src, source_size, weight, target``."""
    slim = saved(
        docs.select(
            row_of(docs).alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))
            .cast("long")
            .alias("size"),
        ),
        "mix-sizes",
    )
    return slim, slim.groupBy("source").agg(F.sum("size").alias("source_size"))


def slots(sources: DataFrame, block_words: int, seed: int, slots_per_shard: int) -> DataFrame:
    """One row per slot of the mix: ``shard, place, src, pass, block, words``.

    A pass over a source is its whole blocks in permuted order, then its short
    last block. ``words`` is the block's length but for the last slot of a source,
    which takes the rest of the target. No block is taken more often than
    target / size, rounded up.
    """
    size, ln = F.col("source_size"), F.lit(block_words).cast("long")
    plan = (
        sources.where("source_size > 0")
        .withColumn("goal", F.round("target").cast("long"))
        .withColumn("whole", F.floor(size / ln))
        .withColumn("tail", size % ln)
        .withColumn("per_pass", F.col("whole") + (F.col("tail") > 0).cast("long"))
        .withColumn("passes", F.floor(F.col("goal") / size))
        .withColumn("rest", F.col("goal") % size)
        .withColumn("n", F.col("passes") * F.col("per_pass") + F.ceil(F.col("rest") / ln))
        .where("n > 0")
    )
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = plan.withColumn("all", F.sum("n").over(whole))
    # A source with many slots is opened in two steps, so that no task opens them all.
    step = 1024
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = plan.withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step)))
    ).repartition(parts, "src", "run")
    each = runs.withColumn(
        "j",
        F.explode(
            F.sequence(F.col("run") * step, F.least((F.col("run") + 1) * step, F.col("n")) - 1)
        ),
    )
    each = (
        each.withColumn("pass", F.floor(F.col("j") / F.col("per_pass")))
        .withColumn("pos", F.col("j") % F.col("per_pass"))
        .withColumn(
            "block",
            F.when(
                F.col("pos") < F.col("whole"),
                permuted(
                    F.col("pos"), F.col("whole"), F.lit(seed), F.col("src"), F.col("pass")
                ),
            ).otherwise(F.col("whole")),
        )
        .withColumn("out", permuted(F.col("first") + F.col("j"), F.col("all"), F.lit(seed)))
    )
    length = F.when(F.col("pos") < F.col("whole"), ln).otherwise(F.col("tail"))
    left = F.col("rest") - F.col("pos") * ln
    words = F.when(F.col("pass") == F.col("passes"), F.least(length, left)).otherwise(length)
    return each.select(
        F.floor(F.col("out") / slots_per_shard).alias("shard"),
        (F.col("out") % slots_per_shard).alias("place"),
        "src",
        "pass",
        "block",
        words.alias("words"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    slots_per_shard: int = SLOTS_PER_SHARD,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, sources, spans)``.

    ``documents``: ``row, id, src, size``; ``sources``: :func:`target_sizes`; ``spans``:
    ``row, shard, place, pass, first, words``: the slot ``place`` of ``shard``
    takes ``words`` words of the document from its word ``first`` on.
    """
    slim, totals = word_blocks(docs, id_col, text_col, source_col, block_words)
    sources = saved(target_sizes(totals, weights, share, most), "mix-sources")
    placed = slim.join(sources.select("source", "src"), slim["source"].eqNullSafe(sources["source"]))
    placed = placed.select("row", "id", "src", "size")
    # Rows of one source are dealt by hash; row numbers break the ties of equal ids.
    n = buckets_for(slim.count())
    placed = running(placed, ["src"], ["id", "row"], n, "at", F.col("size"))
    ln = F.lit(block_words).cast("long")
    parts = placed.where("size > 0").withColumn(
        "block",
        F.explode(
            F.sequence(F.floor(F.col("at") / ln), F.floor((F.col("at") + F.col("size") - 1) / ln))
        ),
    )
    # Stored, so that the join goes by the slots' true size, not by that of the sources.
    taken = saved(slots(sources, block_words, seed, slots_per_shard), "slots")
    begin = F.greatest(F.col("at"), F.col("block") * ln)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * ln + F.col("words"))
    spans = (
        parts.join(taken, ["src", "block"])
        .withColumn("first", begin - F.col("at"))
        .withColumn("words", end - begin)
        .where("words > 0")
        .select("row", "shard", "place", "pass", "first", "words")
    )
    return slim, sources, spans
