"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Each normalised text is cut at content-defined places; a chunk's hash is
verified against the chunk's own characters, and the few hashes that stand
for more than one chunk get ordinals. A text is then its ordered list of chunk
identifiers, and equal lists mean equal texts. Texts move once, as chunks that
are already counted per map task; all later steps move identifier lists.

Defined cases: a null text is an empty one; empty texts are equal to each
other and have the empty recipe; the row that stays is the one with the
smallest id (null ids last); of repeated rows (same id, same text) one stays;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import SPACE, numbered, row_of, saved

#: A chunk ends, after 64 characters, where a mark follows one of a few letters, or at
#: 4096. Such places are several times rarer than 64 characters, so two texts cut
#: apart by an edit soon have their cuts in common again.
CHUNK = r"(?s).{64,4095}?[abcdg][.!?;:]|.{64,4095}?[。！？।؟]|.{1,4096}"


def normalised(text: Column) -> Column:
    """White-space runs replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; together the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_store(
    docs: DataFrame, text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """Distinct chunks ``(hash, chunk, copies)``, compared by their characters."""
    norm = docs.select(normalised(F.col(text_col)).alias("norm"))
    each = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    return (
        each.withColumn("hash", chunk_hash(F.col("chunk")))
        .groupBy("hash", "chunk")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def recipes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: ``row`` (a number of its own), ``id``, ``recipe``
    (verified chunk identifiers in order), ``sha256`` of the normalised text and ``n_chunks``."""
    shared = (
        chunk_store(docs, text_col, chunk_hash)
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("hash")
    )
    shared = saved(shared, "shared-hashes")
    collide = not shared.isEmpty()
    if collide:  # the texts are read twice
        docs = numbered(docs, id_col, text_col)
    norm = docs.select(
        row_of(docs).alias("row"),
        F.col(id_col).alias("id"),
        normalised(F.col(text_col)).alias("norm"),
    )
    told = norm.select(
        "row",
        "id",
        F.transform(chunks(F.col("norm")), lambda c: chunk_hash(c)).alias("recipe"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("sha256"),
    )
    listed = saved(told.withColumn("n_chunks", F.size("recipe").cast("long")), "recipes")
    if not collide:
        return listed
    return _with_ordinals(docs, listed, shared, id_col, text_col, chunk_hash)


def _with_ordinals(docs, listed, shared, id_col, text_col, chunk_hash) -> DataFrame:
    """Recipes whose hashes are followed by the places of those chunks that share
    their hash with others, and by the number of hashes, so that equal recipes are equal in both
    parts. Only those chunks move again."""
    # Rows are numbered before they are opened.
    norm = docs.select(row_of(docs).alias("row"), normalised(F.col(text_col)).alias("norm"))
    each = norm.select("row", F.posexplode(chunks(F.col("norm"))).alias("at", "chunk"))
    each = each.withColumn("hash", chunk_hash(F.col("chunk")))
    each = saved(each.join(shared, "hash", "left_semi"), "shared-chunks")
    # The chunks of one hash are few: any two of them are a collision.
    names = (
        each.groupBy("hash")
        .agg(F.sort_array(F.collect_set("chunk")).alias("all"))
        .select("hash", F.posexplode("all").alias("ordinal", "chunk"))
    )
    told = (
        each.join(names, ["hash", "chunk"])
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("at", "ordinal"))).alias("told"))
    )
    ordinals = F.transform(F.col("told"), lambda x: x["ordinal"].cast("long"))
    return (
        listed.join(told, "row", "left")
        .withColumn(
            "recipe",
            F.concat("recipe", F.coalesce(ordinals, F.array().cast("array<long>")), F.array("n_chunks")),
        )
        .drop("told")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256, n_chunks, row`` for every row."""
    listed = recipes(docs, id_col, text_col, chunk_hash)
    per_id = listed.groupBy("recipe", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("row")
    )
    groups = per_id.groupBy("recipe").agg(
        F.min("id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.coalesce(F.min_by("row", "id"), F.min("row")).alias("keep_row"),
    )
    return listed.join(groups, "recipe").select(
        "id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "n_chunks",
        "row",
    )
