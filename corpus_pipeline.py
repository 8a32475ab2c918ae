"""The corpus pipeline: documents to packed training sequences.

Each stage takes all that the one before kept, stored as a table, and applies one
operator of ``tidemark.llm``; all but the last return the columns of ``documents``. What a
stage stored for itself is deleted as soon as the stage after it starts from a stored
table, so documents are on disk about twice.
"""

from __future__ import annotations

import functools
from urllib.parse import unquote

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.catalog import PACKING, quality_model
from tidemark.llm.exact import exact_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.near import Params, near_dedup
from tidemark.llm.packing import best_fit
from tidemark.llm.quality import scored_rows
from tidemark.llm.util import WORD, dropped, numbered, read, recording, row_of, saved
from tidemark.session import app_id


#: By application: what its last stage stored for itself.
_STORED: dict[str, list[DataFrame]] = {}


def _unread(tables: list[DataFrame], df: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The ``tables`` that ``df`` reads, and the others."""
    folders = {unquote(f).rsplit("/", 1)[0].rstrip("/") for f in df.inputFiles()}
    read_ = [t for t in tables if any(f.endswith(t.saved_at) for f in folders)]
    return read_, [t for t in tables if t not in read_]


def _stage(fn):
    """Deletes what the stage before stored for itself, and what this one needs no more."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _STORED.pop(app_id(spark), [])
        for table in _unread(before, docs)[1]:
            dropped(table)
        with recording() as made:
            out = fn(spark, docs, sf_dir)
        kept, rest = _unread(made, out)
        for table in rest:
            dropped(table)
        _STORED[app_id(spark)] = kept
        return out

    return run_stage


def _kept_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of numbered ``docs`` that ``judged`` (``row``, ``kept``) keeps. Those that go are
    far fewer as a rule, and no document moves as long as Spark can broadcast them. They are told
    by the kept ones: where ``kept`` compares two rows, Spark joins by both, so that
    the rows of a large group are dealt out."""
    row = docs.row_column
    kept = saved(judged.where("kept").select(F.col("row").alias(row)), "kept-rows")
    gone = saved(docs.select(row).join(kept, row, "left_anti"), "gone-rows")
    return docs.join(gone, row, "left_anti").drop(row)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go."""
    return scored_rows(docs, quality_model(docs, read(spark, sf_dir, "labels")))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    docs = numbered(docs)
    return _kept_rows(docs, exact_dedup(docs))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 80 per cent) stays."""
    docs = numbered(docs)
    return _kept_rows(docs, near_dedup(docs, Params(words=5, percent=80)))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a document, with the words taken in it."""
    given = numbered(docs)
    documents, _, spans = mix(given)
    taken = (
        spans.groupBy("row", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("spans"), F.sum("words").alias("words"))
        .join(documents.select("row", "size"), "row")
    )
    taken = saved(taken.drop("pass"), "taken")
    whole = given.select(row_of(given).alias("row"), F.struct(*docs.columns).alias("given"))
    text = F.col("given.text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    parts = F.transform("spans", lambda s: F.slice(words, (s["first"] + 1).cast("int"), s["words"].cast("int")))
    part = F.array_join(F.flatten(parts), " ")
    new = {"text": F.when(F.col("words") == F.col("size"), text).otherwise(part)}
    new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    out = whole.join(taken, "row")
    return out.select(*[new.get(c, F.col("given")[c]).alias(c) for c in docs.columns])


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and their place in it."""
    out = best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), PACKING)
    return out.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mix", mixed),
    ("pack", packed),
]

#: No SQL: the classifier, the MinHash signatures and the tokens are none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k + 1}")
    return docs
