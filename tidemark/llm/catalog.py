"""The registered queries of this package, and their SQL where SQL can tell.

Each query applies its operator to a whole table with the operator's production
parameters and derives the columns it returns from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import align
from tidemark.llm.exact import exact_dedup
from tidemark.llm.manifest import digest, folded, leaf_digest, manifest, proof_text
from tidemark.llm.mixing import mix
from tidemark.llm.near import Params, near_dedup
from tidemark.llm.packing import Capacity, best_fit
from tidemark.llm.quality import fit, score_quality
from tidemark.llm.quotes import link_quotes
from tidemark.llm.repeats import without_repeats
from tidemark.llm.rules import judge
from tidemark.llm.secrets import scan_secrets
from tidemark.llm.sharding import shard_documents
from tidemark.llm.util import read
from tidemark.llm.vectors import near_vectors

#: Token capacity decides; the other two only tell equal residuals apart.
PACKING = Capacity(tokens=4096, documents=4096, attention=4096.0**2, weights=(1.0, 1e-4, 1e-4))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    found = scan_secrets(read(spark, sf_dir, "documents"))

    def told(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        F.col("id").alias("doc_id"),
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        number("entropy").alias("n_entropy"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 or more between all rows of ``embeddings``."""
    out = near_vectors(read(spark, sf_dir, "embeddings"), least=0.9)
    return out.select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the bytes that 200-byte repeats cover."""
    out = without_repeats(read(spark, sf_dir, "documents"), length=200)
    gone = F.transform("removed", lambda s: s["hi"] - s["lo"])
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` linked by 4-word shingles at 80 per cent."""
    out = near_dedup(read(spark, sf_dir, "documents"), Params(words=4, percent=80))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def training_row(doc_id: Column) -> Column:
    """Whether labels may be learned from the row."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def quality_model(documents: DataFrame, labels: DataFrame) -> dict | None:
    """A model from the rows of ``documents`` that labels may be learned from."""
    allowed = training_row(F.col("doc_id"))
    trusted = labels.where(allowed & (F.col("quality") == 1)).select(F.col("doc_id").alias("id"))
    return fit(documents.where(allowed), trusted)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text of ``documents``."""
    documents = read(spark, sf_dir, "documents")
    model = quality_model(documents, read(spark, sf_dir, "labels"))
    return score_quality(documents, model).select(
        F.col("id").alias("doc_id"),
        (~training_row(F.col("id"))).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered ``conversations`` without quotes; ``path`` gives the order."""
    out = link_quotes(read(spark, sf_dir, "conversations"))
    spot = F.element_at("path", -2)
    return out.select(
        "given.conv_id",
        "given.turn",
        "given.role",
        F.when(F.size("path") > 1, spot["conv"]).alias("parent_conv_id"),
        F.when(F.size("path") > 1, spot["turn"]).alias("parent_turn"),
        F.element_at("path", 1)["conv"].alias("root_conv_id"),
        F.element_at("path", 1)["turn"].alias("root_turn"),
        "depth",
        F.array_join(
            F.transform("path", lambda p: F.concat_ws(":", p["conv"], p["turn"])), "/"
        ).alias("path"),
        F.col("linked").alias("n_linked"),
        F.col("clean").alias("clean_text"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    out = best_fit(read(spark, sf_dir, "documents"), vocabulary, PACKING)
    return out.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of ``documents`` with row counts at most one apart."""
    out = shard_documents(read(spark, sf_dir, "documents"), shards=40)
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "grp",
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    documents, sources, spans = mix(read(spark, sf_dir, "documents"))
    taken = spans.groupBy("row").agg(F.sum("words").alias("taken"))
    sources = sources.select("source", "source_size", "target")
    out = documents.join(taken, "row", "left")
    return out.join(sources, out["source"].eqNullSafe(sources["source"])).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document."""
    return exact_dedup(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and compression bands of every text of ``documents``."""
    return judge(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: The fields of a leaf.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of ``documents``, and the check of a third of them, tampered with."""
    documents = read(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_digest(*[lowered if c == "text" else F.col(c) for c in LEAF])
    out = manifest(documents, LEAF, "doc_id", "lang", {"claimed": F.when(chosen, tampered)})
    out = out.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return out.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        digest(proof_text(F.col("proof"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every text of ``documents`` by two tokenizers, aligned."""
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    out = align(read(spark, sf_dir, "documents"), *paths)
    return out.documents.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_balanced_shards": op5_balanced_shards,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mix_sources": op7_mix_sources,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quotation_linking": op9_quotation_linking,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_quality_rules": op11_quality_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}

ORACLE_SQL = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE
        v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        p AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ),
        r(vec_id, seen) AS (
            SELECT vec_id, vec_id FROM v
            UNION
            SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.seen
        ),
        n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
        SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(seen) AS component_id,
               r.vec_id = min(seen) AS kept
        FROM r LEFT JOIN n USING (vec_id) GROUP BY r.vec_id
    """,
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE
        w AS (
            SELECT doc_id, list_filter(
                string_split_regex(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS w
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2),
                                    lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        hits AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ),
        p AS (
            SELECT a, b FROM hits JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * c >= 80 * (x.n + y.n - c)
        ),
        r(doc_id, seen) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.seen
        )
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id,
               r.doc_id = min(seen) AS kept
        FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE
        f AS (
            SELECT *, list_reduce(
                list_prepend(4294967295, list_transform(
                    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
                ) AS crc,
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                || coalesce(octet_length(encode(source)) || ':' || source, '-')
                || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
                || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
            FROM documents
        ),
        h AS (
            SELECT doc_id, coalesce('=' || lang, '') AS g,
                   sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) AS lowered,
                   xor(crc, 4294967295) % 3 = 0 AS tampered
            FROM f
        ),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY g) AS n
            FROM h
        ),
        t(g, level, pos, n, d) AS (
            SELECT g, 0, pos, n, leaf FROM leaves
            UNION ALL
            SELECT g, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY pos))
            FROM t WHERE n > 1 GROUP BY g, level, pos // 8
        ),
        subs AS (
            SELECT g, d, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n
            FROM t WHERE n = 1
        ),
        u(level, pos, n, d) AS (
            SELECT 0, pos, n, d FROM subs
            UNION ALL
            SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY pos))
            FROM u WHERE n > 1 GROUP BY level, pos // 8
        ),
        steps AS (
            SELECT a.g, a.level, a.pos,
                   coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
            FROM t a JOIN t b ON a.g = b.g AND a.level = b.level AND a.pos // 8 = b.pos // 8
            WHERE a.n > 1 GROUP BY a.g, a.level, a.pos
        ),
        over AS (
            SELECT a.level, a.pos,
                   coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
            FROM u a JOIN u b ON a.level = b.level AND a.pos // 8 = b.pos // 8
            WHERE a.n > 1 GROUP BY a.level, a.pos
        ),
        way AS (
            SELECT doc_id, l.g, l.pos, s.level, s.before, s.after FROM leaves l
            JOIN steps s ON s.g = l.g AND s.pos = l.pos // CAST(pow(8, s.level) AS BIGINT)
            UNION ALL
            SELECT doc_id, l.g, l.pos, 1000 + o.level, o.before, o.after FROM leaves l
            JOIN subs ON subs.g = l.g
            JOIN over o ON o.pos = subs.pos // CAST(pow(8, o.level) AS BIGINT)
        ),
        proofs AS (
            SELECT g, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS p,
                   list({'b': before, 'a': after} ORDER BY level) AS path
            FROM way GROUP BY g, pos
        ),
        folds AS (
            SELECT l.*, coalesce(p, sha256('')) AS p, subs.d AS subroot,
                   list_reduce(list_prepend({'b': CASE WHEN tampered THEN lowered ELSE leaf END, 'a': ''},
                                            coalesce(path, [])),
                               lambda x, s: {'b': sha256(s['b'] || x['b'] || s['a']), 'a': ''})['b'] AS folded
            FROM leaves l JOIN subs ON subs.g = l.g
            LEFT JOIN proofs ON proofs.g = l.g AND proofs.pos = l.pos
        )
        SELECT doc_id, leaf, subroot, root.d AS root, p AS proof_sha256, folded AS folded_root,
               folded = root.d AS verified
        FROM folds, (SELECT d FROM u WHERE n = 1) root
    """,
    "op8_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM n
    """,
}
