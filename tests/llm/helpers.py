from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        T.StructField("id", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("shard", T.StringType()),
    ]
)


def documents(spark, texts, sources=None, ids=None):
    """A documents table with clashing extra columns; stored, as the operators ask."""
    from tidemark.llm.util import saved

    rows = []
    for i, text in enumerate(texts):
        doc_id = ids[i] if ids else i
        source = sources[i] if sources else "s"
        rows.append((doc_id, text, None, source, None if text is None else len(text), "x", "x", None, "x", "x", "x"))
    return saved(spark.createDataFrame(rows, DOCS), "test-documents")
