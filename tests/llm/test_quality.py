import numpy as np
from llm.helpers import documents

from tidemark.llm import quality
from tidemark.llm.catalog import op6_quality_classifier, training_row
from tidemark.llm.quality import N_FEATURES, class_prior, features, fit, score, score_quality, scored_rows, train
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = op6_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    kept = np.mean([r["predicted"] for r in rows if r["quality"] == 1])
    assert len(rows) > 50 and right >= 0.97 and kept >= 0.99
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from tidemark.llm.catalog import quality_model

    changed = labels.withColumn("quality", F.when(training_row(F.col("doc_id")), F.col("quality")).otherwise(1))
    negatives = labels.withColumn("quality", F.when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("quality")))
    one = quality_model(docs, labels)
    for other in (quality_model(docs, changed), quality_model(docs, negatives)):
        assert all((a == b).all() for a, b in zip(one["weights"], other["weights"]))


def test_prior_and_risk_on_known_mixtures():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.6, 0.9):
        n = 4000
        positive = rng.normal(2, 1, (2000, 6))
        n_pos = int(prior * n)
        mixed = np.vstack([rng.normal(2, 1, (n_pos, 6)), rng.normal(-2, 1, (n - n_pos, 6))])
        truth = np.arange(n) < n_pos
        order = rng.permutation(n)
        mixed, truth = mixed[order], truth[order]
        assert abs(class_prior(positive, mixed) - prior) < 0.08
        model = train(positive, mixed)
        assert ((score(model, mixed) >= 0.5) == truth).mean() > 0.95


def test_edge_rows(spark):
    texts = [None, "", " \n ", "x", "w " * 200_000, "é" * 50_000, "A plain sentence of words."]
    docs = documents(spark, texts, ids=[None, 1, 2, 3, 3, 5, 6])
    model = fit(docs, docs.select(F.col("doc_id").alias("id")))
    out = score_quality(docs, model).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["id"] in (None, 1, 2)}) == 1
    assert scored_rows(docs, model).columns == docs.columns
    none = fit(docs, docs.select(F.col("doc_id").alias("id")).where("false"))
    assert none is None and {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    assert scored_rows(docs, None).count() == len(texts)
    empty = docs.where("false")
    assert score_quality(empty, fit(empty, empty.select(F.col("doc_id").alias("id")))).count() == 0


def test_features_cover_the_whole_text():
    text = "Plain words go here. " * 3000
    assert features(text).shape == (N_FEATURES,)
    assert not np.allclose(features(text), features(text + "ALL!! CAPS!! " * 3000))


def test_class_prior_has_as_many_halves_at_every_size(monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "_prior_once", lambda p, u, seed: seen.append(len(u)) or 0.5)
    for n in (50, 500, 20_000):
        quality.class_prior(np.zeros((40, 2)), np.zeros((n, 2)))
    assert [seen.count(n) for n in (50, 500, 20_000)] == [quality.SPLITS] * 3
