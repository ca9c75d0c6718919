import numpy as np
import pytest
from odd_rows import DOCUMENTS, documents, no_documents
from pyspark.sql import functions as F

from receivables.llm import quality_classifier as Q
from receivables.llm import queries

GOOD = ["the cat sat on the mat and looked at the moon", "a quiet day by the sea with friends"]
BAD = ["BUY!! NOW!! CHEAP!!", "win win win win win win", "### $$$ %%% &&&"]


def small_model():
    return Q.fit(GOOD * 30 + BAD * 30, [1] * 60 + [0] * 90)


def test_learns_and_scores_like_the_mean_of_all_features():
    model = small_model()
    texts = [*GOOD, *BAD, "the sea and the cat", "CHEAP!! CHEAP!!", "", None]
    scores = Q.Scorer(model).scores(texts)
    buckets = Q.Buckets()
    for text, score in zip(texts, scores):
        found = [place for word in Q.words_of(text) for place in Q.features(word, buckets)]
        mean = model.table[found].astype(float).mean() if found else 0.0
        assert score == pytest.approx(1 / (1 + np.exp(-(mean + model.bias))), rel=1e-5)
    assert scores[:2].min() > 0.7 and scores[2:5].max() < 0.3
    assert scores[5] > 0.5 > scores[6]
    assert scores[7] == scores[8]


def test_training_twice_gives_the_same():
    one, other = small_model(), small_model()
    assert one.bias == other.bias and (one.table == other.table).all()


def test_odd_rows(spark):
    model = small_model()
    rows = Q.score_quality(documents(spark), model, keep=("count",)).collect()
    assert len(rows) == len(DOCUMENTS)
    assert rows[0].__fields__ == ["doc_id", "count", "score", "predicted"]
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.7) for row in rows)
    found = {row.doc_id: row.score for row in rows}
    assert found[2] == found[3] == found[4] and found[1] == found[7]


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.train(documents(spark), labels)
    assert {row.score for row in Q.score_quality(documents(spark), model).collect()} == {0.5}
    one_class = spark.createDataFrame([(1, 1), (5, 1), (6, None)], "doc_id long, quality int")
    assert Q.train(documents(spark), one_class).bias == 0
    assert Q.score_quality(no_documents(spark), model).count() == 0


def test_training_sample_is_bounded(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    fit, Q.fit = Q.fit, lambda texts, labels: seen.append(labels) or fit(texts, labels)
    try:
        Q.train(docs.union(docs), labels, rows=10)
    finally:
        Q.fit = fit
    assert len(seen[0]) == 20 and sum(seen[0]) == 10  # ten ids of each class, copies count once


def test_repeated_ids_count_once(spark):
    """The model is that of the table without the copies, in documents and in labels."""
    texts = spark.range(300).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "calm day").otherwise("BUY NOW!!"), F.col("id")).alias("text"),
    )
    labels = texts.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("quality"))
    copies = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"))
    more_texts = texts.union(copies.join(texts, "doc_id"))
    more_labels = labels.union(copies.select("doc_id", F.lit(0)))
    plain = Q.train(texts, labels, rows=60)
    assert np.abs(plain.table).max() > 0
    for other in (Q.train(more_texts, labels, rows=60), Q.train(texts, more_labels, rows=60)):
        assert other.bias == plain.bias and (other.table == plain.table).all()


def test_characters_of_the_sample_are_bounded(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 100).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    fit, most, Q.fit, Q.MOST_CHARS = Q.fit, Q.MOST_CHARS, lambda texts, labels: seen.append(texts) or fit(texts, labels), 1000
    try:
        Q.train(docs, labels)
    finally:
        Q.fit, Q.MOST_CHARS = fit, most
    assert len(seen[0]) == 6  # three texts of 300 characters each, whole


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op2_quality_classifier(spark, sf_dir)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    right = rows.filter("held_out").join(labels, "doc_id").groupBy("quality").agg(
        F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("right")
    )
    assert min(row.right for row in right.collect()) >= 0.9
