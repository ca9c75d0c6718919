from collections import Counter
from math import log2

import pytest
from odd_rows import DOCUMENTS, documents, no_documents, tuples
from pyspark.sql import functions as F

from receivables.llm import language_id as L
from receivables.llm import queries

TREES = {
    "en": L.context_tree(Counter("the cat and the hat then sat at the mat".split())),
    "fr": L.context_tree(Counter("le chat et le chapeau été où était là".split())),
}


@pytest.mark.parametrize("context", [b"", b" ", b" t", b" th", b"the", b"\xff\xfe\xfd", b"th\xff"])
def test_chances_of_all_bytes_add_up_to_one(context):
    for tree in TREES.values():
        chances = [2 ** -L.code_length(tree, context + bytes([b])) for b in range(256)]
        assert abs(sum(chances) - 1) < 1e-9


def by_hand(tree, context, byte, excluded=frozenset()):
    """The chance of a byte, worked out from the counts by recursion."""
    counts = {b: n for b, n in tree.get(context, {}).items() if b not in excluded}
    if counts:
        total = sum(counts.values()) + len(counts)
        if byte in counts:
            return counts[byte] / total
        escape, excluded = len(counts) / total, excluded | counts.keys()
    else:
        escape = 1.0
    if context:
        return escape * by_hand(tree, context[1:], byte, excluded)
    return escape / (256 - len(excluded))


def test_code_lengths_by_hand():
    texts = ["the hat", "où était-il?", "zzz", "then\nthen", "ÿ"]
    coder = L.Coder(TREES, L.ORDER)
    for text in texts * 2:
        bits = coder.words.sums([text.split()])[0]
        for language, found in zip(coder.languages, bits):
            expected = 0.0
            for word in text.split():
                coded = b" " + word.encode() + b" "
                for i in range(1, len(coded)):
                    expected -= log2(by_hand(TREES[language], coded[max(0, i - 3) : i], coded[i]))
            assert found == pytest.approx(expected)


def test_caches_are_bounded():
    coder = L.Coder(TREES, L.ORDER)
    coder.words.most = 3
    texts = ["the cat", "le chat", "a b c d e", "the cat"] * 3
    assert coder.predict(texts) == L.Coder(TREES, L.ORDER).predict(texts)
    one_by_one = [coder.predict([text])[0][0] for text in texts]
    assert one_by_one == coder.predict(texts)[0]


def test_odd_rows(spark):
    rows = L.predict_language(documents(spark), TREES).collect()
    assert len(rows) == len(DOCUMENTS)
    found = {row.doc_id: row for row in rows}
    assert {i for i, row in found.items() if row.lang_pred == "und"} == {2, 3, 4, 10}
    assert all(0 <= row.score <= 1 for row in rows)
    assert all(row.score == 0 for row in rows if row.lang_pred == "und")
    assert found[1].lang_pred == "en" and found[1].score == found[7].score


def test_nothing_to_learn_from(spark):
    unlabelled = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert L.train(unlabelled) == {}
    rows = L.predict_language(documents(spark), {}).collect()
    assert {(row.lang_pred, row.score) for row in rows} == {("und", 0.0)}
    assert L.predict_language(no_documents(spark), L.train(no_documents(spark))).count() == 0


def test_training_is_bounded_and_whole(spark):
    rows = [(i, "a b", "x") for i in range(500)] + [(1000, "only one", "y"), (1000, "only one", "y")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = L.train(labelled, rows=20)
    assert sum(trees["x"][b" "].values()) == 2 * 20  # two words in each of 20 rows
    assert trees["y"][b" "] == {ord("o"): 2}  # both words begin with it; copies count once


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, sf_dir)
    assert rows.columns == ["doc_id", "held_out", "lang_pred", "score"]
    joined = rows.join(docs, "doc_id")
    assert joined.count() == docs.count()
    right = joined.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] >= 0.98
    held = {row.doc_id for row in rows.filter("held_out").collect()}
    from zlib import crc32

    assert held == {r.doc_id for r in docs.collect() if crc32(str(r.doc_id).encode()) % 4 == 2}


def test_same_answer_twice(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert tuples(queries.op9_language_id(spark, sf_dir)) == tuples(
        queries.op9_language_id(spark, sf_dir)
    )


def test_repeated_ids_count_once(spark):
    rows = [(i, f"the cat {i} sat", "en") for i in range(60)] + [(100 + i, f"le chat {i} est", "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copies = spark.range(10_000).select(F.lit(3).cast("long").alias("doc_id")).join(docs, "doc_id")
    plain = L.train(docs, rows=30)
    assert plain and L.train(docs.union(copies.select(*docs.columns)), rows=30) == plain


def test_words_are_the_same_in_training_and_prediction(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    text = "".join(f"w{i}{blank}" for i, blank in enumerate(blanks))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert L.train(docs) == {"en": L.context_tree(Counter(text.split()), L.ORDER)}
    assert len(text.split()) == len(blanks)
