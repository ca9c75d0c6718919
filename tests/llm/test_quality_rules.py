import re
from collections import Counter
from math import exp, log

import pytest
from odd_rows import CLASHING, DOCUMENTS, documents, no_documents
from pyspark.sql import functions as F

from receivables.llm import quality_rules as R
from receivables.llm import queries

TEXTS = [
    *[text for _, text in DOCUMENTS],
    "a b a b a b a b",
    "a a a a",
    "a b c",
    "a b c a b c",
    "x a b c y a b c z a b c",
    "one\n\none\n one\none \ntwo\n \n",
    "# * $ % & | < > ## a|b",
    "a  b\tc\x0bd\x1ce",
    "ÀÉ Æß straße 日本",
]


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts_by_hand(spark):
    rows = list(enumerate(TEXTS))
    found = R.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for row in found:
        expected = counts_by_hand(TEXTS[row.doc_id])
        assert tuple(row[name] for name in R.COUNTS[:5]) == expected, TEXTS[row.doc_id]


def test_repeats_are_exact_whatever_the_hashes(spark, monkeypatch):
    # The low 40 bits of the hashes of 'w2357113 b c' and 'w2753280 b c' are equal.
    hidden = "w2357113 b c x1 x2 w2753280 b c x3 x4 w2357113 b c"
    for bits, text in ((R.POSITION_BITS, hidden), (3, "p q r s t u v w x y z p q r"), (3, "a b c d " * 9)):
        monkeypatch.setattr(R, "POSITION_BITS", bits)
        row = R.counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert row.n_repeat_words == counts_by_hand(text)[4], text


def model_by_hand(seen):
    """The rounds over combinations of votes, in plain Python; their posteriors."""
    kinds = [kind for kind, _ in R.rules().values()]
    share, rates = R.SHARE, [R.GUESS[kind] for kind in kinds]

    def posterior(votes):
        evidence = log(share / (1 - share))
        for vote, (good, bad) in zip(votes, rates):
            evidence += log(good / bad) if vote else log((1 - good) / (1 - bad))
        return 1 / (1 + exp(-evidence))

    def within(value, bounds):
        return min(max(value, bounds[0]), bounds[1])

    for _ in range(R.ROUNDS):
        weighed = [(votes, n, n * posterior(votes)) for votes, n in seen]
        good = sum(g for _, _, g in weighed)
        bad = sum(n - g for _, n, g in weighed)
        new = []
        for i, kind in enumerate(kinds):
            on_good = sum(g for votes, _, g in weighed if votes[i])
            on_bad = sum(n - g for votes, n, g in weighed if votes[i])
            guess, bounds = R.GUESS[kind], R.BOUNDS[kind]
            new.append(
                (
                    within((on_good + R.WEIGHT * guess[0]) / (good + R.WEIGHT), bounds[0]),
                    within((on_bad + R.WEIGHT * guess[1]) / (bad + R.WEIGHT), bounds[1]),
                )
            )
        share = within((good + R.WEIGHT * R.SHARE) / (good + bad + R.WEIGHT), R.SHARE_BOUNDS)
        rates = new
    return {votes: posterior(votes) for votes, _ in seen}


def test_model_by_hand_and_verdicts_on_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    voted = R.counts(docs).withColumn("votes", R.votes())
    seen = [(tuple(v), n) for v, n in voted.groupBy("votes").count().collect()]
    posteriors = model_by_hand(seen)
    votes_of = {row.doc_id: tuple(row.votes) for row in voted.select("doc_id", "votes").collect()}
    judged = {row.doc_id: row for row in R.judge(docs).collect()}
    for doc_id, row in judged.items():
        assert row.posterior == pytest.approx(posteriors[votes_of[doc_id]], abs=1e-9)
        failed = row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
        assert row.base_failed == failed
        assert row.kept == (not failed and row.posterior >= 0.5)
    result = queries.op4_quality_rules(spark, sf_dir)
    assert result.columns == ["doc_id", *R.COUNTS[:5], "base_failed", "kept"]
    assert {row.doc_id: row.kept for row in result.collect()} == {
        i: row.kept for i, row in judged.items()
    }
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [row for i, row in judged.items() if labels.get(i) == 1 and not row.base_failed]
    junk = [row for i, row in judged.items() if labels.get(i) == 0]
    assert all(row.kept for row in clean)
    assert sum(row.kept for row in junk) <= 0.1 * len(junk)


def test_odd_rows(spark):
    rows = R.judge(documents(spark), keep=("count",)).collect()
    assert len(rows) == len(DOCUMENTS)
    found = {row.doc_id: row for row in rows}
    assert all(found[i].base_failed and not found[i].kept for i in (2, 3, 4, 6))
    assert found[1]["count"] == CLASHING["count"]
    assert found[5].n_words == 40_000 and found[5].n_repeat_words == 40_000
    assert R.judge(no_documents(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = R.judge(documents(spark)).select("kept")._jdf.queryExecution().executedPlan().toString()
    counts = R.counts(documents(spark)).filter(F.col("n_words") > 0)
    plan += counts._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
