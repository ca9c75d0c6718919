"""Payments reduced by a filter of known documents, and reports stored centre by centre."""

import datetime

import pytest
from helpers import credit_notes, in_any_order, invoices, payments
from pyspark.sql import functions as F

from receivables.operators import key_filter, payment_totals, payments_for, unify_documents
from receivables.plans import ageing_report
from receivables.sinks import clustered

DATE = datetime.date(2025, 4, 7)


def tables(spark, n, orphans):
    rows = [(f"d{i % n}", ("invoice", "credit_note")[i % 2], i % 9 + 1) for i in range(3 * n)]
    rows += [(f"lost{i}", "invoice", 5) for i in range(orphans)] + [(None, "invoice", 1), ("d1", None, 1)]
    return {
        "invoices": invoices(spark, *((f"d{i}", "2025-01-01", 40) for i in range(n)), (None, "2025-01-01", 3)),
        "credit_notes": credit_notes(spark, *((f"d{i}", "2025-02-01", 30) for i in range(0, n, 3))),
        "payments": payments(spark, *rows),
    }


def test_unknown_documents_are_left_out_and_results_stay(spark):
    inputs = tables(spark, 200, 5000)
    documents = unify_documents(inputs["invoices"], inputs["credit_notes"])
    kept = payments_for(inputs["payments"], documents)
    assert kept.columns == inputs["payments"].columns
    known = inputs["payments"].join(documents.select("document_id", "document_type").distinct(), ["document_id", "document_type"])
    assert known.count() <= kept.count() <= known.count() + 5
    assert known.select("id").subtract(kept.select("id")).count() == 0
    plan = payment_totals(kept)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2
    expected = ageing_report(**inputs, as_at_date=DATE)
    found = ageing_report(inputs["invoices"], inputs["credit_notes"], kept, DATE)
    assert in_any_order(found.collect()) == in_any_order(expected.collect()) != []


def test_size_of_the_filter(spark):
    inputs = tables(spark, 300, 0)
    documents = unify_documents(inputs["invoices"], inputs["credit_notes"])
    for bits in (8, 10, 24):
        words = key_filter(documents, bits).collect()
        assert len(words) <= 1 << (bits - 6) and len({w.word for w in words}) == len(words)
    # Too many documents for the bits: all payments, unfiltered.
    assert payments_for(inputs["payments"], documents, bits=8).count() == inputs["payments"].count()
    with pytest.raises(ValueError, match="2\\^27"):
        key_filter(documents, 28)
    empty = documents.limit(0)
    assert payments_for(inputs["payments"], empty).count() == 0


def test_a_centre_lies_in_few_files_and_a_large_one_in_several_tasks(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 8).withColumn("n", F.col("id"))
    # Centre 0 has a third of all rows.
    centre = F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n") % 20).cast("string")
    report = rows.select(
        centre.alias("centre_id"), (F.col("n") % 7).cast("string").alias("class_id"),
        F.concat(F.lit("d"), "n").alias("document_id"), F.lit("invoice").alias("document_type"),
    )
    settings = {
        "spark.sql.shuffle.partitions": "24",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        clustered(report).write.parquet(str(tmp_path / "clustered"))
        report.repartition(24).write.parquet(str(tmp_path / "plain"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

    def files(folder):
        file = F.input_file_name().alias("file")
        return (
            spark.read.parquet(str(tmp_path / folder))
            .groupBy(file)
            .agg(F.min("centre_id").alias("low"), F.max("centre_id").alias("high"), F.count("*").alias("n"))
            .collect()
        )

    kept, plain = files("clustered"), files("plain")
    assert max(f.n for f in kept) < 2.5 * 40_000 / len(kept) and len(kept) >= 20

    def to_read(found, centre):  # whose footers do not rule the centre out
        return sum(f.n for f in found if f.low <= centre <= f.high)

    for centre in ("7", "13"):
        assert to_read(plain, centre) == 40_000 and to_read(kept, centre) < 8_000
    assert to_read(kept, "0") >= 40_000 / 3
    again = spark.read.parquet(str(tmp_path / "clustered"))
    assert again.exceptAll(report).count() == report.exceptAll(again).count() == 0
