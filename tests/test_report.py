import datetime
import random
from decimal import Decimal

import golden
import pytest
from helpers import REPORT, credit_notes, expected_report, in_any_order, invoices, payments
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from receivables import fixtures
from receivables.functions import AGE_BUCKETS
from receivables.operators import outstanding_documents, sort_report, unify_documents, with_days
from receivables.plans import ageing_report, ageing_report_from_views, publish_ageing_report
from receivables.schemas import CREDIT_NOTES, INVOICES, PAYMENTS
from receivables.sources import read_csv_report, read_report, register_views

CASES = [golden.SMALL, golden.LARGER]
SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("case", CASES)
def test_golden_report_in_order(spark, case):
    report = sort_report(ageing_report(**golden.tables(spark, case), as_at_date=case["as_at_date"]))
    expected = spark.createDataFrame(golden.report_rows(case), REPORT)
    assertDataFrameEqual(report, expected, checkRowOrder=True)
    assert [tuple(row) for row in report.collect()] == golden.report_rows(case)


@pytest.mark.parametrize("case", CASES)
def test_golden_report_from_views(spark, case):
    register_views(golden.tables(spark, case))
    report = ageing_report_from_views(spark, case["as_at_date"])
    assert in_any_order(report.collect()) == in_any_order(golden.report_rows(case))
    owed = spark.sql("SELECT count(*) AS n FROM outstanding_documents").first().n
    assert owed == len(golden.report_rows(case))
    kinds = spark.sql("SELECT DISTINCT document_type FROM all_documents").collect()
    assert sorted(row[0] for row in kinds) == ["credit_note", "invoice"]


def random_tables(seed, documents, paid):
    """Few ids, so that copies, ids of both types, orphans and settled ones occur."""
    rng = random.Random(seed)
    ids = [f"d{i}" for i in range(documents // 2)] + [None]
    as_at = datetime.date(2024, 2, 29)

    def amount(low):
        return rng.choice([None] + [Decimal(rng.randrange(low, 400)) / 10 for _ in range(9)])

    def date():
        return rng.choice([None] + [as_at - datetime.timedelta(rng.randrange(-40, 260))] * 9)

    def text(prefix):
        return rng.choice([f"{prefix}{rng.randrange(4)}", None, f"{prefix}{rng.randrange(4)}"])

    def document():
        return (rng.choice(ids), text("c"), text("k"), text("s"), date(), amount(-50))

    kinds = ["invoice", "credit_note", "credit_note", "invoice", None, "other"]
    return as_at, (
        [document() for _ in range(documents)],
        [document() for _ in range(documents)],
        [
            (f"p{i}", rng.choice([*ids, "orphan"]), rng.choice(kinds), amount(-30), date())
            for i in range(paid)
        ],
    )


@pytest.mark.parametrize("seed", range(4))
def test_random_tables_against_plain_python(spark, seed):
    as_at, rows = random_tables(seed, documents=300, paid=200 * (seed + 1))
    tables = [
        spark.createDataFrame(r, schema)
        for r, schema in zip(rows, (INVOICES, CREDIT_NOTES, PAYMENTS))
    ]
    report = ageing_report(*tables, as_at)
    expected = in_any_order(expected_report(*rows, as_at))
    assert len(expected) > 50
    assert in_any_order(report.collect()) == expected
    assert in_any_order(sort_report(report).collect()) == expected


def test_invariants_on_generated_tables(spark):
    tables = fixtures.load_inputs(spark, SF_DIR)
    owed = with_days(
        outstanding_documents(
            unify_documents(tables["invoices"], tables["credit_notes"]), tables["payments"]
        ),
        fixtures.AS_AT_DATE,
    )
    report = ageing_report(**tables, as_at_date=fixtures.AS_AT_DATE)
    amounts = [F.col(bucket.column) for bucket in AGE_BUCKETS]
    filled = sum((amount != 0).cast("int") for amount in amounts)
    joined = report.withColumn("total", sum(amounts)).withColumn("filled", filled).join(
        owed.select("document_id", "document_type", "outstanding_amount", "days_outstanding"),
        ["document_id", "document_type"],
    )
    past = F.col("days_outstanding") >= 0
    counts = joined.agg(
        F.count("*").alias("rows"),
        F.max("filled").alias("most_filled"),
        F.count_if(past & (F.col("total") != F.col("outstanding_amount").cast("double"))).alias(
            "wrong_total"
        ),
        F.count_if(~past & (F.col("total") != 0)).alias("future_filled"),
    ).first()
    assert counts.rows == owed.count() == report.count() == 20201
    assert (counts.most_filled, counts.wrong_total, counts.future_filled) == (1, 0, 0)


@pytest.mark.parametrize("case", CASES)
def test_publish(spark, tmp_path, case):
    store, base = str(tmp_path / "store"), str(tmp_path / "report")
    date = case["as_at_date"]
    warnings = publish_ageing_report(golden.tables(spark, case), date, store, base)
    assert warnings == []
    expected = in_any_order(golden.report_rows(case))
    assert in_any_order(read_report(spark, store, date).collect()) == expected
    assert in_any_order(read_csv_report(spark, base, date).collect()) == expected


def test_publish_returns_warnings_of_inputs_and_report(spark, tmp_path):
    inputs = {
        "invoices": invoices(spark, ("a", None, 5), ("b", "2025-01-01", None)),
        "credit_notes": credit_notes(spark, ("c", "2025-01-01", 1)),
        "payments": payments(spark, ("a", "invoice", 1)),
    }
    date = datetime.date(2025, 2, 1)
    warnings = publish_ageing_report(inputs, date, str(tmp_path / "store"))
    assert [(w.table_name, w.column_name, w.violations) for w in warnings] == [
        ("invoices", "invoice_date", 1),
        ("invoices", "total_amount", 1),
        ("ageing_report", "document_date", 1),
    ]


def test_publish_refuses_a_date_as_text_before_any_job(spark, tmp_path):
    # A job would find the empty table first.
    inputs = {**golden.tables(spark, golden.SMALL), "invoices": invoices(spark)}
    with pytest.raises(TypeError, match="2025-04-07"):
        publish_ageing_report(inputs, "2025-04-07", str(tmp_path / "store"))


def test_publish_leaves_the_store_alone_on_errors(spark, tmp_path):
    case, store = golden.SMALL, str(tmp_path / "store")
    date, good = case["as_at_date"], golden.tables(spark, case)
    publish_ageing_report(good, date, store)

    settled = {
        "invoices": invoices(spark, ("a", "2025-01-01", 5)),
        "credit_notes": credit_notes(spark, ("c", "2025-01-01", 1)),
        "payments": payments(spark, ("a", "invoice", 5), ("c", "credit_note", 1)),
    }
    for inputs, message in (
        ({**good, "payments": payments(spark)}, "payments is empty"),
        ({**good, "invoices": good["invoices"].drop("class_id")}, "invoices lacks.* class_id"),
        (settled, "ageing_report is empty"),
    ):
        with pytest.raises(ValueError, match=message):
            publish_ageing_report(inputs, date, store)
    stored = read_report(spark, store).collect()
    assert in_any_order(stored) == in_any_order(golden.report_rows(case))
