from decimal import Decimal

import pytest
from helpers import AS_AT, credit_notes, invoices, payments
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from receivables.functions import rounded_amounts, unfit_amounts
from receivables.operators import (
    check_table,
    credit_note_documents,
    document_types,
    invoice_documents,
    unify_documents,
)
from receivables.plans import ageing_report
from receivables.schemas import DOCUMENT_COLUMNS, INVOICES, MONEY


def test_columns_and_types(spark):
    for documents, name in (
        (invoice_documents(invoices(spark, ("i1", "2025-01-01", 5))), "invoice"),
        (credit_note_documents(credit_notes(spark, ("i1", "2025-01-01", 5))), "credit_note"),
    ):
        assert documents.columns == list(DOCUMENT_COLUMNS)
        assert documents.schema["total_amount"].dataType == MONEY
        assert not documents.schema["document_type"].nullable
        assert [row.document_type for row in documents.collect()] == [name]


def test_union_keeps_copies_and_signs(spark):
    documents = unify_documents(
        invoices(spark, ("a", "2025-01-01", 5), ("a", "2025-01-01", 5)),
        credit_notes(spark, ("a", "2025-01-01", 5)),
    )
    assert documents.count() == 3
    assert {row.total_amount for row in documents.collect()} == {Decimal("5.00")}
    assert sorted(r[0] for r in document_types(documents).collect()) == ["credit_note", "invoice"]


def test_columns_are_taken_by_name(spark):
    table = invoices(spark, ("a", "2025-01-01", 5))
    shuffled = table.select(*reversed(table.columns))
    assert invoice_documents(shuffled).collect() == invoice_documents(table).collect()


def test_binary_amounts_become_exact(spark):
    table = invoices(spark, ("a", "2025-01-01", "0.10"))
    for kind in ("float", "double"):
        binary = table.withColumn("total_amount", F.col("total_amount").cast(kind))
        documents = invoice_documents(binary)
        assert documents.schema["total_amount"].dataType == MONEY
        assert documents.first().total_amount == Decimal("0.10")


UNFIT = [float("nan"), float("inf"), 1e17, 1e30]


@pytest.mark.parametrize("odd", UNFIT)
def test_amounts_that_are_no_money_are_counted_and_fail(spark, odd):
    """They do not vanish: the check names them, and using them fails."""
    table = invoices(spark, ("a", "2025-01-01", 1)).withColumn("total_amount", F.lit(odd))
    findings = {
        (f.check_name, f.column_name): (f.severity, f.violations)
        for f in check_table(table, "invoices", INVOICES.names).collect()
    }
    assert findings["amount_range", "total_amount"] == ("error", 1)
    assert findings["nulls", "total_amount"] == ("warning", 0)
    with pytest.raises(Exception, match="total_amount cannot hold as decimal"):
        invoice_documents(table).collect()


@pytest.mark.parametrize(
    "kind, value, rounded",
    [
        ("double", "0.30", 0),
        ("double", "0.004", 1),
        ("float", "12345.67", 0),
        ("string", " 0.80 ", 0),
        ("string", "0.805", 1),
        ("decimal(20,4)", "1.2345", 1),
        ("decimal(20,4)", "1.2300", 0),
        ("decimal(9,1)", "1.5", 0),
        ("int", "7", 0),
    ],
)
def test_rounding_is_counted(spark, kind, value, rounded):
    table = invoices(spark, ("a", "2025-01-01", 1)).withColumn(
        "total_amount", F.lit(value).cast(kind)
    )
    counts = table.agg(
        unfit_amounts(table, "total_amount").alias("unfit"),
        rounded_amounts(table, "total_amount").alias("rounded"),
    ).first()
    assert (counts.unfit, counts.rounded) == (0, rounded)
    exact = Decimal(value.strip()).quantize(Decimal("0.01"), "ROUND_HALF_UP")
    assert invoice_documents(table).first().total_amount == exact


def test_text_amounts_are_exact(spark):
    """0.80 paid 0.10 and 0.70 is settled, also if all of it is text."""
    bills = invoices(spark, ("a", "2025-01-01", "0.80"), ("b", "2025-01-01", 1))
    paid = payments(spark, ("a", "invoice", "0.10"), ("a", "invoice", "0.70"))
    as_text = [
        bills.withColumn("total_amount", F.col("total_amount").cast("string")),
        credit_notes(spark),
        paid.withColumn("amount_paid", F.col("amount_paid").cast("string")),
    ]
    assert [r.document_id for r in ageing_report(*as_text, AS_AT).collect()] == ["b"]
    words = as_text[0].withColumn("total_amount", F.lit("many"))
    found = check_table(words, "invoices", INVOICES.names).filter("check_name = 'amount_range'")
    assert [f.violations for f in found.collect()] == [2]


def test_more_decimals_if_wanted(spark):
    fine = DecimalType(28, 4)
    bills = invoices(spark, ("a", "2025-01-01", 0)).withColumn("total_amount", F.lit(0.004))
    report = ageing_report(bills, credit_notes(spark), payments(spark), AS_AT, money=fine)
    assert [r.day_120 for r in report.collect()] == [0.004]
    assert rounded(bills, fine) == 0 and rounded(bills, MONEY) == 1
    assert ageing_report(bills, credit_notes(spark), payments(spark), AS_AT).count() == 0


def rounded(table, money):
    return table.agg(rounded_amounts(table, "total_amount", money)).first()[0]
