"""Invoices and credit notes as one relation of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from receivables.functions import as_money
from receivables.schemas import CREDIT_NOTE, INVOICE, MONEY


def _documents(
    table: DataFrame, date_column: str, document_type: str, money: DecimalType
) -> DataFrame:
    return table.select(
        F.col("id").alias("document_id"),
        "centre_id",
        "class_id",
        "student_id",
        F.col(date_column).alias("document_date"),
        as_money(table, "total_amount", money).alias("total_amount"),
        F.lit(document_type).alias("document_type"),
    )


def invoice_documents(invoices: DataFrame, money: DecimalType = MONEY) -> DataFrame:
    return _documents(invoices, "invoice_date", INVOICE, money)


def credit_note_documents(credit_notes: DataFrame, money: DecimalType = MONEY) -> DataFrame:
    return _documents(credit_notes, "credit_note_date", CREDIT_NOTE, money)


def unify_documents(
    invoices: DataFrame, credit_notes: DataFrame, money: DecimalType = MONEY
) -> DataFrame:
    """All documents of both kinds. Copies are kept; credit notes keep their sign."""
    return invoice_documents(invoices, money).unionByName(
        credit_note_documents(credit_notes, money)
    )


def document_types(documents: DataFrame) -> DataFrame:
    """The kinds of document that occur."""
    return documents.select("document_type").distinct()
