"""Short ways to make input tables, and the report worked out row by row."""

from __future__ import annotations

import datetime
from collections import defaultdict
from decimal import Decimal

from receivables.layout import report_schema
from receivables.schemas import CREDIT_NOTES, INVOICES, PAYMENTS

AS_AT = datetime.date(2025, 4, 7)


def day(text):
    return None if text is None else datetime.date.fromisoformat(text)


def money(value):
    return None if value is None else Decimal(str(value))


def invoices(spark, *rows):
    """Rows of (id, date, amount) or of all six columns."""
    return spark.createDataFrame([_document(row) for row in rows], INVOICES)


def credit_notes(spark, *rows):
    return spark.createDataFrame([_document(row) for row in rows], CREDIT_NOTES)


def _document(row):
    if len(row) == 3:
        row = (row[0], "c_1", "cls_1", "stu_1", *row[1:])
    date = day(row[4]) if isinstance(row[4], str) else row[4]
    return (*row[:4], date, money(row[5]))


def payments(spark, *rows):
    """Rows of (document_id, document_type, amount), or with id before and date behind."""
    full = [row if len(row) == 5 else (f"pay_{i}", *row, "2025-01-01") for i, row in enumerate(rows)]
    return spark.createDataFrame([(*r[:3], money(r[3]), day(r[4])) for r in full], PAYMENTS)


def expected_report(invoices, credit_notes, payments, as_at):
    """The report's rows by plain Python, from lists of full rows."""
    paid = defaultdict(Decimal)
    for _, document_id, document_type, amount, _ in payments:
        if None not in (document_id, document_type, amount):
            paid[document_id, document_type] += amount
    documents = [(*row, "invoice") for row in invoices]
    documents += [(*row, "credit_note") for row in credit_notes]
    report = []
    for document_id, centre, klass, student, date, total, document_type in documents:
        if total is None:
            continue
        owed = total - paid.get((document_id, document_type), 0)
        if owed <= 0:
            continue
        buckets = [0.0] * 7
        if date is not None and date <= as_at:
            age = (as_at - date).days
            buckets[min(max((age - 1) // 30, 0), 6)] = float(owed)
        report.append(
            (centre, klass, document_id, date, student, *buckets, document_type, as_at)
        )
    return report


def in_any_order(rows):
    return sorted((tuple(row) for row in rows), key=repr)


REPORT = report_schema()
REPORT_COLUMNS = REPORT.names
