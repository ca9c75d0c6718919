"""Two small sets of input tables and the reports they must give, in order.

Fixed values: full rows, dates and amounts of the inputs as text.
"""

from __future__ import annotations

import datetime

from helpers import day, money

from receivables.schemas import CREDIT_NOTES, INVOICES, PAYMENTS

SMALL = {
    "as_at_date": datetime.date(2025, 4, 7),
    "invoices": [
        ("inv_001", "c_01", "cls_01", "stu_001", "2025-05-01", "300.00"),
        ("inv_004", "c_03", "cls_03", "stu_004", "2024-12-15", "400.00"),
        ("inv_006", "c_02", "cls_02", "stu_006", "2025-04-10", "250.00"),
        ("inv_007", "c_03", "cls_01", "stu_007", "2025-03-20", "300.00"),
    ],
    "credit_notes": [
        ("cr_001", "c_01", "cls_01", "5tu_001", "2025-05-15", "100.00"),
        ("cr_003", "0_02", "cls_03", "stu_003", "2024-12-01", "300.00"),
        ("cr_005", "c_03", "cls_02", "5tu_005", "2025-06-01", "200.00"),
        ("cr_006", "0_03", "c15_03", "stu_006", "2025-02-28", "80.00"),
    ],
    "payments": [
        ("pay_001", "inv_001", "invoice", "150.00", "2025-05-10"),
        ("pay_004", "inv_004", "invoice", "100.00", "2025-01-10"),
        ("pay_006", "inv_006", "invoice", "250.00", "2025-05-01"),
        ("pay_007", "cr_008", "credit_note", "90.00", "2025-05-10"),
    ],
    "report": [
        (
            "0_02", "cls_03", "cr_003", "2024-12-01", "stu_003",
            0.0, 0.0, 0.0, 0.0, 300.0, 0.0, 0.0,
            "credit_note", "2025-04-07",
        ),
        (
            "0_03", "c15_03", "cr_006", "2025-02-28", "stu_006",
            0.0, 80.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            "credit_note", "2025-04-07",
        ),
        (
            "c_01", "cls_01", "cr_001", "2025-05-15", "5tu_001",
            0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            "credit_note", "2025-04-07",
        ),
        (
            "c_01", "cls_01", "inv_001", "2025-05-01", "stu_001",
            0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            "invoice", "2025-04-07",
        ),
        (
            "c_03", "cls_01", "inv_007", "2025-03-20", "stu_007",
            300.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            "invoice", "2025-04-07",
        ),
        (
            "c_03", "cls_02", "cr_005", "2025-06-01", "5tu_005",
            0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            "credit_note", "2025-04-07",
        ),
        (
            "c_03", "cls_03", "inv_004", "2024-12-15", "stu_004",
            0.0, 0.0, 0.0, 300.0, 0.0, 0.0, 0.0,
            "invoice", "2025-04-07",
        ),
    ],
}

LARGER = {
    "as_at_date": datetime.date(2025, 7, 7),
    "invoices": [
        ("inv_001", "c_01", "cls_01", "stu_001", "2025-05-01", "300.00"),
        ("inv_002", "c_01", "cls_02", "stu_002", "2025-06-01", "200.00"),
        ("inv_003", "c_02", "cls_01", "stu_003", "2025-01-01", "500.00"),
        ("inv_004", "c_03", "cls_03", "stu_004", "2024-12-15", "400.00"),
        ("inv_005", "c_01", "cls_01", "stu_005", "2025-02-01", "150.00"),
        ("inv_006", "c_02", "cls_02", "stu_006", "2025-04-10", "250.00"),
        ("inv_007", "c_03", "cls_01", "stu_007", "2025-03-20", "300.00"),
        ("inv_008", "c_01", "cls_02", "stu_008", "2025-06-20", "100.00"),
    ],
    "credit_notes": [
        ("cr_001", "c_01", "cls_01", "5tu_001", "2025-05-15", "100.00"),
        ("er_002", "c_02", "els_02", "5tu_002", "2025-03-10", "50.00"),
        ("cr_003", "0_02", "cls_03", "stu_003", "2024-12-01", "300.00"),
        ("cr_004", "c_01", "cls_01", "5tu_004", "2025-01-20", "120.00"),
        ("cr_005", "c_03", "cls_02", "5tu_005", "2025-06-01", "200.00"),
        ("cr_006", "0_03", "c15_03", "stu_006", "2025-02-28", "80.00"),
        ("cr_007", "0_02", "cls_01", "stu_007", "2025-05-05", "110.00"),
        ("cr_008", "0_01", "cls_02", "5tu_008", "2025-04-25", "90.00"),
    ],
    "payments": [
        ("pay_001", "inv_001", "invoice", "150.00", "2025-05-10"),
        ("pay_002", "cr_003", "credit_note", "100.00", "2025-02-01"),
        ("pay_003", "inv_002", "invoice", "200.00", "2025-06-10"),
        ("pay_004", "inv_004", "invoice", "100.00", "2025-01-10"),
        ("pay_005", "cr_006", "credit_note", "40.00", "2025-03-05"),
        ("pay_006", "inv_006", "invoice", "250.00", "2025-05-01"),
        ("pay_007", "cr_008", "credit_note", "90.00", "2025-05-10"),
        ("pay_008", "inv_005", "invoice", "50.00", "2025-03-01"),
    ],
    "report": [
        (
            "0_02", "cls_01", "cr_007", "2025-05-05", "stu_007",
            0.0, 0.0, 110.0, 0.0, 0.0, 0.0, 0.0,
            "credit_note", "2025-07-07",
        ),
        (
            "0_02", "cls_03", "cr_003", "2024-12-01", "stu_003",
            0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 200.0,
            "credit_note", "2025-07-07",
        ),
        (
            "0_03", "c15_03", "cr_006", "2025-02-28", "stu_006",
            0.0, 0.0, 0.0, 0.0, 40.0, 0.0, 0.0,
            "credit_note", "2025-07-07",
        ),
        (
            "c_01", "cls_01", "cr_001", "2025-05-15", "5tu_001",
            0.0, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            "credit_note", "2025-07-07",
        ),
        (
            "c_01", "cls_01", "cr_004", "2025-01-20", "5tu_004",
            0.0, 0.0, 0.0, 0.0, 0.0, 120.0, 0.0,
            "credit_note", "2025-07-07",
        ),
        (
            "c_01", "cls_01", "inv_001", "2025-05-01", "stu_001",
            0.0, 0.0, 150.0, 0.0, 0.0, 0.0, 0.0,
            "invoice", "2025-07-07",
        ),
        (
            "c_01", "cls_01", "inv_005", "2025-02-01", "stu_005",
            0.0, 0.0, 0.0, 0.0, 0.0, 100.0, 0.0,
            "invoice", "2025-07-07",
        ),
        (
            "c_01", "cls_02", "inv_008", "2025-06-20", "stu_008",
            100.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            "invoice", "2025-07-07",
        ),
        (
            "c_02", "cls_01", "inv_003", "2025-01-01", "stu_003",
            0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 500.0,
            "invoice", "2025-07-07",
        ),
        (
            "c_02", "els_02", "er_002", "2025-03-10", "5tu_002",
            0.0, 0.0, 0.0, 50.0, 0.0, 0.0, 0.0,
            "credit_note", "2025-07-07",
        ),
        (
            "c_03", "cls_01", "inv_007", "2025-03-20", "stu_007",
            0.0, 0.0, 0.0, 300.0, 0.0, 0.0, 0.0,
            "invoice", "2025-07-07",
        ),
        (
            "c_03", "cls_02", "cr_005", "2025-06-01", "5tu_005",
            0.0, 200.0, 0.0, 0.0, 0.0, 0.0, 0.0,
            "credit_note", "2025-07-07",
        ),
        (
            "c_03", "cls_03", "inv_004", "2024-12-15", "stu_004",
            0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 300.0,
            "invoice", "2025-07-07",
        ),
    ],
}

HEADER = (
    "centre_id,class_id,document_id,document_date,student_id,"
    "day_30,day_60,day_90,day_120,day_150,day_180,day_180_and_above,document_type,as_at_date"
)


def tables(spark, case):
    def documents(name, schema):
        rows = [(*row[:4], day(row[4]), money(row[5])) for row in case[name]]
        return spark.createDataFrame(rows, schema)

    paid = [(*row[:3], money(row[3]), day(row[4])) for row in case["payments"]]
    return {
        "invoices": documents("invoices", INVOICES),
        "credit_notes": documents("credit_notes", CREDIT_NOTES),
        "payments": spark.createDataFrame(paid, PAYMENTS),
    }


def report_rows(case):
    return [(*r[:3], day(r[3]), *r[4:-1], day(r[-1])) for r in case["report"]]


def report_csv(case):
    """The report as the lines of a CSV file."""
    return [HEADER, *(",".join(map(str, row)) for row in case["report"])]
