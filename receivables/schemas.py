"""Declared schemas of the input tables; ``receivables.layout`` has that of the report.

Column names and column order are fixed values: they are the data model that
files and callers rely on. Money is exact decimal in the inputs and turns into
DOUBLE only in the report.
"""

from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(18, 2)

TEXT, DATE = StringType(), DateType()


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


INVOICES = _schema(
    id=TEXT, centre_id=TEXT, class_id=TEXT, student_id=TEXT, invoice_date=DATE, total_amount=MONEY
)
CREDIT_NOTES = _schema(
    id=TEXT,
    centre_id=TEXT,
    class_id=TEXT,
    student_id=TEXT,
    credit_note_date=DATE,
    total_amount=MONEY,
)
PAYMENTS = _schema(
    id=TEXT, document_id=TEXT, document_type=TEXT, amount_paid=MONEY, payment_date=DATE
)
AMOUNTS = ("total_amount", "amount_paid")
#: Column of a scan for lines that did not parse.
REJECTED = "_rejected"


def input_schemas(money: DecimalType = MONEY) -> dict[str, StructType]:
    """The input tables' schemas, with amounts of another money type if wanted."""
    return {
        name: StructType(
            [
                StructField(field.name, money if field.name in AMOUNTS else field.dataType)
                for field in schema.fields
            ]
        )
        for name, schema in INPUT_SCHEMAS.items()
    }


INPUT_SCHEMAS = {"invoices": INVOICES, "credit_notes": CREDIT_NOTES, "payments": PAYMENTS}

DOCUMENT_COLUMNS = (
    "document_id",
    "centre_id",
    "class_id",
    "student_id",
    "document_date",
    "total_amount",
    "document_type",
)
DOCUMENT_KEY = ("document_id", "document_type")
INVOICE = "invoice"
CREDIT_NOTE = "credit_note"
