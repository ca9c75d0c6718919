"""Layout of the report, for any bucket limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql.types import DataType, DateType, DoubleType, StringType, StructField, StructType

from receivables.functions.ageing import AGE_BUCKETS, AgeBucket


def report_schema(buckets: Sequence[AgeBucket] = AGE_BUCKETS) -> StructType:
    """The report's columns in order, which are fixed values but for the buckets; the as-at
    date comes last, as partitioned storage keeps it."""
    columns: list[tuple[str, DataType, bool]] = [
        ("centre_id", StringType(), True),
        ("class_id", StringType(), True),
        ("document_id", StringType(), True),
        ("document_date", DateType(), True),
        ("student_id", StringType(), True),
        *((bucket.column, DoubleType(), True) for bucket in buckets),
        ("document_type", StringType(), False),
        ("as_at_date", DateType(), False),
    ]
    return StructType([StructField(*column) for column in columns])


def report_columns(buckets: Sequence[AgeBucket] = AGE_BUCKETS) -> list[str]:
    return report_schema(buckets).names
