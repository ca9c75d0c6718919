"""Owed amounts spread over age buckets as of a date."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.functions import AGE_BUCKETS, AgeBucket, bucket_amount, days_between
from receivables.functions.ageing import as_date
from receivables.layout import report_columns

SORT_SPREAD = "_sort_spread"


def with_days(outstanding: DataFrame, as_at_date: datetime.date) -> DataFrame:
    """Adds ``days_outstanding``; negative for future documents, NULL without a date."""
    return outstanding.withColumn(
        "days_outstanding", days_between(as_at_date, F.col("document_date"))
    )


def bucketize(aged: DataFrame, buckets: Sequence[AgeBucket] = AGE_BUCKETS) -> DataFrame:
    """Adds one amount column per bucket; at most one of them is not 0.

    No row is dropped: future and undated documents have 0 in every bucket.
    """
    days, amount = F.col("days_outstanding"), F.col("outstanding_amount")
    return aged.select("*", *(bucket_amount(bucket, days, amount) for bucket in buckets))


def to_report(
    bucketed: DataFrame, as_at_date: datetime.date, buckets: Sequence[AgeBucket] = AGE_BUCKETS
) -> DataFrame:
    """The report's columns only, bucket amounts as DOUBLE, stamped with the date."""
    amounts = {bucket.column: F.col(bucket.column).cast("double") for bucket in buckets}
    return bucketed.withColumns({**amounts, "as_at_date": as_date(as_at_date)}).select(
        *report_columns(buckets)
    )


def age_documents(
    outstanding: DataFrame, as_at_date: datetime.date, buckets: Sequence[AgeBucket] = AGE_BUCKETS
) -> DataFrame:
    """The report for documents still owed, in no particular order."""
    return to_report(bucketize(with_days(outstanding, as_at_date), buckets), as_at_date, buckets)


SORT_KEYS = ("centre_id", "class_id", "document_id", "document_type")


def sort_report(report: DataFrame) -> DataFrame:
    """The report ordered by centre, class and document, for presentation.

    Stored tables need no global order, so the plans sort only where a person
    reads the result. A hash of the other columns is the last tie-break: without it all
    copies of one document would have to lie in one sorted partition. Rows that agree in
    every column stay together. Unlike a random number or a task's id a hash lets filters
    on the result pass through to the scans.
    """
    rest = [name for name in report.columns if name not in SORT_KEYS]
    return (
        report.withColumn(SORT_SPREAD, F.xxhash64(*rest))
        .orderBy(*SORT_KEYS, SORT_SPREAD)
        .drop(SORT_SPREAD)
    )
