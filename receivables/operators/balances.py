"""What has been paid on each document and what is still owed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from receivables.functions import as_money, key_hash
from receivables.functions.keys import KEY_HASH
from receivables.schemas import DOCUMENT_KEY, MONEY


def payment_totals(payments: DataFrame, money: DecimalType = MONEY) -> DataFrame:
    """Amount paid per document.

    All payments count, whatever their date. The sum is partial before the
    shuffle, so a document with very many payments sends one row per task.
    """
    return payments.groupBy(*DOCUMENT_KEY).agg(
        F.sum(as_money(payments, "amount_paid", money)).alias("total_paid")
    )


def join_payments(documents: DataFrame, totals: DataFrame) -> DataFrame:
    """Documents with ``total_paid``, NULL where no payment is known.

    ``totals`` holds one row per document key, so no document is multiplied;
    copies of a document each get the whole total, and a NULL key finds none.
    ``key_hash`` explains why the join has a hash among its keys. No side is
    marked for broadcast: Spark broadcasts the totals by itself when they are
    under its thresholds.
    """
    left = documents.withColumn(KEY_HASH, key_hash(DOCUMENT_KEY))
    right = totals.withColumn(KEY_HASH, key_hash(DOCUMENT_KEY))
    return left.join(right, [KEY_HASH, *DOCUMENT_KEY], "left").select(
        *documents.columns, "total_paid"
    )


def with_payments(documents: DataFrame, totals: DataFrame) -> DataFrame:
    """Documents with ``total_paid``, 0 where no payment is known."""
    return join_payments(documents, totals).withColumn(
        "total_paid", F.coalesce("total_paid", F.lit(0))
    )


def outstanding(paid_documents: DataFrame) -> DataFrame:
    """Documents on which something is still owed, with ``outstanding_amount``.

    Settled and overpaid documents are dropped, as are those without an amount.
    """
    return paid_documents.withColumn(
        "outstanding_amount", F.col("total_amount") - F.col("total_paid")
    ).filter(F.col("outstanding_amount") > 0)


def outstanding_documents(
    documents: DataFrame, payments: DataFrame, money: DecimalType = MONEY
) -> DataFrame:
    """Documents still owed after all payments; independent of any as-at date."""
    return outstanding(with_payments(documents, payment_totals(payments, money)))
