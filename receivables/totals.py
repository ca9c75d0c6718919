"""Totals paid per document, kept up to date batch by batch.

A store holds, for every batch of payments, the totals of that batch, and a list of what is in
force: a row for each part with the batches in it. A batch adds its own totals, so its cost is
that of the batch; a total is the sum over the parts. Folding makes one part of them all. Sums
of exact money can be added up in any order, so the totals are those of all payments at once.

A batch is in force when the list that names it is, and a list is one small file that Spark
puts in its place when it is complete. A batch delivered again is known by its name and adds
nothing, whether the first delivery succeeded or failed half way. One writer at a time: of two
lists made at once from the same one, that with the greater id counts and the other batch has
to be delivered again (``batches`` shows it is missing).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from receivables.operators import payment_totals
from receivables.schemas import DOCUMENT_KEY, MONEY

LIST = "number LONG, id STRING, part STRING, batches ARRAY<STRING>"


def _in_force(spark: SparkSession, store: str) -> list:
    """The rows of the last list; their number is that of the parts."""
    try:
        lists = spark.read.schema(LIST).json(f"{store}/lists")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    last = lists.agg(F.max(F.struct("number", "id")).alias("last")).first().last
    if last is None:
        return []
    return lists.filter((F.col("number") == last.number) & (F.col("id") == last.id)).collect()


def _put(spark: SparkSession, store: str, number: int, parts: list[tuple[str, list[str]]]) -> None:
    identity = uuid.uuid4().hex
    rows = spark.createDataFrame([(number, identity, *part) for part in parts], LIST)
    rows.coalesce(1).write.mode("append").json(f"{store}/lists")


def batches(spark: SparkSession, store: str) -> set[str]:
    """The names of the batches in the totals."""
    return {name for row in _in_force(spark, store) for name in row.batches}


def add_batch(payments: DataFrame, store: str, batch: str, money: DecimalType = MONEY) -> bool:
    """Adds a batch of payments to the totals; False if it was in them already.

    The batch is summed per document on its way in; totals in the store are not read.
    """
    spark = payments.sparkSession
    parts = _in_force(spark, store)
    if any(batch in row.batches for row in parts):
        return False
    part = f"part-{uuid.uuid4().hex}"
    payment_totals(payments, money).write.parquet(f"{store}/{part}")
    number = max((row.number for row in parts), default=0) + 1
    _put(spark, store, number, [*((row.part, row.batches) for row in parts), (part, [batch])])
    return True


def fold(spark: SparkSession, store: str, money: DecimalType = MONEY) -> None:
    """Makes one part of all; those before stay for readers that opened them."""
    parts = _in_force(spark, store)
    if len(parts) < 2:
        return
    part = f"part-{uuid.uuid4().hex}"
    read_totals(spark, store, money).write.parquet(f"{store}/{part}")
    names = sorted(name for row in parts for name in row.batches)
    _put(spark, store, parts[0].number + 1, [(part, names)])


def read_totals(spark: SparkSession, store: str, money: DecimalType = MONEY) -> DataFrame:
    """``document_id``, ``document_type`` and ``total_paid`` over all batches, as
    ``payment_totals`` gives them for all payments. Empty without a batch."""
    parts = _in_force(spark, store)
    total = DecimalType(min(money.precision + 10, 38), money.scale)
    if not parts:
        key = ", ".join(f"{name} string" for name in DOCUMENT_KEY)
        return spark.createDataFrame([], f"{key}, total_paid {total.simpleString()}")
    summed = spark.read.parquet(*(f"{store}/{row.part}" for row in parts)).groupBy(*DOCUMENT_KEY)
    return summed.agg(F.sum("total_paid").cast(total).alias("total_paid"))
