"""Documents and payments stored by document, so that reports need no shuffle of them.

Both tables are bucketed by the document's id and type, with the same number of buckets: a
payment lies in the bucket of its document. Totals and the join are then made bucket by
bucket. A load shuffles what it adds and nothing else; a report shuffles nothing but what is
sorted for people.

A bucket is one task's work, so choose as many that a bucket's share of both tables fits one
(say 200 MB), a multiple of it if the tables are to grow. Spark does not split a bucket: a
document with a large part of all payments is better served by ``plans.ageing_report``, which
splits it. Tables are known to the session's catalog; ``open_keyed`` tells another session of
them by what was stored beside them.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from receivables.functions import AGE_BUCKETS, AgeBucket, as_money
from receivables.operators import age_documents, outstanding, payment_totals, unify_documents
from receivables.schemas import DOCUMENT_KEY, MONEY

TABLES = ("documents", "payments")


def _name(prefix: str, table: str) -> str:
    return f"{prefix}_{table}"


def load_keyed(
    inputs: Mapping[str, DataFrame],
    folder: str,
    prefix: str,
    buckets: int,
    money: DecimalType = MONEY,
) -> None:
    """Adds the inputs to the tables ``{prefix}_documents`` and ``{prefix}_payments`` in ``folder``,
    which are made if there are none. ``ValueError`` if they have another number of buckets.

    A load is not undone by a failure in the second table; give each input rows once.
    """
    payments = inputs["payments"]
    paid = as_money(payments, "amount_paid", money).alias("amount_paid")
    added = {
        "documents": unify_documents(inputs["invoices"], inputs["credit_notes"], money),
        "payments": payments.select(*DOCUMENT_KEY, paid),
    }
    spark = payments.sparkSession
    for table, rows in added.items():
        name, path = _name(prefix, table), f"{folder}/{table}"
        if spark.catalog.tableExists(name) and _buckets(spark, name) != buckets:
            raise ValueError(f"{name} has {_buckets(spark, name)} buckets, not {buckets}")
        (
            # One task a bucket, so one file a bucket and load.
            rows.repartition(buckets, *DOCUMENT_KEY)
            .write.format("parquet")
            .mode("append")
            .bucketBy(buckets, *DOCUMENT_KEY)
            .sortBy(*DOCUMENT_KEY)
            .option("path", path)
            .saveAsTable(name)
        )
        kept = [(table, buckets, spark.table(name).schema.simpleString())]
        about = spark.createDataFrame(kept, "table_name string, buckets int, fields string")
        about.coalesce(1).write.mode("overwrite").json(f"{folder}/about/{table}")


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type)


def open_keyed(spark: SparkSession, folder: str, prefix: str) -> dict[str, DataFrame]:
    """The tables ``documents`` and ``payments``; registers them if the session does not know them."""
    for row in spark.read.json(f"{folder}/about/*").collect():
        fields = row.fields.removeprefix("struct<").removesuffix(">")
        key = ", ".join(DOCUMENT_KEY)
        columns = ", ".join(
            f"`{name}` {kind}" for name, _, kind in (part.partition(":") for part in _parts(fields))
        )
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(prefix, row.table_name)} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {row.buckets} BUCKETS "
            f"LOCATION '{folder}/{row.table_name}'"
        )
    return {table: spark.table(_name(prefix, table)) for table in TABLES}


def _parts(fields: str) -> list[str]:
    """The fields of a struct's short form; a decimal holds a comma of its own."""
    found: list[str] = []
    for part in fields.split(","):
        if ":" in part:
            found.append(part)
        else:
            found[-1] += f",{part}"
    return found


def keyed_report(
    tables: Mapping[str, DataFrame],
    as_at_date: datetime.date,
    buckets: Sequence[AgeBucket] = AGE_BUCKETS,
    money: DecimalType = MONEY,
) -> DataFrame:
    """The report of ``plans.ageing_report`` over the stored tables, without a shuffle.

    The join is on the stored key alone, as a further key would not fit the buckets.
    """
    totals = payment_totals(tables["payments"], money)
    joined = tables["documents"].join(totals.hint("merge"), list(DOCUMENT_KEY), "left")
    paid = joined.withColumn("total_paid", F.coalesce("total_paid", F.lit(0)))
    return age_documents(outstanding(paid), as_at_date, buckets)
