"""The three input tables, derived from order tables of the TPC-H kind.

An order whose customer or nation is unknown stays, with NULLs.

Orders become invoices, returned lines become one credit note per order, and
billed lines become payments on either. Amounts are stored as DOUBLE there and
are made exact before anything is summed.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from receivables.functions import key_hash
from receivables.functions.keys import KEY_HASH
from receivables.schemas import CREDIT_NOTE, INVOICE, MONEY

AS_AT_DATE = datetime.date(2001, 6, 30)


# The columns used. Declared, so that no job has to look into the files first.
_TABLES = {
    "nation": "n_nationkey INT, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
}


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(_TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def _id(prefix: str, column: str, *more: str) -> Column:
    """``prefix`` and the columns' values, joined with ``_``; NULL if one of them is."""
    rest = (part for name in more for part in (F.lit("_"), F.col(name).cast("string")))
    return F.concat(F.lit(prefix), F.col(column).cast("string"), *rest)


def _billed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what invoices and credit notes share."""
    customers = _load(spark, sf_dir, "customer").join(
        _load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return (
        _load(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            "o_orderkey",
            "o_orderdate",
            "o_totalprice",
            _id("r", "n_regionkey").alias("centre_id"),
            F.col("c_mktsegment").alias("class_id"),
            _id("stu_", "o_custkey").alias("student_id"),
        )
    )


def _invoices(billed_orders: DataFrame) -> DataFrame:
    return billed_orders.select(
        _id("inv_", "o_orderkey").alias("id"),
        "centre_id",
        "class_id",
        "student_id",
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
    )


def _with_returns(billed_orders: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """Orders with the date and the total of what was returned."""
    order = key_hash(["o_orderkey"])
    returned = (
        lines.filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.min(F.col("l_shipdate").cast("date")).alias("credit_note_date"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("total_amount"),
        )
    )
    return billed_orders.withColumn(KEY_HASH, order).join(
        returned.select("*", order), [KEY_HASH, "o_orderkey"], how
    )


def _credit_notes(billed_orders: DataFrame, lines: DataFrame) -> DataFrame:
    return _with_returns(billed_orders, lines, "inner").select(
        _id("cr_", "o_orderkey").alias("id"),
        "centre_id",
        "class_id",
        "student_id",
        "credit_note_date",
        "total_amount",
    )


def _payments(lines: DataFrame) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    return lines.filter(F.col("l_linestatus") == "F").select(
        _id("pay_", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.when(returned, _id("cr_", "l_orderkey"))
        .otherwise(_id("inv_", "l_orderkey"))
        .alias("document_id"),
        F.when(returned, CREDIT_NOTE).otherwise(INVOICE).alias("document_type"),
        F.col("l_extendedprice").cast(MONEY).alias("amount_paid"),
        F.col("l_shipdate").cast("date").alias("payment_date"),
    )


def load_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Invoices, credit notes and payments from the tables in ``sf_dir``."""
    billed_orders = _billed_orders(spark, sf_dir)
    lines = _load(spark, sf_dir, "lineitem")
    return {
        "invoices": _invoices(billed_orders),
        "credit_notes": _credit_notes(billed_orders, lines),
        "payments": _payments(lines),
    }


def load_faulty_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Input tables that break the rules, from the same tables.

    Invoices have the date and the total of what was returned: no date where nothing was,
    the date as a timestamp, the total as text, and a word in its place where there is none.
    Credit notes have amounts many of which are too large for money. Payments are thirds of
    an amount; those on lines that are still open have no date, those on lines not returned
    no document.
    """
    billed_orders = _billed_orders(spark, sf_dir)
    lines = _load(spark, sf_dir, "lineitem")
    returned = _with_returns(billed_orders, lines, "left")
    billed = F.col("l_linestatus") == "F"
    return {
        "invoices": returned.select(
            _id("inv_", "o_orderkey").alias("id"),
            "centre_id",
            "class_id",
            "student_id",
            F.col("credit_note_date").cast("timestamp_ntz").alias("invoice_date"),
            F.coalesce(F.col("total_amount").cast("string"), "class_id").alias("total_amount"),
        ),
        "credit_notes": billed_orders.select(
            _id("cr_", "o_orderkey").alias("id"),
            "centre_id",
            "class_id",
            "student_id",
            F.col("o_orderdate").cast("date").alias("credit_note_date"),
            (F.col("o_totalprice") * 1e11).alias("total_amount"),
        ),
        "payments": lines.select(
            _id("pay_", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
            F.when(F.col("l_returnflag") == "R", _id("cr_", "l_orderkey")).alias("document_id"),
            F.lit(CREDIT_NOTE).alias("document_type"),
            (F.col("l_extendedprice") / 3).alias("amount_paid"),
            F.when(billed, F.col("l_shipdate").cast("date")).alias("payment_date"),
        ),
    }


def load_undated_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The input tables, invoices dated as their credit notes: not at all without one."""
    billed_orders = _billed_orders(spark, sf_dir)
    lines = _load(spark, sf_dir, "lineitem")
    undated = _with_returns(billed_orders, lines, "left")
    return load_inputs(spark, sf_dir) | {
        "invoices": undated.select(
            _id("inv_", "o_orderkey").alias("id"),
            "centre_id",
            "class_id",
            "student_id",
            F.col("credit_note_date").alias("invoice_date"),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        )
    }
