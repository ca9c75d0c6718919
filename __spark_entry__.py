"""Entry point, named queries, and the same queries in SQL.

Every query takes the session and a folder of Parquet tables, derives the three
input tables from them (``receivables.fixtures``) and runs over all rows. Money
is exact throughout and becomes DOUBLE in the last projection.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from receivables import keyed, operators, plans, sinks, sources, totals, versions
from receivables.fixtures import (
    AS_AT_DATE,
    load_faulty_inputs,
    load_inputs,
    load_undated_inputs,
)
from receivables.functions import age_buckets
from receivables.layout import report_columns
from receivables.schemas import (
    CREDIT_NOTES,
    DOCUMENT_COLUMNS,
    INPUT_SCHEMAS,
    INVOICES,
    PAYMENTS,
)
from receivables.scratch import new_folder, staged
from receivables.sources.reports import CSV_TEXT

Query = Callable[[SparkSession, str], DataFrame]

OTHER_LIMITS = (7, 14, 28)
_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")

# The operators on texts come and go as a whole with their folder and what it needs.
try:
    from receivables.llm import queries as llm
except ImportError:
    llm = None


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE, for comparison across engines."""
    return df.select(
        *(
            F.col(field.name).cast("double").alias(field.name)
            if isinstance(field.dataType, DecimalType)
            else field.name
            for field in df.schema.fields
        )
    )


def _documents(inputs: dict[str, DataFrame]) -> DataFrame:
    return operators.unify_documents(inputs["invoices"], inputs["credit_notes"])


def _outstanding(inputs: dict[str, DataFrame]) -> DataFrame:
    return operators.outstanding_documents(_documents(inputs), inputs["payments"])


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.ageing_report(**load_inputs(spark, sf_dir), as_at_date=AS_AT_DATE)


def _csv_scan(table: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def write(path: str) -> None:
            load_inputs(spark, sf_dir)[table].write.options(**CSV_TEXT).csv(path)

        path = staged(spark, f"csv-{table}", sf_dir, write)
        return _plain(sources.read_table(spark, path, "csv", INPUT_SCHEMAS[table], escape='"'))

    return query


def invoice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(operators.invoice_documents(load_inputs(spark, sf_dir)["invoices"]))


def credit_note_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(operators.credit_note_documents(load_inputs(spark, sf_dir)["credit_notes"]))


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_documents(load_inputs(spark, sf_dir)))


def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.document_types(_documents(load_inputs(spark, sf_dir)))


def payments_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(operators.payment_totals(load_inputs(spark, sf_dir)["payments"]))


def documents_with_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = load_inputs(spark, sf_dir)
    totals = operators.payment_totals(inputs["payments"])
    return _plain(operators.with_payments(_documents(inputs), totals))


def outstanding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_outstanding(load_inputs(spark, sf_dir)))


def days_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(operators.with_days(_outstanding(load_inputs(spark, sf_dir)), AS_AT_DATE))


def ageing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = operators.with_days(_outstanding(load_inputs(spark, sf_dir)), AS_AT_DATE)
    return _plain(operators.bucketize(aged))


def ageing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.sort_report(_report(spark, sf_dir))


def report_via_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources.register_views(load_inputs(spark, sf_dir))
    return plans.ageing_report_from_views(spark, AS_AT_DATE)


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = load_inputs(spark, sf_dir)
    totals = operators.payment_totals(inputs["payments"])
    joined = operators.join_payments(_documents(inputs), totals)
    return operators.null_profile(joined, "documents_with_payments", joined.columns)


def type_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.type_findings(spark.read.parquet(f"{sf_dir}/orders.parquet"), "orders")


def input_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.validate_inputs(**load_faulty_inputs(spark, sf_dir))


def output_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = load_undated_inputs(spark, sf_dir)
    return operators.validate_report(plans.ageing_report(**inputs, as_at_date=AS_AT_DATE))


def missing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lacking = orders.drop("o_orderdate", "o_totalprice")
    return operators.check_table(lacking, "orders", [*_ORDER_COLUMNS, "o_comment_date"])


def report_other_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, base = new_folder(spark, "report"), new_folder(spark, "report")
    buckets = age_buckets(OTHER_LIMITS)
    inputs = load_inputs(spark, sf_dir)
    plans.publish_ageing_report(inputs, AS_AT_DATE, path, base, buckets)
    stored = sources.read_report(spark, path, AS_AT_DATE, buckets)
    as_csv = sources.read_csv_report(spark, base, AS_AT_DATE, buckets)
    return stored.withColumn("kept_as", F.lit("parquet")).unionByName(
        as_csv.withColumn("kept_as", F.lit("csv"))
    )


def _staged_csv_inputs(spark: SparkSession, sf_dir: str, rejected: bool = False) -> dict[str, DataFrame]:
    def path(table: str) -> str:
        def write(folder: str) -> None:
            load_inputs(spark, sf_dir)[table].write.options(**CSV_TEXT).csv(folder)

        return staged(spark, f"csv-{table}", sf_dir, write)

    paths = {table: path(table) for table in INPUT_SCHEMAS}
    return sources.read_inputs(spark, paths, escape='"', rejected=rejected)


def published_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published in one pass over CSV files, then read as committed."""
    store = new_folder(spark, "store")
    plans.publish_ageing_report(_staged_csv_inputs(spark, sf_dir, rejected=True), AS_AT_DATE, store)
    return sources.read_report(spark, store, AS_AT_DATE)


def published_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What publishing tells of inputs without some dates, counted while the report was made."""
    warnings = plans.publish_ageing_report(
        load_undated_inputs(spark, sf_dir), AS_AT_DATE, new_folder(spark, "store")
    )
    return spark.createDataFrame(
        warnings,
        "table_name string, check_name string, column_name string, severity string, violations long",
    )


def report_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date written twice, first its invoices alone: both versions, by number."""
    store, report = new_folder(spark, "store"), _report(spark, sf_dir)
    for part in (report.filter("document_type = 'invoice'"), report):
        version = versions.stage_version(part, store, AS_AT_DATE)
        versions.commit_version(spark, store, AS_AT_DATE, version)
    first = versions.read_version(spark, store, AS_AT_DATE, number=1)
    latest = sources.read_report(spark, store, AS_AT_DATE)
    return first.withColumn("number", F.lit(1)).unionByName(latest.withColumn("number", F.lit(2)))


def keyed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over tables stored by document, in two loads."""

    def write(folder: str) -> None:
        inputs = load_inputs(spark, sf_dir)
        for part in (0, 1):
            half = {
                name: table.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part)
                for name, table in inputs.items()
            }
            keyed.load_keyed(half, folder, folder.rsplit("/", 1)[1].replace("-", "_"), 16)

    folder = staged(spark, "keyed", sf_dir, write)
    tables = keyed.open_keyed(spark, folder, folder.rsplit("/", 1)[1].replace("-", "_"))
    return keyed.keyed_report(tables, AS_AT_DATE)


def report_of_known_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two payments in three for documents that are not there, left out before the shuffle."""
    inputs = load_inputs(spark, sf_dir)
    paid = inputs["payments"]
    lost = F.explode(F.array(F.lit(""), F.lit("lost_"), F.lit("gone_")))
    many = paid.withColumn("lost", lost).withColumn("document_id", F.concat("lost", "document_id")).drop("lost")
    known = operators.payments_for(many, _documents(inputs))
    return plans.ageing_report(inputs["invoices"], inputs["credit_notes"], known, AS_AT_DATE)


def clustered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One centre of a report that is stored centre by centre."""

    def write(folder: str) -> None:
        report = sinks.clustered(_report(spark, sf_dir))
        versions.commit_version(
            spark, folder, AS_AT_DATE, versions.stage_version(report, folder, AS_AT_DATE)
        )

    store = staged(spark, "clustered", sf_dir, write)
    return sources.read_report(spark, store, AS_AT_DATE).filter("centre_id = 'r1'")


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments by year as batches, one of them delivered twice, folded half way."""
    store, payments = new_folder(spark, "totals"), load_inputs(spark, sf_dir)["payments"]
    years = list(range(1995, 2003))
    for year in [*years[:4], years[1], *years[4:]]:
        start, end = f"{year}-01-01", f"{year + 1}-01-01"
        due = (F.col("payment_date") >= start) & (F.col("payment_date") < end)
        if year == years[0]:
            due = (F.col("payment_date") < end) | F.col("payment_date").isNull()
        elif year == years[-1]:
            due = F.col("payment_date") >= start
        totals.add_batch(payments.filter(due), store, str(year))
        if year == years[3]:
            totals.fold(spark, store)
    return _plain(totals.read_totals(spark, store))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices in a CSV of which four lines in ten have a fault, read with the
    lines that did not parse."""

    def write(path: str) -> None:
        order = F.col("o_orderkey") % 10
        date = F.col("o_orderdate").cast("date").cast("string")
        amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
        start = [F.concat(F.lit("inv_"), "o_orderkey"), "o_orderpriority", "o_orderstatus", "o_custkey"]
        line = (
            F.when(order == 0, F.concat_ws(",", *start, date, F.lit("n/a")))
            .when(order == 1, F.concat_ws(",", *start, F.lit("2001-13-45"), amount))
            .when(order == 2, F.concat_ws(",", *start))
            .when(order == 3, F.concat_ws(",", *start, date, amount, F.lit("EUR")))
            .otherwise(F.concat_ws(",", *start, date, amount))
        )
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        # Lines as they are: nothing in them is quoted for a separator they do not have.
        lines = orders.select(line.alias(",".join(INVOICES.names)))
        lines.write.options(header=True, sep="\u0001", quote="").csv(path)

    path = staged(spark, "csv-planted", sf_dir, write)
    return sources.read_table(spark, path, "csv", INVOICES, rejected=True)


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = operators.rejected_lines(_planted(spark, sf_dir), "invoices")
    return lines.withColumn("empty", F.array_join("empty", ","))


def unparsed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.check_table(_planted(spark, sf_dir), "invoices", INVOICES.names)


def csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, with their line breaks, as a report's class ids."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    values = {
        "centre_id": F.col("lang"),
        "class_id": F.col("text"),
        "document_id": F.col("doc_id").cast("string"),
        "document_date": F.lit(AS_AT_DATE),
        "student_id": F.col("source"),
        "document_type": F.lit("invoice"),
        "as_at_date": F.lit(AS_AT_DATE),
    }
    report = documents.select(
        *(values.get(name, F.lit(0.0)).alias(name) for name in report_columns())
    )
    base = new_folder(spark, "texts")
    sinks.write_csv(report, base, AS_AT_DATE)
    return sources.read_csv_report(spark, base, AS_AT_DATE).select(
        "centre_id", "class_id", "document_id", "student_id"
    )


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "report")
    sinks.write_partitioned(_report(spark, sf_dir), path)
    return sources.read_report(spark, path, AS_AT_DATE)


def report_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_folder(spark, "report")
    sinks.write_csv(_report(spark, sf_dir), base, AS_AT_DATE)
    return sources.read_csv_report(spark, base, AS_AT_DATE)


def entry(spark: SparkSession) -> DataFrame:
    return ageing_report(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    own = {
        "scan_invoices": _csv_scan("invoices"),
        "scan_credit_notes": _csv_scan("credit_notes"),
        "scan_payments": _csv_scan("payments"),
        "invoice_documents": invoice_documents,
        "credit_note_documents": credit_note_documents,
        "all_documents": all_documents,
        "document_types": document_types,
        "payments_by_document": payments_by_document,
        "documents_with_payments": documents_with_payments,
        "outstanding_documents": outstanding_documents,
        "days_outstanding": days_outstanding,
        "ageing_buckets": ageing_buckets,
        "ageing_report": ageing_report,
        "report_via_views": report_via_views,
        "null_profile": null_profile,
        "type_findings": type_findings,
        "input_findings": input_findings,
        "output_findings": output_findings,
        "missing_findings": missing_findings,
        "report_other_limits": report_other_limits,
        "published_report": published_report,
        "published_warnings": published_warnings,
        "report_versions": report_versions,
        "keyed_report": keyed_report,
        "report_of_known_payments": report_of_known_payments,
        "clustered_report": clustered_report,
        "running_totals": running_totals,
        "rejected_lines": rejected_lines,
        "unparsed_findings": unparsed_findings,
        "csv_text_roundtrip": csv_text_roundtrip,
        "report_roundtrip": report_roundtrip,
        "report_csv_roundtrip": report_csv_roundtrip,
    }
    return own | (llm.queries() if llm else {})


# The input tables and the stages after them, each a chain of named subqueries.
_INPUTS = """
WITH billed AS (
  SELECT o_orderkey, o_orderdate, o_totalprice,
         'r' || n_regionkey AS centre_id,
         c_mktsegment AS class_id,
         'stu_' || o_custkey AS student_id
  FROM orders
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
),
returned AS (
  SELECT l_orderkey,
         min(CAST(l_shipdate AS DATE)) AS credit_note_date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_amount
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
),
src_invoices AS (
  SELECT 'inv_' || o_orderkey AS id, centre_id, class_id, student_id,
         CAST(o_orderdate AS DATE) AS invoice_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount
  FROM billed
),
src_credit_notes AS (
  SELECT 'cr_' || o_orderkey AS id, centre_id, class_id, student_id,
         credit_note_date, total_amount
  FROM billed JOIN returned ON l_orderkey = o_orderkey
),
src_payments AS (
  SELECT 'pay_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS id,
         CASE WHEN l_returnflag = 'R' THEN 'cr_' ELSE 'inv_' END || l_orderkey AS document_id,
         CASE WHEN l_returnflag = 'R' THEN 'credit_note' ELSE 'invoice' END AS document_type,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_paid,
         CAST(l_shipdate AS DATE) AS payment_date
  FROM lineitem WHERE l_linestatus = 'F'
)"""

_DOCUMENTS = (
    _INPUTS
    + """,
docs AS (
  SELECT id AS document_id, centre_id, class_id, student_id,
         invoice_date AS document_date, total_amount, 'invoice' AS document_type
  FROM src_invoices
  UNION ALL
  SELECT id, centre_id, class_id, student_id, credit_note_date, total_amount, 'credit_note'
  FROM src_credit_notes
),
totals AS (
  SELECT document_id, document_type, sum(amount_paid) AS total_paid
  FROM src_payments GROUP BY document_id, document_type
),
joined AS (
  SELECT docs.*, totals.total_paid
  FROM docs LEFT JOIN totals USING (document_id, document_type)
)"""
)

_OWED = (
    _DOCUMENTS
    + """,
owed AS (
  SELECT * REPLACE (coalesce(total_paid, 0) AS total_paid),
         total_amount - coalesce(total_paid, 0) AS outstanding_amount,
         date_diff('day', document_date, DATE '2001-06-30') AS days_outstanding
  FROM joined
  WHERE total_amount - coalesce(total_paid, 0) > 0
)"""
)

# Bucket edges, spelled out as fixed values.
_BUCKETS = """
  CAST(CASE WHEN days_outstanding BETWEEN 0 AND 30 THEN outstanding_amount ELSE 0 END AS DOUBLE) AS day_30,
  CAST(CASE WHEN days_outstanding BETWEEN 31 AND 60 THEN outstanding_amount ELSE 0 END AS DOUBLE) AS day_60,
  CAST(CASE WHEN days_outstanding BETWEEN 61 AND 90 THEN outstanding_amount ELSE 0 END AS DOUBLE) AS day_90,
  CAST(CASE WHEN days_outstanding BETWEEN 91 AND 120 THEN outstanding_amount ELSE 0 END AS DOUBLE) AS day_120,
  CAST(CASE WHEN days_outstanding BETWEEN 121 AND 150 THEN outstanding_amount ELSE 0 END AS DOUBLE) AS day_150,
  CAST(CASE WHEN days_outstanding BETWEEN 151 AND 180 THEN outstanding_amount ELSE 0 END AS DOUBLE) AS day_180,
  CAST(CASE WHEN days_outstanding > 180 THEN outstanding_amount ELSE 0 END AS DOUBLE) AS day_180_and_above"""

_REPORT = (
    _OWED
    + f""",
report AS (
  SELECT centre_id, class_id, document_id, document_date, student_id, {_BUCKETS},
         document_type, DATE '2001-06-30' AS as_at_date
  FROM owed
)"""
)

_DOCUMENT_FIELDS = (
    "document_id, centre_id, class_id, student_id, document_date, "
    "CAST(total_amount AS DOUBLE) AS total_amount, document_type"
)
_OWED_FIELDS = (
    f"{_DOCUMENT_FIELDS}, CAST(total_paid AS DOUBLE) AS total_paid, "
    "CAST(outstanding_amount AS DOUBLE) AS outstanding_amount"
)
_DAYS = "CAST(days_outstanding AS INTEGER) AS days_outstanding"


def _null_counts(relation: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{relation}' AS table_name, '{column}' AS column_name, count(*) AS row_count, "
        f"count(*) FILTER (WHERE {column} IS NULL) AS null_count FROM joined"
        for column in columns
    )


def _finding_counts(
    relation: str, table: str, columns: list[str], **amounts: tuple[str, str]
) -> str:
    """Every check of a table, worked out from its values and types. ``amounts`` gives for
    an amount column when it is unfit and when it is rounded."""

    def row(check: str, column: str, severity: str, violations: str) -> str:
        return (
            f"SELECT '{table}' AS table_name, '{check}' AS check_name, "
            f"'{column}' AS column_name, '{severity}' AS severity, "
            f"CAST({violations} AS BIGINT) AS violations FROM {relation}"
        )

    def wrong_type(column: str, part: str) -> str:
        kind = f"(SELECT any_value(typeof({column})) FROM {relation})"
        fits = {"date": f"{kind} = 'DATE'", "amount": f"{kind} SIMILAR TO 'DECIMAL.*|DOUBLE|FLOAT'"}
        return f"CASE WHEN {fits[part]} THEN 0 ELSE count(*) END"

    return "\nUNION ALL\n".join(
        [
            row("empty", "*", "error", "count(*) = 0"),
            *(
                row("nulls", c, "warning", f"count(*) FILTER (WHERE {c} IS NULL)")
                for c in columns
            ),
            *(
                row(f"{part}_type", c, "warning", wrong_type(c, part))
                for c in columns
                for part in ("amount", "date")
                if part in c
            ),
            *(
                row(check, c, severity, f"count(*) FILTER (WHERE {when})")
                for c, whens in amounts.items()
                for check, severity, when in zip(
                    ("amount_range", "amount_rounding"), ("error", "warning"), whens
                )
            ),
        ]
    )


# Tables that break the rules, see ``receivables.fixtures``.
_FAULTY = (
    _INPUTS
    + """,
faulty_invoices AS (
  SELECT 'inv_' || o_orderkey AS id, centre_id, class_id, student_id,
         CAST(credit_note_date AS TIMESTAMP) AS invoice_date,
         coalesce(CAST(total_amount AS VARCHAR), class_id) AS total_amount
  FROM billed LEFT JOIN returned ON l_orderkey = o_orderkey
),
faulty_credit_notes AS (
  SELECT 'cr_' || o_orderkey AS id, centre_id, class_id, student_id,
         CAST(o_orderdate AS DATE) AS credit_note_date, o_totalprice * 1e11 AS total_amount
  FROM billed
),
faulty_payments AS (
  SELECT 'pay_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS id,
         CASE WHEN l_returnflag = 'R' THEN 'cr_' || l_orderkey END AS document_id,
         'credit_note' AS document_type,
         l_extendedprice / 3 AS amount_paid,
         CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS payment_date,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem
)"""
)

# The report over invoices dated as their credit notes.
_UNDATED = _REPORT.replace(
    "CAST(o_orderdate AS DATE) AS invoice_date,\n         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount\n  FROM billed",
    "credit_note_date AS invoice_date,\n         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount\n  FROM billed LEFT JOIN returned ON l_orderkey = o_orderkey",
)


def _other_limits() -> str:
    amount = "THEN outstanding_amount ELSE 0 END AS DOUBLE)"
    # Bucket edges, spelled out as fixed values.
    columns = f"""
  CAST(CASE WHEN days_outstanding BETWEEN 0 AND 7 {amount} AS day_7,
  CAST(CASE WHEN days_outstanding BETWEEN 8 AND 14 {amount} AS day_14,
  CAST(CASE WHEN days_outstanding BETWEEN 15 AND 28 {amount} AS day_28,
  CAST(CASE WHEN days_outstanding > 28 {amount} AS day_28_and_above"""
    return f"""{_OWED}
SELECT centre_id, class_id, document_id, document_date, student_id, {columns},
       document_type, DATE '2001-06-30' AS as_at_date, kept_as
FROM owed, (VALUES ('parquet'), ('csv')) AS kept(kept_as)"""


# Lines with faults, see ``_planted``.
_LINE_START = "'inv_' || o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus || ',' || o_custkey"
_LINE_DATE = "',' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
_LINE_AMOUNT = "',' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
_FAULTY_LINES = f"""
SELECT 'invoices' AS table_name,
       {_LINE_START} || CASE o_orderkey % 10
         WHEN 0 THEN {_LINE_DATE} || ',n/a'
         WHEN 1 THEN ',2001-13-45' || {_LINE_AMOUNT}
         WHEN 2 THEN ''
         ELSE {_LINE_DATE} || {_LINE_AMOUNT} || ',EUR' END AS line,
       CASE o_orderkey % 10 WHEN 0 THEN 'total_amount' WHEN 1 THEN 'invoice_date'
         WHEN 2 THEN 'invoice_date,total_amount' ELSE '' END AS empty
FROM orders WHERE o_orderkey % 10 < 4"""
_PLANTED = """
WITH planted AS (
  SELECT 'inv_' || o_orderkey AS id, o_orderpriority AS centre_id, o_orderstatus AS class_id,
         CAST(o_custkey AS VARCHAR) AS student_id,
         CASE WHEN o_orderkey % 10 NOT IN (1, 2) THEN CAST(o_orderdate AS DATE) END AS invoice_date,
         CASE WHEN o_orderkey % 10 NOT IN (0, 2) THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS total_amount,
         o_orderkey % 10 < 4 AS faulty
  FROM orders
)
"""


def oracle_sql() -> dict[str, str]:
    report = f"{_REPORT}\nSELECT * FROM report"
    sql = {
        "scan_invoices": f"""{_INPUTS}
SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM src_invoices""",
        "scan_credit_notes": f"""{_INPUTS}
SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM src_credit_notes""",
        "scan_payments": f"""{_INPUTS}
SELECT * REPLACE (CAST(amount_paid AS DOUBLE) AS amount_paid) FROM src_payments""",
        "invoice_documents": f"""{_INPUTS}
SELECT id AS document_id, centre_id, class_id, student_id, invoice_date AS document_date,
       CAST(total_amount AS DOUBLE) AS total_amount, 'invoice' AS document_type
FROM src_invoices""",
        "credit_note_documents": f"""{_INPUTS}
SELECT id AS document_id, centre_id, class_id, student_id, credit_note_date AS document_date,
       CAST(total_amount AS DOUBLE) AS total_amount, 'credit_note' AS document_type
FROM src_credit_notes""",
        "all_documents": f"{_DOCUMENTS}\nSELECT {_DOCUMENT_FIELDS} FROM docs",
        "document_types": f"{_DOCUMENTS}\nSELECT DISTINCT document_type FROM docs",
        "payments_by_document": f"""{_DOCUMENTS}
SELECT document_id, document_type, CAST(total_paid AS DOUBLE) AS total_paid FROM totals""",
        "running_totals": f"""{_DOCUMENTS}
SELECT document_id, document_type, CAST(total_paid AS DOUBLE) AS total_paid FROM totals""",
        "documents_with_payments": f"""{_DOCUMENTS}
SELECT {_DOCUMENT_FIELDS}, CAST(coalesce(total_paid, 0) AS DOUBLE) AS total_paid FROM joined""",
        "outstanding_documents": f"{_OWED}\nSELECT {_OWED_FIELDS} FROM owed",
        "days_outstanding": f"{_OWED}\nSELECT {_OWED_FIELDS}, {_DAYS} FROM owed",
        "ageing_buckets": f"{_OWED}\nSELECT {_OWED_FIELDS}, {_DAYS}, {_BUCKETS} FROM owed",
        "null_profile": f"{_DOCUMENTS}\n"
        + _null_counts(
            "documents_with_payments", [*DOCUMENT_COLUMNS, "total_paid"]
        ),
        "type_findings": """
SELECT 'orders' AS table_name, 'date_type' AS check_name, 'o_orderdate' AS column_name,
       'warning' AS severity,
       CASE WHEN (SELECT any_value(typeof(o_orderdate)) FROM orders) = 'DATE'
            THEN 0 ELSE count(*) END AS violations
FROM orders""",
        "input_findings": f"{_FAULTY}\n"
        + "\nUNION ALL\n".join(
            [
                _finding_counts(
                    "faulty_invoices",
                    "invoices",
                    INVOICES.names,
                    total_amount=("NOT regexp_full_match(total_amount, '[0-9.]+')", "FALSE"),
                ),
                _finding_counts(
                    "faulty_credit_notes",
                    "credit_notes",
                    CREDIT_NOTES.names,
                    total_amount=("total_amount >= 1e16", "FALSE"),
                ),
                _finding_counts(
                    "faulty_payments",
                    "payments",
                    PAYMENTS.names,
                    amount_paid=("amount_paid >= 1e16", "cents % 3 <> 0"),
                ),
            ]
        ),
        "output_findings": f"{_UNDATED}\n"
        + _finding_counts("report", "ageing_report", report_columns()),
        "missing_findings": f"""
{_finding_counts("orders", "orders", ["o_orderkey", "o_custkey"])}
UNION ALL
SELECT 'orders', 'missing', column_name, 'error', greatest(n, 1)
FROM (SELECT count(*) AS n FROM orders),
     (VALUES ('o_orderdate'), ('o_totalprice'), ('o_comment_date')) AS lacking(column_name)""",
        "report_other_limits": _other_limits(),
        "published_warnings": f"{_UNDATED}\n"
        + "SELECT * FROM ("
        + "\nUNION ALL\n".join(
            [
                _finding_counts("src_invoices", "invoices", INVOICES.names),
                _finding_counts("src_credit_notes", "credit_notes", CREDIT_NOTES.names),
                _finding_counts("src_payments", "payments", PAYMENTS.names),
                _finding_counts("report", "ageing_report", report_columns()),
            ]
        )
        + ") WHERE violations > 0",
        "report_versions": f"""{_REPORT}
SELECT *, 1 AS number FROM report WHERE document_type = 'invoice'
UNION ALL
SELECT *, 2 FROM report""",
        "clustered_report": f"{report} WHERE centre_id = 'r1'",
        "rejected_lines": _FAULTY_LINES,
        "unparsed_findings": f"{_PLANTED}\n"
        + _finding_counts("planted", "invoices", INVOICES.names, total_amount=("FALSE", "FALSE"))
        + """
UNION ALL
SELECT 'invoices', 'unparsed', '*', 'warning', count(*) FILTER (WHERE faulty) FROM planted""",
        "csv_text_roundtrip": """
SELECT lang AS centre_id, text AS class_id, CAST(doc_id AS VARCHAR) AS document_id,
       source AS student_id
FROM documents""",
    }
    for key in (
        "ageing_report",
        "report_via_views",
        "published_report",
        "keyed_report",
        "report_of_known_payments",
        "report_roundtrip",
        "report_csv_roundtrip",
    ):
        sql[key] = report
    return sql | (llm.oracle_sql() if llm else {})
