"""The ageing report end to end."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType

from receivables.functions import AGE_BUCKETS, AgeBucket
from receivables.functions.ageing import as_date, as_date_text
from receivables.operators import (
    Finding,
    age_documents,
    check_table,
    enforce,
    observe_checks,
    outstanding_documents,
    rejected_lines,
    report_columns,
    require_columns,
    sort_report,
    unify_documents,
    validate_inputs,
)
from receivables.operators.quality import ERROR
from receivables.schemas import INPUT_SCHEMAS, MONEY
from receivables.sinks import write_csv
from receivables.sources import read_report, register_views
from receivables.versions import commit_version, drop_version, stage_version

#: Seconds to wait for the counts of an input after those of the report are there.
WAIT = 10.0


def ageing_report(
    invoices: DataFrame,
    credit_notes: DataFrame,
    payments: DataFrame,
    as_at_date: datetime.date,
    buckets: Sequence[AgeBucket] = AGE_BUCKETS,
    money: DecimalType = MONEY,
) -> DataFrame:
    """The report, lazy and in no particular order.

    It fails when it is computed if an amount is one that ``money`` cannot hold.
    """
    documents = unify_documents(invoices, credit_notes, money)
    return age_documents(outstanding_documents(documents, payments, money), as_at_date, buckets)


def ageing_report_from_views(
    spark: SparkSession,
    as_at_date: datetime.date,
    buckets: Sequence[AgeBucket] = AGE_BUCKETS,
    money: DecimalType = MONEY,
) -> DataFrame:
    """The report from the views ``invoices``, ``credit_notes`` and ``payments``.

    Leaves the stages between as the views ``all_documents`` and
    ``outstanding_documents``, for queries in Spark SQL.
    """
    documents = unify_documents(spark.table("invoices"), spark.table("credit_notes"), money)
    register_views({"all_documents": documents})
    owed = outstanding_documents(spark.table("all_documents"), spark.table("payments"), money)
    register_views({"outstanding_documents": owed})
    return age_documents(spark.table("outstanding_documents"), as_at_date, buckets)


def observed_report(
    inputs: Mapping[str, DataFrame],
    as_at_date: datetime.date,
    buckets: Sequence[AgeBucket] = AGE_BUCKETS,
    money: DecimalType = MONEY,
) -> tuple[DataFrame, Callable[[], list[Finding]]]:
    """The report with the checks of the three inputs and its own riding along.

    One scan of each input serves both. The function gives all findings once the report has
    been written; an input whose checks Spark did not run, as its rows could not matter, is
    checked by a job of its own.
    """
    tables, waiting = {}, {}
    for name, schema in INPUT_SCHEMAS.items():
        tables[name], waiting[name] = observe_checks(inputs[name], name, schema.names, money)
    report, own = observe_checks(
        ageing_report(**tables, as_at_date=as_at_date, buckets=buckets, money=money),
        "ageing_report",
        report_columns(buckets),
    )

    def findings() -> list[Finding]:
        of_report = own(None)
        found: list[Finding] = []
        for name, schema in INPUT_SCHEMAS.items():
            counted = waiting[name](WAIT)
            if counted is None:
                rows = check_table(inputs[name], name, schema.names, money).collect()
                counted = [Finding(**row.asDict()) for row in rows]
            found += counted
        return found + of_report

    return report, findings


def publish_ageing_report(
    inputs: Mapping[str, DataFrame],
    as_at_date: datetime.date,
    store: str,
    csv_base: str | None = None,
    buckets: Sequence[AgeBucket] = AGE_BUCKETS,
    money: DecimalType = MONEY,
    refuse_unparsed: bool = False,
    rejected: str | None = None,
) -> list[Finding]:
    """Computes, checks and stores the report of a date, in one pass over the inputs.

    All checks ride on the write of a version of the date in ``store`` that is committed
    only if they allow it (``receivables.versions``). Nothing a reader sees is touched if the
    inputs are empty, lack columns or hold amounts that ``money`` cannot, nor if the report
    turns out empty; these raise ``ValueError``, as do lines that did not parse with
    ``refuse_unparsed``, of inputs read with ``rejected``. Inputs are read a second time only
    to tell what is wrong with amounts that end the job, and for lines that did not parse,
    which are added to the Parquet table ``rejected`` if it is given. With ``csv_base`` the
    stored date is then written as sorted CSV too. Returns the warnings.
    """
    for name, schema in INPUT_SCHEMAS.items():
        require_columns(inputs[name], name, schema.names)
    as_date_text(as_at_date)
    spark = inputs["invoices"].sparkSession
    report, findings = observed_report(inputs, as_at_date, buckets, money)
    try:
        version = stage_version(report, store, as_at_date)
    except Exception:
        # An amount that is no money ends the job; say which input holds how many.
        enforce(validate_inputs(*(inputs[name] for name in INPUT_SCHEMAS), money))
        raise
    try:
        found = findings()
        unparsed = [f for f in found if f.check_name == "unparsed" and f.violations]
        if unparsed and rejected is not None:
            for finding in unparsed:
                lines = rejected_lines(inputs[finding.table_name], finding.table_name)
                lines.withColumn("as_at_date", as_date(as_at_date)).write.mode("append").parquet(rejected)
        if unparsed and refuse_unparsed:
            found = [f._replace(severity=ERROR) if f in unparsed else f for f in found]
        warnings = enforce(found)
        commit_version(spark, store, as_at_date, version)
    except BaseException:
        drop_version(spark, store, as_at_date, version)
        raise

    if csv_base is not None:
        stored = read_report(spark, store, as_at_date, buckets)
        write_csv(sort_report(stored), csv_base, as_at_date)
    return warnings
