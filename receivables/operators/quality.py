"""Data quality as rows, one pass per table.

A *check* is an aggregate that counts violations. All checks of a table are
computed in one aggregation, which yields one finding per check, zero counts
included. The same checks can ride on a write, see ``observe_checks``.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, FloatType, StructType

from receivables.functions import AGE_BUCKETS, AgeBucket, rounded_amounts, unfit_amounts
from receivables.layout import report_columns
from receivables.schemas import AMOUNTS, CREDIT_NOTES, INVOICES, MONEY, PAYMENTS, REJECTED

logger = logging.getLogger(__name__)

ERROR = "error"
WARNING = "warning"

# Part of a column name -> the types such a column may have.
TYPE_RULES = {
    "amount": (DecimalType, DoubleType, FloatType),
    "date": (DateType,),
}


class Finding(NamedTuple):
    table_name: str
    check_name: str
    column_name: str
    severity: str
    violations: int


class _Check(NamedTuple):
    check_name: str
    column_name: str
    severity: str
    violations: Column


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _rows() -> Column:
    return F.count(F.lit(1))


def _nulls(name: str) -> Column:
    """Rows less values. Unlike a test of each value this can be pushed into Parquet,
    where the file footers hold both counts."""
    return _rows() - F.count(_column(name))


def _type_checks(schema: StructType) -> list[_Check]:
    """A column of the wrong type counts with every row of its table."""
    return [
        _Check(
            f"{part}_type",
            field.name,
            WARNING,
            F.lit(0).cast("long") if isinstance(field.dataType, allowed) else _rows(),
        )
        for field in schema.fields
        for part, allowed in TYPE_RULES.items()
        if part in field.name.lower()
    ]


def _amount_checks(df: DataFrame, required: Sequence[str], money: DecimalType) -> list[_Check]:
    """What becomes of the amounts when they are made exact."""
    return [
        check
        for name in required
        if name in AMOUNTS and name in df.columns
        for check in (
            _Check("amount_range", name, ERROR, unfit_amounts(df, name, money)),
            _Check("amount_rounding", name, WARNING, rounded_amounts(df, name, money)),
        )
    ]


def _checks(
    df: DataFrame, required: Sequence[str], money: DecimalType = MONEY
) -> list[_Check]:
    present = set(df.columns)
    return [
        _Check("empty", "*", ERROR, (_rows() == 0).cast("long")),
        *(
            _Check("nulls", name, WARNING, _nulls(name))
            if name in present
            else _Check("missing", name, ERROR, F.greatest(_rows(), F.lit(1)))
            for name in required
        ),
        *_type_checks(df.schema),
        *_amount_checks(df, required, money),
        *(
            [_Check("unparsed", "*", WARNING, F.count(_column(REJECTED)))]
            if REJECTED in present
            else []
        ),
    ]


def _per_row(counted: DataFrame, row_type: str, rows: Sequence[Sequence[Column]]) -> DataFrame:
    """The single row of ``counted`` as ``rows``, whose fields ``row_type`` names and types."""
    structs = (
        F.struct(*(value.alias(f"f{i}") for i, value in enumerate(values))) for values in rows
    )
    return counted.select(F.inline(F.array(*structs).cast(f"array<struct<{row_type}>>")))


def _findings(df: DataFrame, table_name: str, checks: Sequence[_Check]) -> DataFrame:
    """One aggregation over ``df``, its single row spread to a finding per check."""
    counted = df.agg(
        _rows().alias("_rows"),
        *(check.violations.alias(f"_{i}") for i, check in enumerate(checks)),
    )
    return _per_row(
        counted,
        "table_name:string,check_name:string,column_name:string,severity:string,violations:bigint",
        [
            (*(F.lit(value) for value in (table_name, *check[:3])), F.col(f"_{i}"))
            for i, check in enumerate(checks)
        ],
    )


def null_profile(df: DataFrame, table_name: str, columns: Sequence[str]) -> DataFrame:
    """Row count and number of NULLs for each of ``columns``."""
    counted = df.agg(
        _rows().alias("_rows"), *(_nulls(name).alias(f"_{i}") for i, name in enumerate(columns))
    )
    return _per_row(
        counted,
        "table_name:string,column_name:string,row_count:bigint,null_count:bigint",
        [
            (F.lit(table_name), F.lit(name), F.col("_rows"), F.col(f"_{i}"))
            for i, name in enumerate(columns)
        ],
    )


def type_findings(df: DataFrame, table_name: str) -> DataFrame:
    """Findings on columns whose name promises an amount or a date.

    ``violations`` is the number of rows if the type does not keep the promise,
    else 0. The count reads no column.
    """
    return _findings(df, table_name, _type_checks(df.schema))


def require_columns(df: DataFrame, table_name: str, required: Iterable[str]) -> None:
    """Raises ``ValueError`` naming the required columns that are missing; runs no job."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{table_name} lacks required columns: {', '.join(missing)}")


def check_table(
    df: DataFrame, table_name: str, required: Sequence[str], money: DecimalType = MONEY
) -> DataFrame:
    """Findings of one table: empty, missing columns, NULLs, types, and for the input
    tables' amounts those that ``money`` cannot hold or rounds."""
    return _findings(df, table_name, _checks(df, required, money))


def rejected_lines(df: DataFrame, table_name: str) -> DataFrame:
    """The lines of a scan with ``REJECTED`` that did not parse: ``table_name``, ``line`` and
    ``empty``, the columns that hold no value, among them those that did not parse.

    A line of the right values but too many fields has none empty. Empty without that column.
    """
    if REJECTED not in df.columns:
        return df.sparkSession.createDataFrame([], "table_name string, line string, empty array<string>")
    names = [name for name in df.columns if name != REJECTED]
    empty = F.array_compact(F.array(*(F.when(_column(n).isNull(), F.lit(n)) for n in names)))
    return df.filter(_column(REJECTED).isNotNull()).select(
        F.lit(table_name).alias("table_name"), _column(REJECTED).alias("line"), empty.alias("empty")
    )


def validate_inputs(
    invoices: DataFrame,
    credit_notes: DataFrame,
    payments: DataFrame,
    money: DecimalType = MONEY,
) -> DataFrame:
    """Findings of the three input tables, computed in one job."""
    return (
        check_table(invoices, "invoices", INVOICES.names, money)
        .unionByName(check_table(credit_notes, "credit_notes", CREDIT_NOTES.names, money))
        .unionByName(check_table(payments, "payments", PAYMENTS.names, money))
    )


def validate_report(
    report: DataFrame, buckets: Sequence[AgeBucket] = AGE_BUCKETS
) -> DataFrame:
    """Findings of a report with these buckets."""
    return check_table(report, "ageing_report", report_columns(buckets))


def observe_checks(
    df: DataFrame, table_name: str, required: Sequence[str], money: DecimalType = MONEY
) -> tuple[DataFrame, Callable[[float | None], list[Finding] | None]]:
    """``df`` with the checks riding along on whatever uses it.

    Returns the DataFrame to go on with and a function that gives the findings once the job
    is done. So a table is checked while it is computed, instead of a second time. The function
    waits for the counts, with a number of seconds no longer than that, and then gives None:
    Spark reports none of a part of the plan that it found it need not run.

    Above a shuffle, what is written, counts are exact. Below one a task repeated after the loss
    of an executor counts again, so a count may come out too high there; it is 0 or not 0 as it
    should be, by which errors and warnings are told.
    """
    checks = _checks(df, required, money)
    observation = Observation()
    observed = df.observe(
        observation, *(check.violations.alias(f"_{i}") for i, check in enumerate(checks))
    )

    def findings(seconds: float | None = None) -> list[Finding] | None:
        found: list[dict] = []

        def wait() -> None:
            try:
                found.append(observation.get)
            except Py4JJavaError:  # there are no counts
                pass

        waiting = threading.Thread(target=wait, daemon=True)
        waiting.start()
        waiting.join(seconds)
        if not found:
            return None
        return [
            Finding(table_name, *check[:3], violations=found[0][f"_{i}"])
            for i, check in enumerate(checks)
        ]

    return observed, findings


def _describe(error: Finding) -> str:
    if error.check_name == "empty":
        return f"{error.table_name} is empty"
    if error.check_name == "amount_range":
        return (
            f"{error.table_name}.{error.column_name} holds {error.violations} amounts that are "
            "no money or too large"
        )
    if error.check_name == "unparsed":
        return f"{error.table_name} holds {error.violations} lines that did not parse"
    return f"{error.table_name} lacks required column {error.column_name}"


def enforce(findings: DataFrame | Iterable[Finding]) -> list[Finding]:
    """Raises ``ValueError`` on errors; logs and returns the warnings.

    Only findings come to the driver, as many as there are checks.
    """
    if isinstance(findings, DataFrame):
        findings = [Finding(**row.asDict()) for row in findings.collect()]
    found = [finding for finding in findings if finding.violations > 0]
    errors = [finding for finding in found if finding.severity == ERROR]
    if errors:
        raise ValueError("; ".join(_describe(error) for error in errors))
    for warning in found:
        logger.warning(
            "%s.%s: %s in %d rows",
            warning.table_name,
            warning.column_name,
            warning.check_name,
            warning.violations,
        )
    return found
