import logging

import pytest
from helpers import AS_AT, REPORT, credit_notes, invoices, payments
from pyspark.sql import functions as F

from receivables.functions import age_buckets
from receivables.operators import (
    Finding,
    check_table,
    enforce,
    null_profile,
    observe_checks,
    require_columns,
    type_findings,
    validate_inputs,
    validate_report,
)
from receivables.plans import ageing_report
from receivables.schemas import INVOICES

DAY = "2025-01-01"


def found(findings):
    return {
        (row.check_name, row.column_name): row.violations
        for row in findings.collect()
        if row.violations
    }


def test_null_profile(spark):
    table = invoices(spark, ("a", DAY, None), (None, DAY, None), ("c", None, 1))
    rows = null_profile(table, "invoices", table.columns).collect()
    assert [row.column_name for row in rows] == table.columns
    assert {row.row_count for row in rows} == {3}
    assert {row.table_name for row in rows} == {"invoices"}
    assert [row.null_count for row in rows] == [1, 0, 0, 0, 1, 2]


def test_clean_table_has_only_zero_counts(spark):
    findings = check_table(invoices(spark, ("a", DAY, 1)), "invoices", INVOICES.names)
    rows = findings.collect()
    assert [(row.check_name, row.column_name) for row in rows] == [
        ("empty", "*"),
        *(("nulls", name) for name in INVOICES.names),
        ("date_type", "invoice_date"),
        ("amount_type", "total_amount"),
        ("amount_range", "total_amount"),
        ("amount_rounding", "total_amount"),
    ]
    assert {row.violations for row in rows} == {0}
    assert enforce(findings) == []


def test_empty_table_is_an_error(spark):
    findings = check_table(invoices(spark), "invoices", INVOICES.names)
    assert found(findings) == {("empty", "*"): 1}
    with pytest.raises(ValueError, match="invoices is empty"):
        enforce(findings)


def test_missing_columns_are_an_error(spark):
    table = invoices(spark, ("a", DAY, 1)).drop("class_id", "total_amount")
    findings = check_table(table, "invoices", INVOICES.names)
    assert found(findings) == {("missing", "class_id"): 1, ("missing", "total_amount"): 1}
    with pytest.raises(ValueError, match="class_id.*total_amount"):
        enforce(findings)
    with pytest.raises(ValueError, match="invoices lacks.* class_id, total_amount"):
        require_columns(table, "invoices", INVOICES.names)


def test_columns_missing_from_an_empty_table(spark):
    findings = check_table(invoices(spark).drop("class_id"), "invoices", INVOICES.names)
    assert found(findings) == {("empty", "*"): 1, ("missing", "class_id"): 1}
    with pytest.raises(ValueError, match="invoices is empty; .*class_id"):
        enforce(findings)


def test_column_names_are_case_sensitive(spark):
    table = invoices(spark, ("a", DAY, 1)).withColumnRenamed("class_id", "Class_Id")
    assert found(check_table(table, "invoices", INVOICES.names)) == {("missing", "class_id"): 1}


def test_nulls_are_warnings(spark, caplog):
    table = invoices(spark, ("a", DAY, None), ("b", DAY, None))
    findings = check_table(table, "invoices", INVOICES.names)
    with caplog.at_level(logging.WARNING, "receivables"):
        warnings = enforce(findings)
    assert warnings == [Finding("invoices", "nulls", "total_amount", "warning", 2)]
    assert "invoices.total_amount: nulls in 2 rows" in caplog.text


def test_type_rules_look_at_all_columns_whatever_their_case(spark):
    table = spark.range(2).select(
        F.lit("1").alias("Paid_AMOUNT"),
        F.lit(1).alias("amount_int"),
        F.lit(1.0).alias("amount_double"),
        F.lit(1.0).cast("float").alias("amount_float"),
        F.lit(1).cast("decimal(5,1)").alias("amount_decimal"),
        F.current_timestamp().alias("Seen_At"),
        F.current_date().alias("due_date"),
        F.lit(1.5).alias("date_amount"),
        F.lit("x").alias("other"),
    )
    assert found(type_findings(table, "t")) == {
        ("amount_type", "Paid_AMOUNT"): 2,
        ("amount_type", "amount_int"): 2,
        ("date_type", "date_amount"): 2,
    }
    # The rule looks for "date" anywhere in the name.
    stamped = spark.range(1).select(F.current_timestamp().alias("Update_Time"))
    assert found(type_findings(stamped, "t")) == {("date_type", "Update_Time"): 1}


def test_table_without_rules(spark):
    assert type_findings(spark.range(3), "t").collect() == []
    assert null_profile(spark.range(3), "t", []).collect() == []


def test_odd_column_names(spark):
    table = spark.range(1).select(F.lit(None).cast("string").alias("a.b`c"))
    assert found(check_table(table, "t", ["a.b`c"])) == {("nulls", "a.b`c"): 1}


def test_inputs_report_all_tables(spark):
    findings = validate_inputs(invoices(spark), credit_notes(spark, ("c", DAY, 1)), payments(spark))
    assert {row.table_name for row in findings.collect()} == {
        "invoices",
        "credit_notes",
        "payments",
    }
    with pytest.raises(ValueError, match="invoices is empty; payments is empty"):
        enforce(findings)


def test_report_findings(spark):
    report = ageing_report(
        invoices(spark, ("a", None, 1), ("b", DAY, 1)), credit_notes(spark), payments(spark), AS_AT
    )
    assert found(validate_report(report)) == {("nulls", "document_date"): 1}


def test_report_findings_with_other_limits(spark):
    limits = age_buckets((7, 14, 28))
    inputs = invoices(spark, ("a", DAY, 1)), credit_notes(spark), payments(spark)
    report = ageing_report(*inputs, AS_AT, limits)
    assert found(validate_report(report, limits)) == {}
    assert len(found(validate_report(report))) == 7


def test_observed_checks_equal_computed_ones(spark, tmp_path):
    table = invoices(spark, ("a", DAY, None), (None, None, 1)).withColumn("due_date", F.lit("x"))
    required = [*INVOICES.names, "absent"]
    observed, findings = observe_checks(table, "invoices", required)
    observed.write.parquet(str(tmp_path / "out"))
    computed = check_table(table, "invoices", required).collect()
    assert findings() == [Finding(**row.asDict()) for row in computed]


def test_observed_empty_table(spark, tmp_path):
    report = ageing_report(invoices(spark), credit_notes(spark), payments(spark), AS_AT)
    observed, findings = observe_checks(report, "ageing_report", REPORT.names)
    observed.write.parquet(str(tmp_path / "out"))
    with pytest.raises(ValueError, match="ageing_report is empty"):
        enforce(findings())
