"""Versions of a stored date, publishing in one pass, and lines that do not parse."""

import datetime
import re

import golden
import pytest
from helpers import credit_notes, in_any_order, invoices, payments
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from receivables import versions
from receivables.functions import age_buckets
from receivables.operators import check_table, rejected_lines
from receivables.plans import ageing_report, observed_report, publish_ageing_report
from receivables.schemas import INPUT_SCHEMAS, INVOICES, REJECTED
from receivables.sources import read_inputs, read_report, read_table

DATE = datetime.date(2025, 4, 7)


def small_report(spark, *ids):
    tables = {
        "invoices": invoices(spark, *((i, "2025-01-01", 5) for i in ids)),
        "credit_notes": credit_notes(spark),
        "payments": payments(spark),
    }
    return ageing_report(**tables, as_at_date=DATE)


def write(spark, store, report, date=DATE):
    return versions.commit_version(spark, store, date, versions.stage_version(report, store, date))


def ids(df):
    return sorted(row.document_id for row in df.collect())


def test_latest_version_is_read_and_old_ones_stay(spark, tmp_path):
    store, later = str(tmp_path / "store"), DATE + datetime.timedelta(1)
    assert versions.read_version(spark, store, DATE) is None
    assert versions.list_versions(spark, store).count() == 0
    assert write(spark, store, small_report(spark, "a")) == 1
    before = read_report(spark, store, DATE)
    assert write(spark, store, small_report(spark, "b", "c")) == 2
    assert write(spark, store, small_report(spark, "d"), later) == 1
    assert ids(before) == ["a"]  # what was opened before a commit stays as it was
    assert ids(read_report(spark, store, DATE)) == ["b", "c"]
    assert ids(read_report(spark, store)) == ["b", "c", "d"]
    assert ids(versions.read_version(spark, store, DATE, number=1)) == ["a"]
    assert {(r.as_at_date, r.number, r.rows) for r in versions.list_versions(spark, store).collect()} == {
        (DATE, 1, 1), (DATE, 2, 2), (later, 1, 1)
    }
    with pytest.raises(ValueError, match="no version 7"):
        versions.read_version(spark, store, DATE, number=7)
    with pytest.raises(ValueError, match="day_30"):
        versions.read_version(spark, store, DATE, age_buckets((7,)))


def test_a_failed_or_unfinished_write_is_not_read(spark, tmp_path):
    store = str(tmp_path / "store")
    write(spark, store, small_report(spark, "a"))
    files = sorted(str(f.relative_to(store)) for f in (tmp_path / "store").rglob("*.parquet"))
    broken = small_report(spark, *"bcdefgh").repartition(4).withColumn(
        "day_30", F.when(F.col("document_id") == "h", F.raise_error(F.lit("broken"))).otherwise(F.col("day_30"))
    )
    with pytest.raises(PySparkException, match="broken"):
        versions.stage_version(broken, store, DATE)
    assert sorted(str(f.relative_to(store)) for f in (tmp_path / "store").rglob("*.parquet")) == files
    staged = versions.stage_version(small_report(spark, "b"), store, DATE)
    assert ids(read_report(spark, store, DATE)) == ids(read_report(spark, store)) == ["a"]
    versions.drop_version(spark, store, DATE, staged)
    empty = versions.stage_version(small_report(spark), store, DATE)
    with pytest.raises(ValueError, match="empty"):
        versions.commit_version(spark, store, DATE, empty)
    assert ids(read_report(spark, store, DATE)) == ["a"]


def test_a_lost_file_is_an_error(spark, tmp_path):
    store = str(tmp_path / "store")
    write(spark, store, small_report(spark, *"abcdefgh").repartition(3))
    report = read_report(spark, store, DATE)
    next((tmp_path / "store").rglob("part-*.parquet")).unlink()
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        report.collect()
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        read_report(spark, store, DATE)


def test_of_two_commits_with_one_number_all_readers_take_the_same(spark, tmp_path):
    store = str(tmp_path / "store")
    staged = sorted(versions.stage_version(small_report(spark, i), store, DATE) for i in "ab")
    numbers = [versions.commit_version(spark, store, DATE, version) for version in reversed(staged)]
    assert numbers == [1, 2]
    commits = tmp_path / "store" / "commits" / f"as_at_date={DATE}"
    for file in commits.glob("part-*.json"):
        file.write_text(re.sub('"number":2', '"number":1', file.read_text()))
        (commits / f".{file.name}.crc").unlink(missing_ok=True)
    rows = read_report(spark, store, DATE).collect()
    files = versions.list_versions(spark, store).filter(F.col("version") == staged[1]).count()
    assert len(rows) == 1 and files == 1
    assert ids(spark.read.parquet(versions._folder(store, DATE, staged[1]))) == [rows[0].document_id]


def csv_inputs(spark, tmp_path, case, **options):
    paths = {}
    for name, table in golden.tables(spark, case).items():
        paths[name] = str(tmp_path / name)
        table.coalesce(1).write.csv(paths[name], header=True)
    return read_inputs(spark, paths, rejected=True, **options)


def test_publishing_scans_each_input_once(spark, tmp_path, monkeypatch):
    """One scan of each in the report's plan, and no check by a job of its own."""
    case, store = golden.SMALL, str(tmp_path / "store")
    inputs = csv_inputs(spark, tmp_path, case)
    report, _ = observed_report(inputs, case["as_at_date"])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan csv", plan)) == 3
    for name in ("check_table", "validate_inputs"):
        monkeypatch.setattr(f"receivables.plans.report.{name}", None)
    assert publish_ageing_report(inputs, case["as_at_date"], store) == []
    stored = read_report(spark, store, case["as_at_date"]).collect()
    assert in_any_order(stored) == in_any_order(golden.report_rows(case))


def test_observed_findings_are_those_of_the_checks(spark, tmp_path):
    inputs = {
        "invoices": invoices(spark, ("a", None, 5), ("b", "2025-01-01", None), ("c", "2025-01-01", 5)),
        "credit_notes": credit_notes(spark, ("c", "2025-01-01", 1)),
        "payments": payments(spark, ("a", "invoice", 1), (None, "invoice", 1)),
    }
    report, findings = observed_report(inputs, DATE)
    report.write.parquet(str(tmp_path / "report"))
    expected = [
        tuple(row)
        for name, schema in INPUT_SCHEMAS.items()
        for row in check_table(inputs[name], name, schema.names).collect()
    ]
    assert [tuple(f) for f in findings() if f.table_name != "ageing_report"] == expected


def test_refused_inputs_leave_no_trace(spark, tmp_path):
    case, store = golden.SMALL, tmp_path / "store"
    inputs = golden.tables(spark, case)
    publish_ageing_report(inputs, case["as_at_date"], str(store))
    before = sorted(store.rglob("*"))
    for name in ("payments", "credit_notes"):
        with pytest.raises(ValueError, match=f"{name} is empty"):
            publish_ageing_report({**inputs, name: inputs[name].limit(0)}, case["as_at_date"], str(store))
        assert sorted(store.rglob("*")) == before
    publish_ageing_report(inputs, case["as_at_date"], str(store))
    assert versions.list_versions(spark, str(store)).count() == 2


LINES = """id,centre_id,class_id,student_id,invoice_date,total_amount
good,c,k,s,2025-01-01,10.00
number,c,k,s,2025-01-01,abc
date,c,k,s,2025-13-45,10.00
short,c,k,s
long,c,k,s,2025-01-01,10.00,extra

empty,,,,,
"quoted,",c,k,s,2025-01-01,12.345
large,c,k,s,2025-01-01,99999999999999999999.00
"""


def test_lines_that_do_not_parse(spark, tmp_path):
    path = tmp_path / "invoices.csv"
    path.write_text(LINES)
    table = read_table(spark, str(path), "csv", INVOICES, rejected=True)
    found = rejected_lines(table, "invoices").collect()
    assert {(row.table_name, row.line, tuple(row.empty)) for row in found} == {
        ("invoices", "number,c,k,s,2025-01-01,abc", ("total_amount",)),
        ("invoices", "date,c,k,s,2025-13-45,10.00", ("invoice_date",)),
        ("invoices", "short,c,k,s", ("invoice_date", "total_amount")),
        ("invoices", "long,c,k,s,2025-01-01,10.00,extra", ()),
        ("invoices", "large,c,k,s,2025-01-01,99999999999999999999.00", ("total_amount",)),
    }
    found = {(r.check_name, r.column_name): r.violations for r in check_table(table, "i", INVOICES.names).collect()}
    assert found["unparsed", "*"] == 5
    assert found["nulls", "total_amount"] == 4 and found["nulls", "invoice_date"] == 3
    plain = read_table(spark, str(path), "csv", INVOICES)
    assert REJECTED not in plain.columns and rejected_lines(plain, "invoices").count() == 0


def test_publishing_with_lines_that_do_not_parse(spark, tmp_path):
    case = golden.SMALL
    inputs = csv_inputs(spark, tmp_path, case)
    (tmp_path / "bad.csv").write_text(LINES)
    inputs["invoices"] = read_table(spark, str(tmp_path / "bad.csv"), "csv", INVOICES, rejected=True)
    store, lines = tmp_path / "store", str(tmp_path / "lines")
    with pytest.raises(ValueError, match="invoices holds 5 lines that did not parse"):
        publish_ageing_report(inputs, DATE, str(store), refuse_unparsed=True)
    assert not store.exists()
    warnings = publish_ageing_report(inputs, DATE, str(store), rejected=lines)
    assert ("invoices", "unparsed", 5) in {(w.table_name, w.check_name, w.violations) for w in warnings}
    stored = spark.read.parquet(lines)
    assert stored.count() == 5 and {r.as_at_date for r in stored.collect()} == {DATE}
    found = ids(read_report(spark, str(store), DATE).filter("document_type = 'invoice'"))
    assert found == ["date", "good", "long", "quoted,"]
