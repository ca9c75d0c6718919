import datetime

import pytest
from helpers import AS_AT, REPORT, REPORT_COLUMNS, credit_notes, invoices, payments
from hypothesis import given
from hypothesis import strategies as st

from receivables.functions import AGE_BUCKETS, age_buckets
from receivables.operators import (
    bucketize,
    outstanding_documents,
    sort_report,
    unify_documents,
    with_days,
)
from receivables.plans import ageing_report

NAMES = [bucket.column for bucket in AGE_BUCKETS]


def owed(spark, *rows):
    return outstanding_documents(
        unify_documents(invoices(spark, *rows), credit_notes(spark)), payments(spark)
    )


def test_every_bucket_edge(spark):
    # First and last day of each bucket.
    expected = {
        -1: None,
        0: "day_30",
        30: "day_30",
        31: "day_60",
        60: "day_60",
        61: "day_90",
        90: "day_90",
        91: "day_120",
        120: "day_120",
        121: "day_150",
        150: "day_150",
        151: "day_180",
        180: "day_180",
        181: "day_180_and_above",
        4000: "day_180_and_above",
        None: None,
    }
    rows = [
        (str(days), None if days is None else str(AS_AT - datetime.timedelta(days)), 9)
        for days in expected
    ]
    result = bucketize(with_days(owed(spark, *rows), AS_AT)).collect()
    assert len(result) == len(expected)
    for row in result:
        days = row.days_outstanding
        assert row.document_id == str(days)
        filled = [name for name in NAMES if row[name] != 0]
        assert filled == ([expected[days]] if expected[days] else [])
        assert all(row[name] == 9 for name in filled)
        assert all(row[name] is not None for name in NAMES)


def test_other_limits(spark):
    buckets = age_buckets((7, 14))
    assert [tuple(bucket) for bucket in buckets] == [
        ("day_7", 0, 7),
        ("day_14", 8, 14),
        ("day_14_and_above", 15, None),
    ]
    report = ageing_report(
        invoices(spark, ("a", str(AS_AT - datetime.timedelta(8)), 5)),
        credit_notes(spark),
        payments(spark),
        AS_AT,
        buckets,
    )
    row = report.first()
    assert (row.day_7, row.day_14, row.day_14_and_above) == (0.0, 5.0, 0.0)


@given(
    st.sets(st.integers(0, 400), min_size=1, max_size=9).map(sorted),
    st.integers(0, 500),
)
def test_buckets_cover_every_day_once(limits, day):
    buckets = age_buckets(limits)
    holding = [b for b in buckets if b.low <= day and (b.high is None or day <= b.high)]
    assert len(holding) == 1
    assert len({b.column for b in buckets}) == len(buckets) == len(limits) + 1


@pytest.mark.parametrize("limits", [(), (30, 30), (60, 30), (-1, 5)])
def test_bad_limits(limits):
    with pytest.raises(ValueError):
        age_buckets(limits)


@pytest.mark.parametrize("bad", ["2025-04-07", datetime.datetime(2025, 4, 7), None, 20250407])
def test_as_at_date_must_be_a_date(spark, bad):
    with pytest.raises(TypeError):
        with_days(owed(spark), bad)


def test_report_schema(spark):
    report = ageing_report(invoices(spark), credit_notes(spark), payments(spark), AS_AT)
    assert report.columns == REPORT_COLUMNS
    for field in REPORT.fields:
        assert report.schema[field.name].dataType == field.dataType
    assert not report.schema["document_type"].nullable
    assert not report.schema["as_at_date"].nullable


def test_sort_order(spark):
    rows = [
        ("b", "c_2", "k", "s", "2025-01-01", 1),
        ("a", "c_2", "k", "s", "2025-01-01", 1),
        (None, "c_2", "k", "s", "2025-01-01", 1),
        ("a", "0_2", "k", "s", "2025-01-01", 1),
        ("a", None, "k", "s", "2025-01-01", 1),
        ("a", "C_2", "k", "s", "2025-01-01", 1),
        ("z", "c_2", None, "s", "2025-01-01", 1),
    ]
    report = ageing_report(
        invoices(spark, *rows), credit_notes(spark, rows[1]), payments(spark), AS_AT
    )
    result = sort_report(report)
    assert result.columns == report.columns
    got = [(r.centre_id, r.class_id, r.document_id, r.document_type) for r in result.collect()]
    assert got == [
        (None, "k", "a", "invoice"),
        ("0_2", "k", "a", "invoice"),
        ("C_2", "k", "a", "invoice"),
        ("c_2", None, "z", "invoice"),
        ("c_2", "k", None, "invoice"),
        ("c_2", "k", "a", "credit_note"),
        ("c_2", "k", "a", "invoice"),
        ("c_2", "k", "b", "invoice"),
    ]
