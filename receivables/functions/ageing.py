"""Age in days and the age buckets."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class AgeBucket(NamedTuple):
    """Days ``low`` to ``high``, both included; no ``high`` means no upper end."""

    column: str
    low: int
    high: int | None


def age_buckets(limits: Sequence[int] = (30, 60, 90, 120, 150, 180)) -> tuple[AgeBucket, ...]:
    """Buckets without gaps: 0 to the first limit, on to each next one, then the rest."""
    if not limits or limits[0] < 0 or any(a >= b for a, b in zip(limits, limits[1:])):
        raise ValueError(f"limits must be non-negative and rising, got {tuple(limits)}")
    lows = (0, *(limit + 1 for limit in limits))
    closed = [AgeBucket(f"day_{high}", low, high) for low, high in zip(lows, limits)]
    return (*closed, AgeBucket(f"day_{limits[-1]}_and_above", lows[-1], None))


AGE_BUCKETS = age_buckets()


def _checked(value: datetime.date) -> datetime.date:
    """Text and date-times are refused instead of being guessed at."""
    if not isinstance(value, datetime.date) or isinstance(value, datetime.datetime):
        raise TypeError(f"expected a datetime.date, got {value!r}")
    return value


def as_date(value: datetime.date) -> Column:
    """A DATE literal."""
    return F.lit(_checked(value))


def as_date_text(value: datetime.date) -> str:
    """``YYYY-MM-DD``, as dates occur in paths."""
    return _checked(value).isoformat()


def days_between(as_at_date: datetime.date, document_date: Column) -> Column:
    """Days from the document's date to the as-at date; negative for a future date."""
    return F.date_diff(as_date(as_at_date), document_date)


def bucket_amount(bucket: AgeBucket, days: Column, amount: Column) -> Column:
    """The amount if its age lies in the bucket, else 0 (also for a NULL age)."""
    inside = days >= bucket.low if bucket.high is None else days.between(bucket.low, bucket.high)
    return F.when(inside, amount).otherwise(F.lit(0)).alias(bucket.column)
