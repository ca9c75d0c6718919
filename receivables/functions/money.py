"""Exact money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
)

from receivables.schemas import MONEY

# Share of a value that a type may be off by anyway.
_PRECISION = {FloatType: 2.0**-22, DoubleType: 2.0**-50}
_CONVERTED = (
    FloatType,
    DoubleType,
    StringType,
    DecimalType,
    ByteType,
    ShortType,
    IntegerType,
    LongType,
)


def _quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _holds(money: DecimalType, kind: DataType) -> bool:
    """Whether every value of ``kind`` is money as it is."""
    return (
        isinstance(kind, DecimalType)
        and kind.scale <= money.scale
        and kind.precision - kind.scale <= money.precision - money.scale
    )


def _as_is_or_null(amount: Column, kind: DataType, money: DecimalType) -> Column:
    amount = F.trim(amount) if isinstance(kind, StringType) else amount
    return amount.try_cast(money)


def as_money(df: DataFrame, column: str, money: DecimalType = MONEY) -> Column:
    """The amount ``column`` of ``df`` as exact money.

    Numbers of any type and text are rounded half up to the type's decimals, so that sums
    and the test for a settled balance are exact. An amount that the type cannot hold (too
    large, infinite, NaN, or text that is no number) fails the query when it is used: as
    NULL it would make a document or a payment vanish. ``unfit_amounts`` counts such
    amounts beforehand.
    """
    amount, kind = _quoted(column), df.schema[column].dataType
    if kind == money or not isinstance(kind, _CONVERTED):
        return amount
    converted = _as_is_or_null(amount, kind, money)
    if _holds(money, kind):
        return converted
    message = F.concat(
        F.lit(f"{column} cannot hold as {money.simpleString()}: "), amount.cast("string")
    )
    return F.when(amount.isNotNull() & converted.isNull(), F.raise_error(message)).otherwise(
        converted
    )


def unfit_amounts(df: DataFrame, column: str, money: DecimalType = MONEY) -> Column:
    """How many values there are that ``as_money`` fails on."""
    amount, kind = _quoted(column), df.schema[column].dataType
    if not isinstance(kind, _CONVERTED) or _holds(money, kind):
        return F.lit(0).cast("long")
    return F.count_if(amount.isNotNull() & _as_is_or_null(amount, kind, money).isNull())


def rounded_amounts(df: DataFrame, column: str, money: DecimalType = MONEY) -> Column:
    """How many values ``as_money`` changes, by more than their own type is exact to."""
    amount, kind = _quoted(column), df.schema[column].dataType
    if not isinstance(kind, _CONVERTED) or _holds(money, kind):
        return F.lit(0).cast("long")
    converted = _as_is_or_null(amount, kind, money)
    if type(kind) in _PRECISION:
        value = amount.cast("double")
        changed = F.abs(value - converted.cast("double")) > F.abs(value) * _PRECISION[type(kind)]
    else:
        # More decimals than any money here keeps; what overflows this overflows money too.
        exact = _as_is_or_null(amount, kind, DecimalType(38, 18))
        changed = exact != converted
    return F.count_if(converted.isNotNull() & F.coalesce(changed, F.lit(False)))


def plain_number(amount: Column) -> Column:
    """A DOUBLE as text in plain digits: ``12345678.9``, not ``1.23456789E7``.

    The cast to text switches to scientific notation from ten million up and below a
    thousandth. Above, a DOUBLE's 17 significant digits need at most nine decimals; below,
    a money type's decimals are at most 18; DECIMAL(38,9) and DECIMAL(38,18) keep them.
    """

    def digits(decimals: int) -> Column:
        exact = amount.try_cast(f"decimal(38,{decimals})").cast("string")
        return F.regexp_replace(exact, r"(\.\d+?)0+$", "$1")

    size = F.abs(amount)
    return (
        F.when(size.between(1e7, 1e28), digits(9))
        .when((size > 0) & (size < 1e-3) & (size >= 1e-18), digits(18))
        .otherwise(amount.cast("string"))
    )
