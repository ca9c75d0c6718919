"""Column expressions. All of them are built-in, JVM-side Spark expressions."""

from receivables.functions.ageing import (
    AGE_BUCKETS,
    AgeBucket,
    age_buckets,
    bucket_amount,
    days_between,
)
from receivables.functions.keys import key_hash
from receivables.functions.money import (
    as_money,
    plain_number,
    rounded_amounts,
    unfit_amounts,
)

__all__ = [
    "AGE_BUCKETS",
    "AgeBucket",
    "age_buckets",
    "as_money",
    "bucket_amount",
    "days_between",
    "key_hash",
    "plain_number",
    "rounded_amounts",
    "unfit_amounts",
]
