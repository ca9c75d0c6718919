"""Join keys that keep large joins splittable."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_HASH = "_key_hash"


def key_hash(columns: Iterable[str]) -> Column:
    """A 64-bit hash to put in front of the equi-join keys ``columns``.

    Joining on ``(hash, keys...)`` gives the same rows as joining on the keys,
    with two effects on the physical plan when one side comes straight out of an
    aggregate on the same keys:

    * The aggregate's partitioning no longer serves the join, so both sides get
      a shuffle of the join's own. Adaptive execution splits a skewed partition
      only when both sides are such shuffles; without it a single key holding a
      third of the rows, or all rows whose key is NULL, would be one task.
    * The sort before a merge join compares a long first. Ids such as
      ``inv_000001`` agree in their leading bytes, which makes comparing the
      strings themselves slow.

    The price is one more shuffle of the aggregated side, which by then holds
    one narrow row per key.
    """
    return F.xxhash64(*columns).alias(KEY_HASH)
