"""Payments for unknown documents left out before the shuffle.

Such payments are ignored by the report, but only the join finds that out, after all of them
have been sent to it. Here a Bloom filter of the documents' keys, a bitmap of bounded size,
goes to the payments first. It lets through every payment for a known document and few others,
so results are the same, and the shuffle has what the documents need.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivables.schemas import DOCUMENT_KEY

#: Bits of the bitmap as a power of two: at most 2^27, of which a broadcast holds 2^21 words.
FILTER_BITS = 24
MOST_FILTER_BITS = 27
#: A fuller bitmap lets too much through to be worth its making.
MOST_FILL = 0.5


def _places(keys: Iterable[str], bits: int) -> list[Column]:
    """Two places in the bitmap, from different bits of the key's hash."""
    digest = F.xxhash64(*keys)
    return [F.shiftrightunsigned(digest, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in (0, 64 - bits)]


def _word(place: Column) -> Column:
    return F.shiftrightunsigned(place, 6)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def key_filter(documents: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The bitmap as rows ``(word, bits)``, at most 2^(bits - 6) of them, words of zeros left out.

    Bits of a task's documents are put together before the shuffle.
    """
    if not 6 < bits <= MOST_FILTER_BITS:
        raise ValueError(f"a filter has 2^7 to 2^{MOST_FILTER_BITS} bits, not 2^{bits}")
    place = F.explode(F.array(*_places(DOCUMENT_KEY, bits))).alias("place")
    known = documents.dropna(subset=list(DOCUMENT_KEY)).select(place)
    return known.groupBy(_word(F.col("place")).alias("word")).agg(F.bit_or(_bit(F.col("place"))).alias("bits"))


def payments_for(payments: DataFrame, documents: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``payments`` without most of those whose document is not in ``documents``.

    Runs a job that makes the bitmap, collected as it is bounded. With more documents than the
    bitmap serves the payments come back as they are.
    """
    words = key_filter(documents, bits).toArrow()
    spark = payments.sparkSession
    filled = sum(int(w).bit_count() if w >= 0 else (int(w) + (1 << 64)).bit_count() for w in words["bits"].to_pylist())
    if filled > MOST_FILL * (1 << bits):
        return payments
    bitmap = spark.createDataFrame(words.to_pandas(), "word long, bits long")
    places = _places(DOCUMENT_KEY, bits)
    kept = payments.dropna(subset=list(DOCUMENT_KEY))
    for i, place in enumerate(places):
        # At most 2^21 words of 16 bytes; a semi-join, as only the words with the bit stay.
        side = F.broadcast(bitmap.select(F.col("word").alias(f"_word_{i}"), F.col("bits").alias(f"_bits_{i}")))
        on = (_word(place) == F.col(f"_word_{i}")) & (F.col(f"_bits_{i}").bitwiseAND(_bit(place)) != 0)
        kept = kept.join(side, on, "left_semi")
    return kept
