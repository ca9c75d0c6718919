"""Exact top-k search by inner product over a bit-sliced index.

A component x becomes the integer floor(256 x), taken from the least one of its block and
dimension. The index holds, for each block of rows and each dimension, one bitmap over the
rows for each binary digit. A query's scores over a block come from bitmap arithmetic: each
digit of each weight adds one slice, by carry-save additions, into slices of the sums (a
negative weight adds the slice's complement). The best rows are picked from the most
significant slice downwards; rows that tie at the boundary are settled by the smaller id.
All of it is in whole numbers, so scores are exact and nothing needs a second look.

Results by case: a row whose vector or id is NULL, whose vector is empty or holds a NULL,
NaN or infinite component takes no part; vectors of different lengths are compared as if
the shorter ended in zeros; a repeated row is a candidate for its copies, not for itself;
with fewer than k candidates all are returned, with none no row; an empty table gives an
empty one; further columns of the input are ignored. A component of ``MOST`` or more, and
scores that may not fit a LONG, end the query with an error that names the row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.llm.common import stored

SCALE = 256
BLOCK = 1 << 15
CHUNK = 4096
MOST = float(1 << 40)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``row`` (its own number), ``id`` and ``q``, the whole-number components."""
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("id").isNotNull()
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    far = F.exists("v", lambda x: F.abs(x) >= MOST)
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    refused = F.raise_error(F.concat(F.lit(f"a component is {MOST} or more in row "), F.col("id").cast("string")))
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(usable)
        .filter(F.coalesce(finite, F.lit(False)))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.when(far, refused).otherwise(whole).alias("q"),
        )
    )


def slices_of(values: np.ndarray) -> tuple[int, np.ndarray]:
    """The least value, and a bitmap over the rows for each digit of what lies above it."""
    low = int(values.min())
    above = (values - low).astype(np.uint64)
    digits = np.arange(max(int(above.max()).bit_length(), 1), dtype=np.uint64)
    bits = (above[None, :] >> digits[:, None]) & np.uint64(1)
    packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((len(digits), -(-len(values) // 64) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return low, padded.view(np.uint64)


def add_slices(weights: list[int], slices: list[tuple[int, np.ndarray]]) -> tuple[int, list]:
    """The sum of weight times value as a constant and the slices of the rest, lowest first."""
    constant = 0
    columns: list[list[np.ndarray]] = []

    def put(digit: int, bitmap: np.ndarray) -> None:
        while len(columns) <= digit:
            columns.append([])
        columns[digit].append(bitmap)

    for weight, (low, bitmaps) in zip(weights, slices):
        constant += weight * low
        if weight < 0:  # w x = |w| (top - x) - |w| top
            constant += weight * ((1 << len(bitmaps)) - 1)
            bitmaps = ~bitmaps
        for shift in range(abs(weight).bit_length()):
            if abs(weight) >> shift & 1:
                for digit, bitmap in enumerate(bitmaps):
                    put(digit + shift, bitmap)
    digit = 0
    while digit < len(columns):
        column = columns[digit]
        while len(column) > 1:
            if len(column) > 2:  # three slices make a sum and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                either = a ^ b
                column.append(either ^ c)
                put(digit + 1, (a & b) | (either & c))
            else:
                a, b = column.pop(), column.pop()
                column.append(a ^ b)
                put(digit + 1, a & b)
        digit += 1
    return constant, [column[0] if column else None for column in columns]


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(sums: list, allowed: np.ndarray, k: int) -> np.ndarray:
    """At least the k best of the allowed rows: those above the boundary and all that tie
    with it, found from the most significant slice downwards."""
    surely, open_ = np.zeros_like(allowed), allowed
    for bitmap in reversed(sums):
        if bitmap is None:
            continue
        ones = open_ & bitmap
        if _count(surely) + _count(ones) >= k:
            open_ = ones
        else:
            surely, open_ = surely | ones, open_ & ~bitmap
    return _rows(surely | open_)


def values_at(constant: int, sums: list, rows: np.ndarray) -> np.ndarray:
    """The sums of some rows, read off the slices."""
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    found = np.full(len(rows), constant, np.int64)
    for digit, bitmap in enumerate(sums):
        if bitmap is not None:
            found += ((bitmap[word] >> bit) & np.uint64(1)).astype(np.int64) << digit
    return found


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """A row for each block and dimension: ``low`` and its slices. Dimension -1 holds the
    ids and row numbers of the block, in the order of the bitmaps, which is that of ids."""

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"])
        width = max(map(len, pdf["q"]))
        values = np.zeros((len(pdf), width), np.int64)
        for i, q in enumerate(pdf["q"]):
            values[i, : len(q)] = q
        out = [
            (-1, 0, [pdf["id"].to_numpy(np.int64).tobytes(), pdf["row"].to_numpy(np.int64).tobytes()])
        ]
        for d in range(width):
            low, bitmaps = slices_of(values[:, d])
            out.append((d, low, [bitmap.tobytes() for bitmap in bitmaps]))
        found = pd.DataFrame(out, columns=["dimension", "low", "slices"])
        found.insert(0, "block", pdf["block"].iloc[0])
        return found

    blocked = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return blocked.groupBy("block").applyInPandas(
        index, "block int, dimension int, low long, slices array<binary>"
    )


def search_top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query: str = "vec_id % 50 = 0",
    k: int = 5,
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """The k best rows for each row that ``query`` picks: ``query_id``, ``rank``, ``vec_id``
    and ``score``. Ids are integers.

    Every chunk of queries meets every block of the index in a task of its own, one query
    after another, whatever their number; each returns at most k rows a query. The index is sent
    once per ``chunk`` queries, or as often as it takes to give every core a task.
    """
    rows = stored(quantised(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    blocks = max(1, -(-n // block))
    index = stored(build_index(rows, blocks), "index")
    picked = rows.withColumnRenamed("id", id_col).filter(query).withColumnRenamed(id_col, "id")
    asking = picked.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-asking // chunk), min(-(-asking // 128), -(-cores // blocks)))
    asked = picked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def search(queries: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(slices):
            names = slices.loc[slices["dimension"] < 0, "slices"].iloc[0]
            ids, numbers = (np.frombuffer(name, np.int64) for name in names)
            part = slices[slices["dimension"] >= 0].sort_values("dimension")
            own = [
                (int(low), np.stack([np.frombuffer(bitmap, np.uint64) for bitmap in bitmaps]))
                for low, bitmaps in zip(part["low"], part["slices"])
            ]
            every = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
            every = np.pad(every, (0, own[0][1].shape[1] * 8 - len(every))).view(np.uint64)
            for number, query_id, q in zip(queries["row"], queries["id"], queries["q"]):
                constant, sums = add_slices([int(x) for x in q], own)
                if len(sums) > 62 or abs(constant) >> 62:
                    raise OverflowError(f"scores of row {query_id} may be beyond a LONG")
                allowed = every.copy()
                for i in np.flatnonzero(numbers == number):
                    allowed[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
                best = top_rows(sums, allowed, k)
                scores = values_at(constant, sums, best)
                order = np.lexsort((ids[best], -scores))[:k]
                out += [
                    (query_id, number, ids[best[i]], numbers[best[i]], scores[i]) for i in order
                ]
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "row", "score"])

    found = (
        asked.groupBy("block", "chunk")
        .cogroup(spread.groupBy("block", "chunk"))
        .applyInPandas(search, "query_id long, query_row long, vec_id long, row long, score long")
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
