"""Whitening by principal components from an exact characteristic polynomial.

A component c becomes the whole number x = floor(64 c) + 1,000,000. The fit list holds each
distinct vector of them once. Its scatter matrix, n times the sum of products less the
product of the sums, is integer and exact; it is n squared times the covariance. Its
characteristic polynomial is found modulo many primes, each by reduction to Hessenberg form
in a task of its own, and lifted by Chinese remaindering. The polynomial has real roots
only, so the number of roots above a point is the number of sign changes of its Taylor
coefficients there, which isolates the largest roots, multiple ones included, and bisection
refines them far beyond a double. A component is the null space of the matrix less its root,
found by inverse iteration in long fixed-point numbers.

The data are reduced in Spark; what reaches the driver is a matrix of the vectors' length.

Results by case: a row whose vector is NULL or holds a NULL, NaN or infinite component takes
no part, an empty vector has no components and no rows; a shorter vector counts as ending in
zeros; repeated rows and copies count once in the fit and each have their own rows in the
result, a NULL id included; components are numbered by falling eigenvalue, those that share
one in any order, and those of eigenvalue zero are left out, as nothing can be whitened by
them, so a list of one distinct vector gives no rows; an empty table gives an empty one;
further columns of the input are ignored. A component beyond ``MOST`` or a deviation beyond
a LONG is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivables.llm.common import stored, type_of

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
MOST = float(1 << 40)

#: Binary places to which roots are found, and of the numbers in inverse iteration.
ROOT_BITS = 128
WORK_BITS = 256


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``y``, the whole numbers less ``OFFSET``, of the rows that take part."""
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    far = F.exists("v", lambda c: F.abs(c) >= MOST)
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("long"))
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))
        .select("id", F.when(far, F.raise_error(F.lit(f"a component is {MOST} or more"))).otherwise(whole).alias("y"))
    )


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a batch as rows, ended with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _exact(rows: np.ndarray, bits: int) -> np.ndarray:
    """As Python's whole numbers if products and sums of the rows may go beyond ``bits``."""
    most = int(np.abs(rows).max(initial=0))
    return rows if most * most * max(len(rows), rows.shape[1]) < 1 << bits else rows.astype(object)


def scatter_of(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """The number of rows of ``y``, their sums and the sums of products, exact."""
    upper = np.triu_indices(width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + len(upper[0]), object)
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                y = _exact(_matrix(batch.slice(first, 4096).column(0), width), 62)
                total[0] += len(y)
                total[1 : 1 + width] += y.sum(axis=0)
                total[1 + width :] += (y.T @ y)[upper]
        if total[0]:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["k", "v"])

    parts = fit.select("y").mapInArrow(sums, "k int, v decimal(38,0)")
    found = {k: int(v) for k, v in parts.groupBy("k").agg(F.sum("v")).collect()}
    if not found:
        return 0, [], []
    products = [[0] * width for _ in range(width)]
    for k, (i, j) in enumerate(zip(*upper)):
        products[i][j] = products[j][i] = found[1 + width + k]
    return found[0], [found[1 + i] for i in range(width)], products


def _is_prime(p: int) -> bool:
    """Miller-Rabin, certain for odd numbers below 3,215,031,751 with these four bases."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        power = pow(base, odd, p)
        if power in (1, p - 1):
            continue
        if not any((power := power * power % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, largest first, whose product is more than ``bound``."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def characteristic_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo ``p``, constant first, by Hessenberg form."""
    h, size = matrix % p, len(matrix)
    for m in range(1, size - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if (i := m + below[0]) != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        times = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - times[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * times % p).sum(axis=1)) % p
    # Leading minors from the top: each is a combination of those before it.
    minors = np.zeros((size + 1, size + 1), np.int64)
    minors[0, 0] = 1
    for k in range(size):
        weights = np.zeros(k + 1, np.int64)
        below = 1
        for i in range(k, -1, -1):
            weights[i] = below * int(h[i, k]) % p
            below = below * int(h[i, i - 1]) % p if i else 0
        used = (weights[:, None] * minors[: k + 1] % p).sum(axis=0)
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - used) % p
    return minors[size].tolist()


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - matrix), constant first, for a positive semidefinite integer
    matrix. The primes are shared out over tasks."""
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    # The coefficients' sizes add up to det(I + matrix), at most the mean of 1 + root, to the power.
    primes = primes_beyond(2 * -(-((size + trace) ** size) // size**size) + 1)
    texts = [[str(v) for v in row] for row in matrix]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(v) for v in row] for row in texts], object)
        for batch in batches:
            mine = [primes[i] for i in batch.column(0).to_pylist()]
            found = [characteristic_modulo((whole % p).astype(np.int64), p) for p in mine]
            columns = [pa.array(mine, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["p", "coefficients"])

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(work, "p long, coefficients array<long>").collect()
    product, lifted = 1, [0] * (size + 1)
    for p, coefficients in rows:
        inverse = pow(product, -1, p)
        lifted = [c + product * ((r - c) * inverse % p) for c, r in zip(lifted, coefficients)]
        product *= p
    return [c - product if 2 * c > product else c for c in lifted]


def roots_above(polynomial: list[int], point: int) -> int:
    """How many roots are above ``point``, by multiplicity. Needs real roots only, for which
    the sign changes of the Taylor coefficients count them exactly."""
    shifted = list(polynomial)
    for first in range(len(shifted) - 1):
        for k in range(len(shifted) - 2, first - 1, -1):
            shifted[k] += point * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(polynomial: list[int], point: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * point + c
    return total


def largest_roots(polynomial: list[int], most: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """The positive roots from the largest, ``(root, multiplicity)``, at least ``most`` of them by
    multiplicity if there are as many, as whole numbers of 2^-bits, each the floor or next to it.

    The polynomial must be that of a positive semidefinite matrix. Roots that agree in all
    those places count as one.
    """
    while polynomial and not polynomial[0]:
        polynomial = polynomial[1:]  # roots of zero
    degree = len(polynomial) - 1
    if degree < 1:
        return []
    scaled = [c << bits * (degree - k) for k, c in enumerate(polynomial)]
    high = (-polynomial[-2] + 1) << bits  # beyond the sum of the roots
    found: list[tuple[int, int]] = []
    # Parts (low, high] with the number of roots above their ends, the highest on top.
    parts = [(0, high, degree, 0)]
    while parts and sum(n for _, n in found) < most:
        low, high, above_low, above_high = parts.pop()
        n = above_low - above_high
        if not n:
            continue
        if high - low == 1:
            found.append((low, n))
        elif n == 1:
            below = _value(scaled, low) > 0 if _value(scaled, low) else not _value(scaled, high) > 0
            while high - low > 1:
                middle = (low + high) // 2
                value = _value(scaled, middle)
                if not value:
                    low, high = middle, middle + 1
                elif (value > 0) == below:
                    low = middle
                else:
                    high = middle
            found.append((low, 1))
        else:
            middle = (low + high) // 2
            above = roots_above(scaled, middle)
            parts += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def null_vectors(
    matrix: list[list[int]], root: int, n: int, root_bits: int = ROOT_BITS, bits: int = WORK_BITS
) -> list[list[float]]:
    """``n`` orthonormal vectors that ``matrix`` less the root sends to zero, by inverse
    iteration on one elimination, in numbers of ``bits`` binary places."""
    size = len(matrix)
    lu = np.array([[v << bits for v in row] for row in matrix], object)
    for i in range(size):
        lu[i, i] -= root << (bits - root_bits)
    order = list(range(size))
    for k in range(size):
        top = max(range(k, size), key=lambda i: abs(lu[i, k]))
        if top != k:
            lu[[top, k]] = lu[[k, top]]
            order[top], order[k] = order[k], order[top]
        if not lu[k, k]:
            lu[k, k] = 1
        times = (lu[k + 1 :, k] << bits) // lu[k, k]
        lu[k + 1 :, k + 1 :] -= (times[:, None] * lu[k, k + 1 :]) >> bits
        lu[k + 1 :, k] = times

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for k in range(size):
            x[k + 1 :] -= (lu[k + 1 :, k] * x[k]) >> bits
        for k in range(size - 1, -1, -1):
            x[k] = (x[k] << bits) // lu[k, k]
            x[:k] -= (lu[:k, k] * x[k]) >> bits
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        return (x << bits) // max(isqrt(int((x * x).sum())), 1)

    found: list[np.ndarray] = []
    for start in range(n):
        rng = np.random.default_rng(start)
        x = np.array([int(v) << (bits - 16) for v in rng.integers(-(1 << 15), 1 << 15, size)], object)
        for _ in range(3):
            x = unit(solve(unit(x)))
            for _ in range(2):
                for other in found:
                    x = x - ((other * (int((x * other).sum()) >> bits)) >> bits)
                x = unit(x)
        if x[max(range(size), key=lambda i: abs(x[i]))] < 0:
            x = -x
        found.append(x)
    return [[int(v) / (1 << bits) for v in x] for x in found]


def fit_components(fit: DataFrame, components: int = COMPONENTS) -> dict:
    """Of the fit list ``y``: ``n``, ``sums``, ``trace`` (n squared times that of the covariance),
    the ``roots`` (likewise, as numbers and as parts of the trace) and their unit ``vectors``."""
    spark = fit.sparkSession
    width = fit.agg(F.max(F.size("y"))).first()[0] or 0
    n, sums, products = scatter_of(fit, width) if width else (0, [], [])
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    trace = sum(matrix[i][i] for i in range(width))
    model = {"n": n, "sums": sums, "trace": trace, "roots": [], "explained": [], "vectors": []}
    if not trace:
        return model
    roots = largest_roots(characteristic(spark, matrix), components)
    texts = [[str(v) for v in row] for row in matrix]
    tasks = [(str(root), number) for root, number in roots]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[int(v) for v in row] for row in texts]
        for batch in batches:
            for place in batch.column(0).to_pylist():
                root, number = tasks[place]
                found = null_vectors(whole, int(root), number)
                columns = [pa.array([place] * number, pa.int64()), pa.array(found, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["place", "v"])

    rows = spark.range(0, len(roots), 1, len(roots)).mapInArrow(work, "place long, v array<double>").collect()
    for place, vector in sorted(rows, key=lambda row: row[0])[:components]:
        root = roots[place][0]
        model["roots"].append(root / (1 << ROOT_BITS))
        model["explained"].append(root / (trace << ROOT_BITS))
        model["vectors"].append(list(vector))
    return model


def _project(y: np.ndarray, model: dict) -> tuple[list[int], np.ndarray]:
    """Each row's deviation, and its whitened components."""
    sums = np.array(model["sums"], object)
    most = max(int(np.abs(y).max(initial=0)), 1) * model["n"] + int(abs(sums).max(initial=0))
    if most * most * y.shape[1] < 1 << 62:
        away = y * model["n"] - sums.astype(np.int64)
    else:
        away = y.astype(object) * model["n"] - sums
    deviation = (away * away).sum(axis=1)
    basis = np.array(model["vectors"]).T / np.sqrt(model["roots"])
    return [int(v) for v in deviation], away.astype(float) @ basis


def identity_error(fit: DataFrame, model: dict) -> float:
    """The largest entry of the whitened fit list's covariance less the identity."""
    width, size = len(model["sums"]), len(model["roots"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + size, size))
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                _, white = _project(_matrix(batch.slice(first, 4096).column(0), width), model)
                total[0] += white.sum(axis=0)
                total[1:] += white.T @ white
        columns = [pa.array(range(total.size), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["k", "v"])

    rows = fit.select("y").mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v")).collect()
    total = np.array([v for _, v in sorted(rows)]).reshape(1 + size, size) / model["n"]
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(size)).max())


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each vector and component: ``id_col``, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``."""
    rows = quantised(vectors, id_col, vector_col)
    fit = stored(rows.select("y").distinct(), "fit")
    model = fit_components(fit, components)
    kind = type_of(rows, "id")
    fields = "id " + kind + ", component int, n long, deviation long, whitened double, explained double"
    size, width = len(model["roots"]), len(model["sums"])
    if not size:
        white = vectors.sparkSession.createDataFrame([], fields)
        return white.withColumn("identity_error", F.lit(0.0)).withColumnRenamed("id", id_col)
    error = identity_error(fit, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                deviation, white = _project(_matrix(part.column(1), width), model)
                if max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation is beyond a LONG")
                rows = np.repeat(np.arange(len(white)), size)
                columns = [
                    part.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(white))),
                    pa.array(np.full(len(rows), model["n"], np.int64)),
                    pa.array(np.array(deviation, np.int64)[rows]),
                    pa.array(white.ravel()),
                    pa.array(np.tile(np.array(model["explained"]), len(white))),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["id", "component", "n", "deviation", "whitened", "explained"]
                )

    return (
        rows.mapInArrow(project, fields)
        .withColumn("identity_error", F.lit(error))
        .withColumnRenamed("id", id_col)
    )
