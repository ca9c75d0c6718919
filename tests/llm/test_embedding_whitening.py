import math
import random
from fractions import Fraction

import numpy as np
import pytest
from odd_rows import with_clashes

from receivables.llm import embedding_whitening as W
from receivables.llm import queries

FIELDS = "vec_id long, embedding array<double>"


def frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, FIELDS)).repartition(3)


def expanded(matrix):
    """det(x I - matrix) by the recursion on traces, in fractions; constant first."""
    size = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    coefficients, m = [Fraction(1)], [[Fraction(0)] * size for _ in range(size)]
    for k in range(1, size + 1):
        m = [
            [sum(a[i][x] * m[x][j] for x in range(size)) + (coefficients[-1] if i == j else 0) for j in range(size)]
            for i in range(size)
        ]
        am = sum(a[i][x] * m[x][i] for i in range(size) for x in range(size))
        coefficients.append(-am / k)
    return [int(c) for c in reversed(coefficients)]


def scatter(rng, size, rank, spread=50):
    rows = rng.integers(-spread, spread, (rank, size))
    return [[int(v) for v in row] for row in rows.T @ rows]


@pytest.mark.parametrize("size, rank", [(1, 1), (2, 5), (5, 3), (8, 20), (9, 0)])
def test_characteristic_polynomial(spark, size, rank):
    matrix = scatter(np.random.default_rng(size), size, rank)
    assert W.characteristic(spark, matrix) == expanded(matrix)


def test_hessenberg_form_with_zeros_to_swap():
    matrix = np.array([[1, 0, 3, 0], [0, 2, 0, 5], [3, 0, 1, 0], [0, 5, 0, 7]])
    p = W.primes_beyond(10**12)[0]
    assert W.characteristic_modulo(matrix, p) == [c % p for c in expanded(matrix.tolist())]


def test_primes():
    small = [p for p in range(9, 2000, 2) if W._is_prime(p)]
    assert small == [p for p in range(9, 2000, 2) if all(p % d for d in range(3, math.isqrt(p) + 1))]
    assert W.primes_beyond(1 << 100)[0] == 2147483647


def test_roots_with_multiplicities():
    def product(roots):
        out = [1]
        for root in roots:
            out = [(out[k - 1] if k else 0) - root * (out[k] if k < len(out) else 0) for k in range(len(out) + 1)]
        return out

    roots = [0, 0, 1, 3, 3, 3, 4, 10**9, 10**9 + 1]
    assert W.roots_above(product(roots), 3) == 3 and W.roots_above(product(roots), 2) == 6
    found = W.largest_roots(product(roots), 9)
    assert [n for _, n in found] == [1, 1, 1, 3, 1]
    expected = [10**9 + 1, 10**9, 4, 3, 1]
    assert [r / (1 << W.ROOT_BITS) for r, _ in found] == pytest.approx(expected, rel=1e-15)
    assert sum(n for _, n in W.largest_roots(product(roots), 2)) == 2
    assert W.largest_roots(product([0, 0]), 3) == []


def test_components_of_equal_roots_are_orthonormal():
    matrix = [[4, 0, 0, 1], [0, 5, 0, 0], [0, 0, 5, 0], [1, 0, 0, 4]]  # roots 5, 5, 5, 3
    basis = np.array(W.null_vectors(matrix, 5 << W.ROOT_BITS, 3))
    assert basis @ basis.T == pytest.approx(np.eye(3), abs=1e-15)
    assert np.array(matrix) @ basis.T == pytest.approx(5 * basis.T, abs=1e-14)


def check(out, rows):
    """The result against numpy and exact sums."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    fit = [list(t) for t in sorted(set(map(tuple, x)))]
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    covariance = centred.T @ centred / n
    roots = np.linalg.eigvalsh(covariance)[::-1]
    size = int(min(16, (roots > 1e-9 * roots[0]).sum()))
    deviations = sorted(sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x)
    assert len(out) == size * len(kept)
    assert sorted(r.deviation for r in out if r.component == 1) == deviations
    assert {r.n for r in out} == {n}
    for k in range(1, size + 1):
        mine = [r for r in out if r.component == k]
        assert {r.explained for r in mine} == {mine[0].explained}
        assert mine[0].explained == pytest.approx(roots[k - 1] / roots.sum(), rel=1e-9)
    assert {r.identity_error for r in out}.pop() < 1e-9
    # Whitened values follow from one set of components: their products are those of the
    # projection on the leading space, where that is the same for all choices of components.
    if size == 16 and len(roots) > 16 and roots[15] - roots[16] < 1e-6 * roots[0]:
        return
    vectors = np.linalg.eigh(covariance)[1][:, ::-1][:, :size]
    by_row = {}
    for r in out:
        by_row.setdefault(r.vec_id, {})[r.component] = r.whitened
    for (i, _), row in zip(kept, x):
        if sum(j == i for j, _ in kept) > 1:
            continue
        away = np.array([float(n * a - s) / n for a, s in zip(row, sums)])
        expected = ((away @ vectors) ** 2 / roots[:size]).sum()
        assert sum(v * v for v in by_row[i].values()) == pytest.approx(expected, rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("seed, width, scale", [(1, 4, 0.5), (2, 20, 0.1), (3, 18, 1000.0)])
def test_random_vectors(spark, seed, width, scale):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) * (1 + d) for d in range(width)]) for i in range(120)]
    rows += [(1000 + i, list(rows[i][1])) for i in range(60)]  # copies count once
    check(W.whiten(frame(spark, rows)).collect(), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.25, 1.0]),
        (2, [0.5]),
        (3, None),
        (4, []),
        (5, [nan, 1.0, 1.0]),
        (6, [inf, 1.0, 1.0]),
        (7, [None, 1.0, 1.0]),
        (None, [0.1, 0.2, -3.0]),
        (8, [0.5, 0.25, 1.0]),
        (1, [0.5, 0.25, 1.0]),
    ]
    out = W.whiten(frame(spark, rows)).collect()
    check(out, rows)
    assert {r.vec_id for r in out} == {1, 2, 8, None}
    assert {r.component for r in out} == {1, 2}  # three distinct points span a plane
    fields = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for few in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        white = W.whiten(frame(spark, few))
        assert white.columns == fields and white.count() == 0
    with pytest.raises(Exception, match="or more"):
        W.whiten(frame(spark, [(1, [1e300]), (2, [1.0])])).collect()


def test_large_whole_numbers_are_exact(spark):
    rows = [(1, [1e7, 1.0]), (2, [-5e6, 5e6]), (3, [7e6, -9e5])]
    check(W.whiten(frame(spark, rows)).collect(), rows)
    with pytest.raises(Exception, match="beyond a LONG"):
        W.whiten(frame(spark, [(1, [1e9, 1.0]), (2, [-1e9, 5.0])])).collect()


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = queries.op13_embedding_whitening(spark, sf_dir).collect()
    check(out, rows)
