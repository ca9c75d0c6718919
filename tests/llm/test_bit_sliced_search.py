import math
import random

import numpy as np
import pytest
from odd_rows import with_clashes

from receivables.llm import bit_sliced_search as B


def by_hand(rows, k, is_query):
    q = []
    for i, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            q.append((i, vec_id, [math.floor(256 * float(x)) for x in v]))
    found = []
    for i, vec_id, a in q:
        if is_query(vec_id):
            scored = sorted(
                (-sum(x * y for x, y in zip(a, b)), other, j) for j, other, b in q if j != i
            )
            found += [(vec_id, rank, o, -s) for rank, (s, o, _) in enumerate(scored[:k], 1)]
    return sorted(found)


def frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def search(spark, rows, **options):
    return sorted(map(tuple, B.search_top_k(frame(spark, rows), **options).collect()))


@pytest.mark.parametrize("seed, scale", [(1, 0.3), (2, 0.01), (3, 40.0)])
def test_against_all_pairs(spark, seed, scale):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(7)]) for i in range(150)]
    rows += [(1000 + i, list(rows[i][1])) for i in range(40)]  # copies tie
    expected = by_hand(rows, 5, lambda i: i % 10 == 0)
    found = search(spark, rows, query="vec_id % 10 = 0", block=40, chunk=4)
    assert found == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5]),
        (50, [0.5]),
        (100, None),
        (150, []),
        (200, [nan, 1.0]),
        (250, [1.0, inf]),
        (300, [None, 1.0]),
        (None, [1.0, 1.0]),
        (1, [-1.0, -1.0]),
        (2, [0.0, 0.0]),
        (3, [1.0, 1.0, 9.0]),
        (0, [0.5, 0.5]),
    ]
    assert search(spark, rows, block=3, chunk=1) == by_hand(rows, 5, lambda i: i % 50 == 0)
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, []) == []
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == []  # no query
    assert search(spark, [(0, [1.0]), (2, [0.5])]) == [(0, 1, 2, 256 * 128)]


def test_all_the_same(spark):
    rows = [(i, [0.25, -0.5]) for i in range(30)]
    assert search(spark, rows, query="vec_id = 7", block=8) == by_hand(rows, 5, lambda i: i == 7)


def test_sums_of_slices_are_exact():
    rng = np.random.default_rng(4)
    for _ in range(20):
        values = rng.integers(-300, 300, (130, 6))
        weights = [int(x) for x in rng.integers(-90, 90, 6)]
        constant, sums = B.add_slices(weights, [B.slices_of(values[:, d]) for d in range(6)])
        found = B.values_at(constant, sums, np.arange(130))
        assert (found == values @ np.array(weights)).all()
        allowed = np.packbits(np.ones(130, np.uint8), bitorder="little")
        allowed = np.pad(allowed, (0, 24 - len(allowed))).view(np.uint64)
        best = B.top_rows(sums, allowed, 5)
        boundary = sorted(found)[-5]
        assert set(best) == set(np.flatnonzero(found >= boundary))


def test_scores_beyond_a_long_are_refused(spark):
    for far in (1e9, 1e30):
        with pytest.raises(Exception, match="beyond a LONG|or more in row 50"):
            search(spark, [(50, [far, 1.0]), (1, [far, 1.0])])
    rows = [(0, [3e6, 1.0]), (1, [-3e6, 5.0]), (2, [3e6, 1.5])]
    assert search(spark, rows) == by_hand(rows, 5, lambda i: i % 50 == 0)
