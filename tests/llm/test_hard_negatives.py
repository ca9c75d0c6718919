import math
import random

import duckdb
import numpy as np
import pytest
from odd_rows import tuples, with_clashes

from receivables.llm import hard_negatives as H
from receivables.llm import queries

FIELDS = "vec_id long, embedding array<double>, label int"


def by_hand(rows, is_anchor, k=5):
    q = []
    for i, (vec_id, v, label) in enumerate(rows):
        if None not in (vec_id, label) and v and all(x is not None and math.isfinite(x) for x in v):
            q.append((i, vec_id, label, [math.floor(256 * float(x)) for x in v]))
    found = []
    for i, vec_id, label, a in q:
        if not is_anchor(vec_id):
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b)), other, j, kind) for j, other, kind, b in q if j != i
        )
        for minus, positive, _, _ in [s for s in scored if s[3] == label][:k]:
            p = -minus
            fits = [(o, -s) for s, o, _, kind in scored if kind != label and 80 * p <= -100 * s <= 100 * p]
            found += [(vec_id, positive, r, o, p, s) for r, (o, s) in enumerate(fits[:k], 1)]
    return sorted(found, key=repr)


def frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, FIELDS)).repartition(3)


@pytest.mark.parametrize("seed, scale, centres", [(1, 0.3, 4), (2, 0.02, 16), (3, 40.0, 1)])
def test_against_all_pairs(spark, seed, scale, centres):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, scale) for _ in range(7)] for _ in range(6)]
    rows = []
    for i in range(240):
        m = rng.choice(middles)
        rows.append((i, [x + rng.gauss(0, scale / 2) for x in m], rng.randrange(3)))
    rows += [(1000 + i, list(rows[i][1]), rng.randrange(3)) for i in range(40)]  # copies tie
    found = H.mine_hard_negatives(
        frame(spark, rows), anchor="vec_id % 10 = 0", centres=centres, sample=100, block=50, chunk=7
    )
    expected = by_hand(rows, lambda i: i % 10 == 0)
    assert tuples(found) == expected and len(expected) > 200


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1),
        (100, [0.5], 1),
        (200, None, 1),
        (300, [], 1),
        (400, [nan, 1.0], 1),
        (500, [1.0, inf], 2),
        (600, [None, 1.0], 2),
        (700, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1),
        (1, [0.5, 0.5], 1),
        (2, [0.5, 0.45], 2),
        (3, [0.25, 0.6, 9.0], 2),
        (4, [-0.5, -0.5], 3),
        (0, [0.5, 0.5], 1),
        (800, [-1.0, 0.1], 7),  # without a positive
        (900, [-1.0, 0.0], 4),  # with a negative score alone
        (5, [1.0, 0.5], 4),
    ]
    expected = by_hand(rows, lambda i: i % 100 == 0)
    assert expected
    for block in (3, 100):
        assert tuples(H.mine_hard_negatives(frame(spark, rows), block=block)) == expected
    assert H.mine_hard_negatives(frame(spark, [])).count() == 0
    assert H.mine_hard_negatives(frame(spark, [(0, [1.0], 1)])).count() == 0
    assert H.mine_hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0


def test_all_the_same(spark):
    rows = [(i, [0.25, -0.5], i % 2) for i in range(40)]
    found = H.mine_hard_negatives(frame(spark, rows), anchor="vec_id = 7", block=8)
    assert tuples(found) == by_hand(rows, lambda i: i == 7)


def test_large_scores_are_exact_or_refused(spark):
    rows = [(0, [2e6, 1.0], 1), (1, [2e6, 3.0], 1), (2, [1.9e6, 5.0], 2), (3, [1.9e6, 4.0], 2)]
    assert tuples(H.mine_hard_negatives(frame(spark, rows))) == by_hand(rows, lambda i: i == 0)
    for far in (1e11, 1e13):  # the scores, and the components themselves
        with pytest.raises(Exception, match="beyond a LONG|or more"):
            H.mine_hard_negatives(frame(spark, [(0, [far], 1), (1, [far], 1), (2, [far], 2)])).collect()


def test_cells_come_by_falling_bound_and_hold_it():
    rng = np.random.default_rng(6)
    values = rng.integers(-200, 200, (400, 8))
    books = [H.centres_of(values[:, :4], 5), H.centres_of(values[:, 4:], 5)]
    codes = [H.nearest(values[:, :4].astype(float), books[0]), H.nearest(values[:, 4:].astype(float), books[1])]
    cell = codes[0] * len(books[1]) + codes[1]
    order = np.argsort(cell, kind="stable")
    radii = []
    for half, book, code in zip((values[:, :4], values[:, 4:]), books, codes):
        radius = np.full(len(book), -1.0)
        np.maximum.at(radius, code, np.sqrt(((half - book[code]) ** 2).sum(axis=1)))
        radii.append(radius)
    packed = {
        "ids": np.arange(400)[order].tobytes(), "numbers": order.tobytes(), "labels": order.tobytes(),
        "bits": 64, "vectors": values[order].tobytes(),
        "starts": np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1)).tobytes(),
        "radii": np.concatenate(radii).tobytes(),
    }
    cells, at_once, H.AT_ONCE = H.Cells(packed, books, 8), H.AT_ONCE, 20
    try:
        for anchor in rng.integers(-200, 200, (10, 8)):
            visited, before = [], float("inf")
            for rows, bound in cells.walk(anchor):
                scores = cells.scores(anchor, rows)
                assert (scores == values[order][rows] @ anchor).all()
                assert scores.max() <= before and bound <= before
                visited, before = [*visited, *rows], bound
            assert sorted(visited) == list(range(400))
    finally:
        H.AT_ONCE = at_once


def test_whole_table_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = connection.execute(queries.oracle_sql()["op12_hard_negatives"]).fetchall()
    assert tuples(queries.op12_hard_negatives(spark, sf_dir)) == sorted(expected, key=repr)
