import random
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from odd_rows import DOCUMENTS, documents, no_documents, tuples

from receivables.llm import ngram_join as J
from receivables.llm import queries


def set_of(text):
    words = (text or "").encode().lower().split()
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def by_hand(rows):
    """(id, size, least id reachable) with every pair compared."""
    sets, lead = [set_of(text) for _, text in rows], list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 90 * len(sets[i] | sets[j]):
            lead[find(j)] = find(i)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)] += [] if doc_id is None else [doc_id]
    return sorted(
        ((doc_id, len(sets[i]), min(ids[find(i)], default=None)) for i, (doc_id, _) in enumerate(rows)), key=repr
    )


def texts(seed, sizes, variants):
    """Texts of many sizes, each with variants of which some link and some do not."""
    rng = random.Random(seed)
    found = []
    for size in sizes:
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        found.append(" ".join(words))
        for _ in range(variants):
            other = list(words)
            for _ in range(rng.randint(0, max(1, size // 25))):
                kind, at = rng.randrange(3), rng.randrange(len(other))
                if kind == 0:
                    other[at] = f"v{rng.randrange(9)}"
                elif kind == 1 and len(other) > 1:
                    del other[at]
                else:
                    other.insert(at, "und")
            found.append(" ".join(other).upper() if rng.random() < 0.2 else " ".join(other))
    rng.shuffle(found)
    return list(enumerate(found))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("most_light, tile", [(None, 4096), (0, 4096), (J.LIGHT, 4096), (12, 3)])
def test_against_all_pairs(spark, most_light, tile):
    sizes = [*range(1, 45), 60, 75, 90, 120, 200]
    rows = texts(1, sizes, 6)
    rows += [(1000 + i, "common passage of ten words that all of these share " + text) for i, text in rows[:80]]
    found = J.similar_documents(frame(spark, rows), most_light=most_light, tile=tile)
    expected = by_hand(rows)
    assert tuples(found) == expected
    assert sum(i != least for i, _, least in expected) > 50


def test_large_group_of_near_copies(spark):
    """Copies of one text with a word changed each: linked by way of the text itself."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words))]
    for i in range(1, 300):
        other = list(words)
        other[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(other)))
    found = tuples(J.similar_documents(frame(spark, rows), tile=64))
    assert found == by_hand(rows)
    assert all(least == 0 for _, _, least in found)


def test_odd_rows(spark):
    found = tuples(J.similar_documents(documents(spark)))
    assert found == [row if row[1] else (row[0], 0, row[0]) for row in by_hand(DOCUMENTS)]
    assert J.similar_documents(no_documents(spark)).count() == 0


def test_sizes_of_what_must_be_shared():
    for n in range(1, 60):
        for m in range(1, 60):
            linked = [i for i in range(1, min(n, m) + 1) if 100 * i >= 90 * (n + m - i)]
            need = J.needed_overlap(n, m)
            assert linked == list(range(need, min(n, m) + 1))
            if linked:
                assert need in J.subset_sizes(n, 60)
                assert n - need < J.prefix_length(n) and m - need < J.prefix_length(m)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        one = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        other = np.unique(np.concatenate([one[rng.random(len(one)) < 0.9], one[:40] + np.uint64(1)]))
        bits = [np.frombuffer(J.parity(h), np.uint8) for h in (one, other)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(one, other))


def test_whole_table_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = connection.execute(queries.oracle_sql()["op11_ngram_jaccard_join"]).fetchall()
    assert tuples(queries.op11_ngram_jaccard_join(spark, sf_dir)) == sorted(expected, key=repr)
