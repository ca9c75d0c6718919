import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from odd_rows import DOCUMENTS, documents, no_documents
from pyspark.sql import functions as F

from receivables.llm import queries
from receivables.llm import simhash as S


def print_by_hand(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints, radius=4):
    """For each fingerprint the fingerprints reachable from it."""
    prints = sorted(set(prints))
    lead = {p: p for p in prints}

    def find(p):
        while lead[p] != p:
            p = lead[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                lead[find(b)] = find(a)
    groups = defaultdict(set)
    for p in prints:
        groups[find(p)].add(p)
    return {p: group for group in groups.values() for p in group}


def test_fingerprints_by_hand():
    texts = [text for _, text in DOCUMENTS if text is None or len(text) < 10_000]
    texts += ["ÄÖ A B C D E", "one two three", "x " * 4000, "a b c d a b c d a b c d"]
    for text in texts:
        assert S.fingerprint(text) == print_by_hand(text)


def near_prints(seed, n, spread):
    """Clouds of fingerprints around a few centres, a few bits from one to the next."""
    rng = random.Random(seed)
    found = [rng.getrandbits(64) for _ in range(10)]
    while len(found) < n:
        p = rng.choice(found)
        for _ in range(rng.randint(0, spread)):
            p ^= 1 << rng.randrange(64)
        found.append(p)
    return sorted(set(found))


@pytest.mark.parametrize("spread", [3, 7])
def test_tiles_connect_what_all_pairs_do(spread):
    prints = near_prints(spread, 150, spread)
    whole = groups_by_hand(prints)
    as_array = np.array(prints, np.uint64)
    for links in (
        S.links_within(as_array, 4),
        S.links_within(as_array[::2], 4)
        + S.links_within(as_array[1::2], 4)
        + S.links_across(as_array[::2], as_array[1::2], 4),
    ):
        assert all(b in whole[a] for a, b in links)
        assert len(links) < len(prints)  # a forest, not all pairs
        lead = {p: p for p in prints}

        def find(p):
            while lead[p] != p:
                p = lead[p]
            return p

        for a, b in links:
            lead[find(a)] = find(b)
        assert all((find(a) == find(b)) == (b in whole[a]) for a in prints for b in prints)


@pytest.mark.parametrize("tile", [5, 40, 4096])
def test_groups_of_fingerprints(spark, tile):
    prints = near_prints(1, 400, 5)
    distinct = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long")
    found = defaultdict(set)
    for row in S.connected(S.links(distinct, tile=tile)).collect():
        found[row.root].add(row.node % 2**64)
    expected = {frozenset(g) for g in groups_by_hand(prints).values() if len(g) > 1}
    assert {frozenset(g) for g in found.values()} == expected
    assert all(min(map(S._signed, g)) == root for root, g in found.items())


def test_long_chain_is_one_group(spark):
    """Each link is 4 bits from the next, the ends far apart."""
    chain = [((1 << (4 * i)) - 1) for i in range(17)]
    distinct = spark.createDataFrame([(S._signed(p),) for p in chain], "fp long")
    roots = S.connected(S.links(distinct)).select("root").distinct().collect()
    assert len(roots) == 1


def test_odd_rows(spark):
    rows = S.near_duplicate_groups(documents(spark), keep=("count",)).collect()
    assert len(rows) == len(DOCUMENTS)
    assert rows[0].__fields__ == ["doc_id", "count", "fingerprint", "component_id"]
    found = {row.doc_id: row for row in rows}
    assert {i for i, row in found.items() if row.fingerprint == "0" * 16} == {2, 3, 4}
    assert {found[i].component_id for i in (2, 3, 4)} == {2}
    assert found[7].component_id == found[1].component_id == 1
    assert found[11].component_id == 11
    assert found[None].component_id is None
    assert S.near_duplicate_groups(no_documents(spark)).count() == 0


def test_whole_table_against_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op3_simhash_near_dedup(spark, sf_dir).collect()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {row.doc_id: print_by_hand(row.text) for row in texts}
    assert {row.doc_id: int(row.fingerprint, 16) for row in rows} == prints
    groups, least = groups_by_hand(prints.values()), {}
    for doc_id, p in prints.items():
        for other in groups[p]:
            least[other] = min(least.get(other, doc_id), doc_id)
    assert {row.doc_id: row.component_id for row in rows} == {i: least[p] for i, p in prints.items()}
    assert any(row.component_id != row.doc_id for row in rows)


def test_no_two_documents_alike(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    assert all(r.component_id == r.doc_id for r in S.near_duplicate_groups(docs).collect())
