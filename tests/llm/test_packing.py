import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import DOCUMENTS, documents, no_documents
from tokenizers import Tokenizer

from receivables.llm import packing as P
from receivables.llm import queries

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
IDS = P.Ids(P.vocabulary_files())


def wanted_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def test_ids_of_every_character():
    for start in range(0, 0x3000, 7):
        text = "a" + " ".join(f"b{chr(c)}c {chr(c)}{chr(c)}9" for c in range(start, start + 7))
        assert IDS(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts():
    rng = random.Random(3)
    letters = "abc  \n\t'sstll1239.,!é \u0085​日\U0001f600ÀßǅA<|endoftext|>"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert IDS(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u00a0"])
def test_ids_of_very_long_runs_of_blanks(blank):
    for text in (blank * 1_200_000, "a b" + blank * 1_200_000 + "c d", blank * 999 + "x" + blank * 1001):
        assert IDS(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def check_plan(histogram, capacity):
    plans = P.plan(dict(histogram), capacity)
    placed = Counter()
    for times, lengths in plans:
        assert times > 0 and sum(lengths) <= capacity
        for n in lengths:
            placed[n] += times
    assert placed == Counter({n: c for n, c in histogram.items() if c})
    return sum(times for times, _ in plans)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=30))
def test_plans_hold_every_piece_once(histogram):
    check_plan(histogram, 64)


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 5000), max_size=25))
def test_plans_of_real_capacity(histogram):
    check_plan(histogram, 2048)


def test_plans_waste_little():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6, 1, 60_000).astype(int), 1, 2048)
    histogram = Counter(lengths.tolist())
    sequences = check_plan(histogram, 2048)
    assert lengths.sum() / (2048 * sequences) > 0.99


def test_plan_with_a_hot_length():
    histogram = Counter({700: 300_000, **{n: 400 for n in range(10, 1300, 7)}})
    # No sequence holds more than two pieces of over a third of it, whole as they are.
    long = sum(c for n, c in histogram.items() if n > 2048 / 3)
    assert check_plan(histogram, 2048) <= 1.03 * long / 2


def test_pieces_are_cut_where_whole_ones_leave_much_empty():
    for histogram in ({n: 50 for n in range(1, 1000)}, {}, {7: 3}):
        assert P.cuts_and_plan(histogram) == (frozenset(), P.plan(histogram))
    hot = {1100: 30_000, **{n: 100 for n in range(1000, 1400)}}
    cut, plans = P.cuts_and_plan(hot)
    assert 1100 in cut
    parts = Counter()
    for n, count in hot.items():
        for part in P.powers_of_two(n) if n in cut else [n]:
            parts[part] += count
    total = sum(n * c for n, c in hot.items())
    assert check_plan(hot, 2048) * 2048 > 1.5 * total
    assert check_plan(parts, 2048) * 2048 < 1.02 * total
    assert plans == P.plan(parts)


def test_packing_with_a_hot_length(spark):
    text = "word " * 1100
    rows = [(i, text) for i in range(60)] + [(100 + i, "some more words " * i) for i in range(9)]
    packed = P.pack(documents(spark, rows)).collect()
    assert check_packed(packed, dict(rows)) > 0.9
    assert max(Counter(row.doc_id for row in packed).values()) > 1


def test_linear_program_is_solved():
    sizes, demand = np.array([3, 5, 7]), np.array([30.0, 20.0, 10.0])
    _, used = P.fractional_patterns(sizes, demand, 15, gap=1e-9)
    # 5+5+5, 7+5+3 and 3 times five fill fifteen exactly, 7+5+3 being used ten times.
    assert used.sum() == pytest.approx((30 * 3 + 20 * 5 + 10 * 7) / 15)


def check_packed(rows, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append((row.offset, row.length))
    for doc_id, text in texts.items():
        ids, at = np.array(wanted_ids(text), "<u4"), 0
        for row in sorted(by_doc.pop(doc_id), key=lambda row: row.start):
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes())
            at += row.length
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(row.length for row in rows) / (2048 * max(len(by_sequence), 1))


def test_odd_rows(spark):
    unique = [row for row in DOCUMENTS if row[0] != 11]
    check_packed(P.pack(documents(spark, unique)).collect(), dict(unique))
    repeated = P.pack(documents(spark)).filter("doc_id = 11").collect()
    assert len(repeated) == 2 and len({row.ids_crc32 for row in repeated}) == 1
    assert P.pack(no_documents(spark)).count() == 0


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op1_packing(spark, sf_dir).collect()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert check_packed(rows, dict(map(tuple, texts))) > 0.98
