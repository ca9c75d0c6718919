"""Packing of tokenised documents into sequences, by cutting stock.

A document's ids, ended by ``END_ID``, are cut into pieces of the capacity; the last
piece is what is left. It is cut further only where whole pieces would leave more than
``MOST_PADDING`` of the sequences empty, say because a third of all pieces are a little
longer than half a sequence: then pieces of the lengths that leave most are cut into
powers of two, which fit without loss. The histogram of piece lengths, at most one entry per length, is
all the driver sees. A linear program over patterns (how many pieces of each length share
a sequence) is solved by column generation: a knapsack by dynamic programming prices the
next pattern under the current duals, until no pattern can improve the bound by more than
``GAP``. Pattern counts are rounded down and the rest is packed best fit, decreasing.
Each piece has a rank among the pieces of its length; the plan gives the place of every
rank, so pieces find their sequences without being gathered.

For the linear program lengths are grouped into classes about ``1 / FINENESS`` of a length
wide, each standing for its longest; sequences are filled with the exact lengths.

Results by case: a NULL text counts as empty and becomes the end id alone; copies and
repeated rows are packed like any other row; an empty table gives an empty one; further
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.llm.common import map_rows, per_worker, share, stored, type_of

CAPACITY = 2048
END_ID = 1
UNIT = 4
FINENESS = 128
GAP = 1e-3
MOST_PADDING = 0.01

# Both libraries read these characters alike and agree on every text of them; others go
# to the slower one, whose ids are the ones wanted. So do texts with long runs of blanks, on
# which the faster one gives up.
OTHER = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>|\\s{1000}")


class Ids:
    """Token ids of texts, as ``tokenizers`` gives them for the vocabulary ``files[0]``.

    The same vocabulary as ranks, ``files[1]``, is several times faster to apply.
    """

    def __init__(self, files: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(files[0])
        with open(files[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def __call__(self, text: str) -> list[int]:
        if OTHER.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return (
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


def powers_of_two(n: int) -> list[int]:
    """Powers of two that add up to ``n``, the largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: tuple[str, str] | None = None,
    capacity: int = CAPACITY,
    cut: frozenset[int] = frozenset(),
) -> DataFrame:
    """A row for each piece: where it starts in its document, its length and checksum.

    Pieces of the lengths in ``cut`` are cut into powers of two. ``task`` and ``nth`` number
    the pieces of one length within the task that cut them.
    """
    shared = share(docs.sparkSession, files or vocabulary_files())

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        ids_of = per_worker(shared, Ids)
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[id_col], batch[text_col]):
                ids = np.array([*ids_of(text or ""), END_ID], "<u4")
                rest = len(ids) % capacity
                lengths = [capacity] * (len(ids) // capacity)
                lengths += powers_of_two(rest) if rest in cut else [rest] * bool(rest)
                start = 0
                for n in lengths:
                    crc = zlib.crc32(ids[start : start + n])
                    rows.append((doc_id, start, n, crc, len(ids), task, seen[n]))
                    seen[n] += 1
                    start += n
            yield list(zip(*rows)) if rows else [[]] * 7

    return map_rows(
        docs.select(id_col, text_col),
        f"`{id_col}` {type_of(docs, id_col)}, start long, length long, ids_crc32 long, "
        "doc_tokens long, task int, nth long",
        work,
    )


def _knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits ``room``, any number of each size."""
    order = np.argsort(sizes, kind="stable")
    rising, worth = sizes[order], values[order]
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(rising, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fitting[c]:
            with_one = best[c - rising[:k]] + worth[:k]
            i = with_one.argmax()
            if with_one[i] > best[c] + 1e-12:
                best[c], taken[c] = with_one[i], i
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[order[taken[c]]] += 1
            c -= rising[taken[c]]
    return best[room], pattern


def _first_patterns(
    sizes: np.ndarray, demand: np.ndarray, room: int
) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: each pattern in turn takes the longest size left, fills up with
    others, longer ones first, and is used until one of its sizes is exhausted."""
    left, open_ = demand.copy(), np.ones(len(sizes), bool)
    patterns, used = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    for _ in sizes:
        rest = np.flatnonzero(open_)
        pattern = np.zeros(len(sizes))
        fill = sizes[rest] * (1 + 1e-3 * sizes[rest] / room)
        pattern[rest] = _knapsack(sizes[rest], fill, room - sizes[rest[-1]])[1]
        pattern[rest[-1]] += 1
        times = np.full(len(sizes), np.inf)
        times[pattern > 0] = left[pattern > 0] / pattern[pattern > 0]
        out = times.argmin()
        patterns[out], used[out], open_[out] = pattern, times[out], False
        left = np.maximum(left - times[out] * pattern, 0)
    return patterns, used


def fractional_patterns(
    sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns as rows and how often to use each, by column generation.

    Revised simplex with an explicit inverse. Duals under which the best pattern is worth
    ``v`` prove that no plan needs fewer sequences than the demand is worth, divided by
    ``v``; the number used is at most ``1 + gap`` times the best such bound, the first being
    that of the plain lengths.
    """
    patterns, used = _first_patterns(sizes, demand, room)
    inverse = np.linalg.inv(patterns.T)
    bound = demand @ sizes / room
    for _ in range(40 * len(sizes)):  # degenerate pivots could go on for ever
        if used.sum() <= bound * (1 + gap):
            break
        duals = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = _knapsack(sizes, duals, room)
        bound = max(bound, duals @ demand / worth)
        change = inverse @ pattern
        usable = change > 1e-9
        if worth <= 1 + 1e-7 or not usable.any():
            break
        ratio = np.full(len(used), np.inf)
        ratio[usable] = used[usable] / change[usable]
        out = ratio.argmin()
        used = np.maximum(used - ratio[out] * change, 0)
        used[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        patterns[out] = pattern
    return patterns, used


def class_edges(capacity: int) -> np.ndarray:
    """The longest length of each class, in units."""
    edges, unit = [1], 1 if capacity < 512 else UNIT
    while edges[-1] * unit < capacity:
        edges.append(edges[-1] + max(1, edges[-1] // FINENESS))
    return np.minimum(np.array(edges), capacity // unit)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``(times, lengths)``: so many sequences hold pieces of these lengths in this order.

    Every piece of the histogram is in exactly one sequence. The work depends on the number
    of different lengths, not on the number of pieces.
    """
    full = histogram.get(capacity, 0)
    plans = [(full, [capacity])] if full else []
    lengths = {n: count for n, count in histogram.items() if n != capacity and count}
    if not lengths:
        return plans
    unit = 1 if capacity < 512 else UNIT
    edges = class_edges(capacity)
    runs: dict[int, list[list[int]]] = defaultdict(list)  # class -> [length, how many left]
    for n in sorted(lengths, reverse=True):
        if n <= capacity // unit * unit:
            runs[int(edges[np.searchsorted(edges, -(-n // unit))])].append([n, lengths[n]])
    whole = {n: lengths[n] for n in lengths if n > capacity // unit * unit}  # fit no class
    if not runs:
        return _best_fit(plans, whole, capacity)
    sizes = np.array(sorted(runs))
    demand = np.array([sum(count for _, count in runs[s]) for s in sizes], float)
    patterns, used = fractional_patterns(sizes, demand, capacity // unit)
    for pattern, times in zip(patterns, np.floor(used + 1e-9).astype(int)):
        slots = [s for s, n in zip(sizes, pattern.astype(int)) for _ in range(n)]
        while times > 0 and slots:
            # As far as no slot's run of equal lengths ends, all sequences are the same.
            of_class = {s: runs[s] for s in slots}
            need = {s: slots.count(s) for s in of_class}
            if any(sum(count for _, count in of_class[s]) < need[s] for s in of_class):
                break  # rounding: a class has run out
            step, taken = times, []
            for s, n in need.items():
                at = 0
                for _ in range(n):
                    while sum(1 for c, k, _ in taken if (c, k) == (s, at)) >= of_class[s][at][1]:
                        at += 1
                    taken.append((s, at, of_class[s][at][0]))
            for s, at, _ in set(taken):
                shares = sum(1 for c, k, _ in taken if (c, k) == (s, at))
                step = min(step, of_class[s][at][1] // shares)
            for s, at, _ in taken:
                of_class[s][at][1] -= step
            for s in of_class:
                runs[s] = [run for run in runs[s] if run[1]]
            plans.append((step, sorted((n for _, _, n in taken), reverse=True)))
            times -= step
    left = whole | {n: count for run in runs.values() for n, count in run}
    return _best_fit(plans, left, capacity)


def _best_fit(
    plans: list[tuple[int, list[int]]], left: dict[int, int], capacity: int
) -> list[tuple[int, list[int]]]:
    """Puts what is left where it leaves least room, longest first."""
    times = [n for n, _ in plans]
    content = [lengths for _, lengths in plans]
    filled = [sum(lengths) for lengths in content]
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            room = np.array(filled)
            room = np.where((room + n <= capacity) & (np.array(times) > 0), room, -1) if filled else room
            at = int(room.argmax()) if len(room) and room.max() >= 0 else -1
            if at < 0:
                fit = capacity // n
                step, rest = divmod(count, fit)
                for m, k in ((step, fit), (1, rest)):
                    if m and k:
                        times.append(m)
                        content.append([n] * k)
                        filled.append(n * k)
                break
            step = min(times[at], count)
            times[at] -= step
            times.append(step)
            content.append([*content[at], n])
            filled.append(filled[at] + n)
            count -= step
    return [(m, lengths) for m, lengths in zip(times, content) if m]


def _padding(plans: list[tuple[int, list[int]]], capacity: int) -> int:
    """Empty places, but for those of one sequence, which may just be the last."""
    return max(0, sum(times * (capacity - sum(n)) for times, n in plans) - capacity)


def cuts_and_plan(
    histogram: dict[int, int], capacity: int = CAPACITY
) -> tuple[frozenset[int], list[tuple[int, list[int]]]]:
    """Lengths whose pieces to cut so that little is left empty, none if whole pieces do,
    and the plan for what there is then."""
    total = sum(n * count for n, count in histogram.items())
    cut: frozenset[int] = frozenset()
    plans = plan(histogram, capacity)
    while _padding(plans, capacity) > MOST_PADDING * total:
        waste: dict[int, int] = defaultdict(int)
        for times, lengths in plans:
            waste[max(lengths)] += times * (capacity - sum(lengths))
        # The fewest lengths that account for half of what is empty.
        worst, share = [], 0
        for n in sorted(waste, key=lambda n: (-waste[n], n)):
            if 2 * share >= sum(waste.values()):
                break
            if n not in cut and n < capacity:
                worst.append(n)
            share += waste[n]
        if not worst:
            break
        trial = cut | frozenset(worst)
        parts: dict[int, int] = defaultdict(int)
        for n, count in histogram.items():
            for part in powers_of_two(n) if n in trial else [n]:
                parts[part] += count
        better = plan(parts, capacity)
        if _padding(better, capacity) > 0.95 * _padding(plans, capacity):
            break
        cut, plans = trial, better
    return cut, plans


class Places:
    """Sequence and offset of the piece of each length and rank."""

    def __init__(self, plans: list[tuple[int, list[int]]]):
        slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        first = 0
        for times, lengths in plans:
            offset = 0
            for n in lengths:
                slots[n].append((times, first, offset))
                offset += n
            first += times
        self.by_length = {}
        for n, found in slots.items():
            times, base, offset = np.array(found, np.int64).T
            self.by_length[n] = (np.cumsum(times), times, base, offset)

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            ends, times, base, offsets = self.by_length[n]
            slot = np.searchsorted(ends, ranks[rows], side="right")
            sequence[rows] = base[slot] + ranks[rows] - (ends[slot] - times[slot])
            offset[rows] = offsets[slot]
        return sequence, offset


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: tuple[str, str] | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """A row for each piece with its ``sequence_id`` and its ``offset`` there."""
    cut = stored(pieces(docs, id_col, text_col, files, capacity), "pieces")
    counted = cut.groupBy("task", "length").count()
    # At most ``capacity`` rows; a few plans per length, whatever the number of pieces.
    histogram = dict(counted.groupBy("length").agg(F.sum("count")).collect())
    to_cut, plans = cuts_and_plan(histogram, capacity)
    if to_cut:
        cut = stored(pieces(docs, id_col, text_col, files, capacity, to_cut), "pieces")
        counted = cut.groupBy("task", "length").count()
    ranked = counted.withColumn(
        "before", F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")
    ).drop("count")  # a row for each task, not each piece
    shared = share(docs.sparkSession, plans)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    rows = cut.join(ranked, ["task", "length"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = per_worker(shared, Places)
        for batch in batches:
            at = places(batch.column(2).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *map(pa.array, at)], [*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{name}` {type_of(rows, name)}" for name in names)
    return rows.mapInArrow(place, f"{fields}, sequence_id long, offset long")
