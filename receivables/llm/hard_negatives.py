"""Hard negatives by exact search over an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; the nearest centre in
either names a row's cell. Rows lie in blocks, each a small multi-index: its cells, and for
each centre the radius of the half vectors it holds there. For an anchor a, no row of a cell
scores more than the sum of two half bounds, each the inner product with the centre plus the
anchor's half length times the radius. With both halves' bounds sorted, a heap gives the
cells by falling sum (multi-sequence), rows of visited cells are scored exactly, and the walk
ends when what is wanted is certain: every window is full above the next cell's bound, or
that bound is below the window.

First the positives, the best rows of the anchor's own label; then, for each positive, the
best rows of other labels that score within a share of the positive's score. A block returns
no more rows for an anchor and window than are wanted in the end; the best of all blocks are
merged. Codebooks are fitted on at most ``SAMPLE`` rows; they bear on speed alone, as every
row is indexed and bounds hold for any centres.

Results by case: a row whose id, label or vector is NULL, whose vector is empty or holds a
NULL, NaN or infinite component takes no part; a shorter vector counts as ending in zeros;
ties go to the smaller id; a repeated row is another row than its copy, so each may be the
other's positive, and an anchor that occurs twice is mined twice; an anchor without
positives, or a positive with an empty window (as with a negative score), gives no rows; an
empty table gives an empty one; further columns are ignored. A component beyond ``MOST`` or
a score beyond a LONG is an error.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from receivables.llm.common import share, stored

SCALE = 256
MOST = float(1 << 40)
CENTRES = 16
SAMPLE = 20_000
BLOCK = 1 << 14
CHUNK = 1 << 13
#: Cells are gathered until they hold so many rows, which are then scored at once.
AT_ONCE = 512


def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``row`` (its own number), ``id``, ``label`` and ``q``, the whole-number components."""
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    far = F.exists("v", lambda x: F.abs(x) >= MOST)
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    return (
        vectors.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).cast("array<double>").alias("v"),
        )
        .filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        .filter(F.coalesce(finite, F.lit(False)))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "label",
            F.when(far, F.raise_error(F.lit(f"a component is {MOST} or more"))).otherwise(whole).alias("q"),
        )
    )


def _rows_of(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, ended with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, q in enumerate(column):
        out[i, : len(q)] = q
    return out


def centres_of(half: np.ndarray, most: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds, from rows spread over the sample; no two alike."""
    points = np.unique(half.astype(float), axis=0)
    if not len(points):
        return np.zeros((1, half.shape[1]))
    centres = points[np.linspace(0, len(points) - 1, min(most, len(points))).astype(int)]
    for _ in range(rounds):
        near = nearest(half, centres)
        for c in np.unique(near):
            centres[c] = half[near == c].mean(axis=0)
    return np.unique(centres, axis=0)


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (half @ centres.T), axis=1)


def codebooks(rows: DataFrame, n: int, width: int, centres: int, sample: int) -> list[np.ndarray]:
    """Two arrays of centres, from the ``sample`` rows with the smallest hashes."""
    spread = F.pmod(F.xxhash64("row", "id"), F.lit(max(n, 1)))
    near = rows.filter(spread <= 2 * sample) if n > 2 * sample else rows
    picked = near.orderBy(F.xxhash64("row", "id"), "row").limit(sample).select("q").toPandas()
    values = _rows_of(picked["q"], width)
    cut = (width + 1) // 2
    return [centres_of(values[:, :cut], centres), centres_of(values[:, cut:], centres)]


def build_index(rows: DataFrame, books: list[np.ndarray], width: int, blocks: int) -> DataFrame:
    """A row for each block: its rows in the order of their cells, as packed arrays; the first
    row of each cell, and the radius around each centre of either half."""
    shared = share(rows.sparkSession, books)
    cut = books[0].shape[1]

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = shared.value["model"]
        values = _rows_of(pdf["q"], width)
        halves = values[:, :cut].astype(float), values[:, cut:].astype(float)
        codes = [nearest(half, book) for half, book in zip(halves, (first, second))]
        radii = []
        for half, book, code in zip(halves, (first, second), codes):
            radius = np.full(len(book), -1.0)  # -1: nothing there
            away = np.sqrt(((half - book[code]) ** 2).sum(axis=1))
            np.maximum.at(radius, code, away)
            radii.append(radius)
        cell = codes[0] * len(second) + codes[1]
        order = np.argsort(cell, kind="stable")
        starts = np.searchsorted(cell[order], np.arange(len(first) * len(second) + 1))
        most = int(np.abs(values).max(initial=0))
        kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        packed = {
            "block": pdf["block"].iloc[0],
            "ids": pdf["id"].to_numpy(np.int64)[order].tobytes(),
            "numbers": pdf["row"].to_numpy(np.int64)[order].tobytes(),
            "labels": pdf["label"].to_numpy(np.int64)[order].tobytes(),
            "bits": 8 * kind().itemsize,
            "vectors": values[order].astype(kind).tobytes(),
            "starts": starts.astype(np.int64).tobytes(),
            "radii": np.concatenate(radii).tobytes(),
        }
        return pd.DataFrame([packed])

    blocked = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return blocked.groupBy("block").applyInPandas(
        index,
        "block int, ids binary, numbers binary, labels binary, bits int, vectors binary, "
        "starts binary, radii binary",
    )


class Cells:
    """A block of the index, unpacked."""

    def __init__(self, packed: pd.Series, books: list[np.ndarray], width: int):
        self.books = books
        self.ids = np.frombuffer(packed["ids"], np.int64)
        self.numbers = np.frombuffer(packed["numbers"], np.int64)
        self.labels = np.frombuffer(packed["labels"], np.int64)
        self.whole = np.frombuffer(packed["vectors"], f"i{packed['bits'] // 8}").reshape(-1, width)
        self.starts = np.frombuffer(packed["starts"], np.int64)
        radii = np.frombuffer(packed["radii"], np.float64)
        self.radii = radii[: len(books[0])], radii[len(books[0]) :]
        self.most = int(np.abs(self.whole.astype(np.int64)).max(initial=0))
        self.real = self.whole.astype(np.float64)

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products: as doubles where those hold them, else as whole numbers."""
        bound = self.most * max(int(np.abs(anchor).max(initial=0)), 1) * len(anchor)
        if bound < 1 << 53:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if bound < 1 << 63:
            return self.whole[rows].astype(np.int64) @ anchor
        sums = self.whole[rows].astype(object) @ anchor.astype(object)
        if any(not -(1 << 63) <= s < 1 << 63 for s in sums):
            raise OverflowError("a score is beyond a LONG")
        return sums.astype(np.int64)

    def bounds(self, anchor: np.ndarray) -> tuple[list, list]:
        """For either half the (bound, centre) of the centres in use, highest first."""
        cut = self.books[0].shape[1]
        found = []
        for part, book, radius in zip((anchor[:cut], anchor[cut:]), self.books, self.radii):
            part = part.astype(float)
            inner, length = book @ part, np.sqrt(part @ part)
            scale = np.sqrt((book**2).sum(axis=1)) * length
            # Rounding is far below this allowance.
            bound = inner + length * radius + 1e-9 * (1 + scale + length * radius)
            used = np.flatnonzero(radius >= 0)
            found.append(sorted(zip(bound[used].tolist(), used.tolist()), reverse=True))
        return found[0], found[1]

    def walk(self, anchor: np.ndarray):
        """Gives (rows, bound of all cells not visited yet), the cells by falling bound."""
        first, second = self.bounds(anchor)
        n, gathered, size = len(self.books[1]), [], 0
        heap = [(-(first[0][0] + second[0][0]), 0, 0)]
        while heap:
            _, i, j = heappop(heap)
            # Each cell is put in once: along the second list, and down the first at its head.
            if j + 1 < len(second):
                heappush(heap, (-(first[i][0] + second[j + 1][0]), i, j + 1))
            if not j and i + 1 < len(first):
                heappush(heap, (-(first[i + 1][0] + second[0][0]), i + 1, 0))
            cell = first[i][1] * n + second[j][1]
            low, high = self.starts[cell], self.starts[cell + 1]
            if high > low:
                gathered.append(np.arange(low, high))
                size += int(high - low)
            if gathered and (size >= AT_ONCE or not heap):
                yield np.concatenate(gathered), -heap[0][0] if heap else float("-inf")
                gathered, size = [], 0


def best_in_windows(
    cells: Cells, anchor: np.ndarray, usable: np.ndarray, windows: list[tuple[int | None, int | None]], k: int
) -> list[list[tuple[int, int]]]:
    """For each window (least and most score, None for no end) the best k usable rows in it,
    as (score, place), by score and id."""
    scores, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lows = [low for low, _ in windows]
    least = None if None in lows else min(lows)

    def within(window: tuple[int | None, int | None]) -> np.ndarray:
        """The window's best k among the scores, which are sorted."""
        low, high = window
        first = 0 if high is None else int(np.searchsorted(-scores, -high))
        last = len(scores) if low is None else int(np.searchsorted(-scores, -low, side="right"))
        return np.arange(first, max(first, min(last, first + k)))

    def certain(window: tuple[int | None, int | None], bound: float) -> bool:
        low, high = window
        if low is not None and (bound < low or high is not None and high < low):
            return True
        found = within(window)
        return len(found) == k and scores[found[-1]] > bound

    for rows, bound in cells.walk(anchor):
        rows = rows[usable[rows]]
        found = cells.scores(anchor, rows)
        if least is not None:
            rows, found = rows[found >= least], found[found >= least]
        scores, places = np.concatenate([scores, found]), np.concatenate([places, rows])
        order = np.lexsort((cells.numbers[places], cells.ids[places], -scores))
        scores, places = scores[order], places[order]
        # Only the best of each window can be in the end's result.
        wanted = np.unique(np.concatenate([within(window) for window in windows]))
        scores, places = scores[wanted], places[wanted]
        if all(certain(window, bound) for window in windows):
            break
    return [[(int(scores[i]), int(places[i])) for i in within(window)] for window in windows]


def _spread(asked: DataFrame, index: DataFrame, blocks: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Every chunk of anchors with every block of the index."""
    chunks = max(1, -(-asked.count() // chunk))
    numbered = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    every = numbered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copies = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return every, copies


def mine_hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    anchor: str | Column = "vec_id % 100 = 0",
    positives: int = 5,
    negatives: int = 5,
    low_share: int = 80,
    high_share: int = 100,
    centres: int = CENTRES,
    sample: int = SAMPLE,
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and
    ``negative_score``: for each row that ``anchor`` picks (a condition on ``id_col``) and each
    of its best ``positives``, the best ``negatives`` rows of another label whose score is
    from ``low_share`` to ``high_share`` hundredths of the positive's."""
    rows = stored(quantised(vectors, id_col, label_col, vector_col), "vectors")
    counted = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    n, width = counted[0], counted[1] or 1
    blocks = max(1, -(-n // block))
    books = codebooks(rows, n, width, centres, sample)
    shared = share(vectors.sparkSession, books)
    index = stored(build_index(rows, books, width, blocks), "index")
    named = rows.withColumnRenamed("id", id_col)
    picked = stored(named.filter(anchor).withColumnRenamed(id_col, "id"), "anchors")

    def unpack(slices: pd.DataFrame) -> Cells:
        return Cells(slices.iloc[0], shared.value["model"], width)

    def find_positives(asked: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(slices):
            cells, values = unpack(slices), _rows_of(asked["q"], width)
            for number, label, value in zip(asked["row"], asked["label"], values):
                usable = (cells.labels == label) & (cells.numbers != number)
                found = best_in_windows(cells, value, usable, [(None, None)], positives)
                out += [(number, cells.ids[p], cells.numbers[p], s) for s, p in found[0]]
        return pd.DataFrame(out, columns=["row", "positive_id", "positive_row", "positive_score"])

    every, copies = _spread(picked, index, blocks, chunk)
    near = (
        every.groupBy("block", "chunk")
        .cogroup(copies.groupBy("block", "chunk"))
        .applyInPandas(find_positives, "row long, positive_id long, positive_row long, positive_score long")
    )
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    best = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    positive = F.struct("positive_score", "place", "positive_id")
    asked = stored(
        best.groupBy("row").agg(F.sort_array(F.collect_list(positive)).alias("positives"))
        .join(picked, "row").select("row", "id", "label", "q", "positives"),
        "positives",
    )

    def find_negatives(asked: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(slices):
            cells, values = unpack(slices), _rows_of(asked["q"], width)
            columns = zip(asked["row"], asked["id"], asked["label"], asked["positives"], values)
            for number, own_id, label, known, value in columns:
                wanted = [(p["positive_score"], p["place"], p["positive_id"]) for p in known]
                windows = [(-(-low_share * s // 100), high_share * s // 100) for s, _, _ in wanted]
                found = best_in_windows(cells, value, cells.labels != label, windows, negatives)
                for (score, place, positive_id), rows_found in zip(wanted, found):
                    out += [
                        (number, own_id, place, positive_id, score, cells.ids[p], cells.numbers[p], s)
                        for s, p in rows_found
                    ]
        names = ["row", "anchor_id", "place", "positive_id", "positive_score"]
        return pd.DataFrame(out, columns=[*names, "negative_id", "negative_row", "negative_score"])

    every, copies = _spread(asked, index, blocks, chunk)
    found = (
        every.groupBy("block", "chunk")
        .cogroup(copies.groupBy("block", "chunk"))
        .applyInPandas(
            find_negatives,
            "row long, anchor_id long, place int, positive_id long, positive_score long, "
            "negative_id long, negative_row long, negative_score long",
        )
    )
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
