"""A quality classifier on hashed word and character n-gram vectors.

Every word stands for itself and for the character n-grams of its marked form; each of
these is hashed to a learned vector, a document is the mean of the vectors of all its
words, and a softmax over two outputs gives the probability of label 1. A word equal to
the one before it adds one more feature, the only trace the mean keeps of word order.
Vectors and outputs are learned together by stochastic gradient descent in numpy.

As the output is linear in the mean, a word's share of it is a single number, which is
worked out once per worker.

Results by case: a NULL text counts as empty; an empty text has no vector and its score
is that of the outputs' biases; without any labelled row of either class every score is
0.5; copies score alike; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.llm.common import (
    WordRows,
    map_rows,
    per_worker,
    sample_per_class,
    share,
    type_of,
)

BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (3, 4)
ROWS_PER_LABEL = 600
MOST_CHARS = 50_000_000
EPOCHS = 5
RATE = 0.5
BATCH = 16
THRESHOLD = 0.7
AGAIN = " again"  # no word holds a blank


def bucket(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % BUCKETS


class Buckets(dict):
    """n-gram to bucket, hashed once; n-grams are few, words many."""

    def __missing__(self, part: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[part] = found = bucket(part)
        return found


def features(word: str, known: Buckets) -> list[int]:
    """Buckets of the word and of the n-grams of its marked form."""
    if word == AGAIN:
        return [bucket(AGAIN)]
    marked = f"<{word}>"
    grams = [known[marked[i : i + n]] for n in NGRAMS for i in range(len(marked) - n + 1)]
    grams.append(bucket(" " + word))
    return grams


def words_of(text: str | None) -> list[str]:
    words = (text or "").split()
    return words + [AGAIN] * sum(map(eq, words, words[1:]))


class Model(NamedTuple):
    """``table``: what a feature adds to the score of label 1 over that of label 0."""

    table: np.ndarray
    bias: float


def _bag(
    text: str | None, known: dict[str, list[int]], buckets: Buckets
) -> tuple[np.ndarray, np.ndarray]:
    """A document's buckets and the share of each."""
    counts: Counter[int] = Counter()
    for word, n in Counter(words_of(text)).items():
        if word not in known:
            known[word] = features(word, buckets)
        for place in known[word]:
            counts[place] += n
    share = np.fromiter(counts.values(), float, len(counts))
    return np.fromiter(counts, np.int64, len(counts)), share / max(share.sum(), 1)


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Trains on ``texts``, which must be a bounded sample."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    outputs, biases = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    known: dict[str, list[int]] = {}
    buckets = Buckets()
    bags = [_bag(text, known, buckets) for text in texts]
    target = np.eye(2)[labels]
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))  # classes count alike
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(len(bags)), -(-len(bags) // BATCH)):
            means = np.stack([bags[i][1] @ vectors[bags[i][0]] for i in rows])
            raw = means @ outputs + biases
            odds = np.exp(raw - raw.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True) - target[rows]
            error *= weight[np.array(labels)[rows], None]
            back = error @ outputs.T
            outputs -= rate * means.T @ error
            biases -= rate * error.mean(axis=0)
            for i, gradient in zip(rows, back):
                # The mean shrinks a feature's gradient by its share; scaled to be felt.
                vectors[bags[i][0]] -= rate * 40 * bags[i][1][:, None] * gradient
    gain = outputs[:, 1] - outputs[:, 0]
    return Model((vectors @ gain).astype(np.float32), float(biases[1] - biases[0]))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.buckets = Buckets()
        self.words = WordRows(self.rows_of, 2)

    def rows_of(self, words: list[str]) -> np.ndarray:
        found = [features(word, self.buckets) for word in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = np.cumsum(sizes) - sizes
        gains = self.model.table.take(np.concatenate(found)).astype(float)
        return np.stack([np.add.reduceat(gains, starts), sizes], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        gain, n = self.words.sums([words_of(text) for text in texts]).T
        return 1 / (1 + np.exp(-(gain / np.maximum(n, 1) + self.model.bias)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = ROWS_PER_LABEL,
) -> Model:
    """Fits the model on the whole texts of at most ``rows`` labelled documents of each
    class, those whose ids have the smallest hashes. Labels other than 0 and 1 are ignored.

    An id that occurs several times, in either table, counts once, with the text of the
    smallest hash. Where the texts of a class come to more than ``MOST_CHARS`` characters, those
    of the largest hashes of ids are left out, so the driver gets no more than that a class.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    keys = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_class"))
    chosen = sample_per_class(keys, "_class", "_id", rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    one = (
        texts.join(F.broadcast(chosen), "_id")  # at most 2 * ``rows`` rows
        .groupBy("_id", "_class")
        .agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    )
    order = Window.partitionBy("_class").orderBy(F.xxhash64("_id"), "_id")
    chars = F.sum(F.coalesce(F.length("_text"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = one.withColumn("_chars", chars).filter(F.col("_chars") <= MOST_CHARS).orderBy("_id", "_class").collect()
    return fit([row["_text"] for row in found], [row["_class"] for row in found])


def score_quality(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_col``, the columns in ``keep``, ``score`` and ``predicted`` for each row."""
    shared = share(docs.sparkSession, tuple(model))  # BUCKETS numbers
    columns = list(dict.fromkeys([id_col, *keep]))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        scorer = per_worker(shared, lambda trained: Scorer(Model(*trained)))
        for batch in batches:
            scores = scorer.scores(batch[text_col])
            yield [
                *(batch[name] for name in columns),
                scores.tolist(),
                (scores >= threshold).astype(int).tolist(),
            ]

    fields = ", ".join(f"`{name}` {type_of(docs, name)}" for name in columns)
    needed = list(dict.fromkeys([*columns, text_col]))
    return map_rows(docs.select(*needed), f"{fields}, score double, predicted int", work)
