"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts with frozen counts. A text's code length
in bits under a language is the sum over its bytes; the shortest code wins. Words are
coded one by one: a word's bytes follow a blank and end with one, and contexts do not
reach over it, so the bits of a word are worked out once per worker.

An unseen byte escapes to the next shorter context (method C: an escape counts as often
as the context has distinct bytes), bytes of the longer contexts being excluded there;
below the empty context all bytes left are equally likely.

Results by case: a NULL text and one without a letter are ``und`` with score 0, as is
every text if nothing is labelled; ties go to the language first by name; copies are
scored alike; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.llm.common import (
    WordRows,
    map_rows,
    per_worker,
    sample_per_class,
    share,
    type_of,
)

UNDETERMINED = "und"
ORDER = 3
ROWS_PER_LANGUAGE = 400
# What Python's ``str.split`` takes for blanks, for the same words everywhere.
BLANKS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

Contexts = dict[bytes, dict[int, int]]


def grams(word: bytes, order: int) -> list[bytes]:
    """Each byte of the word and of the blank after it, behind its context."""
    coded = b" " + word + b" "
    return [coded[max(0, i - order) : i + 1] for i in range(1, len(coded))]


def context_tree(word_counts: dict[str, int], order: int = ORDER) -> Contexts:
    """How often each byte follows each context of at most ``order`` bytes."""
    whole: dict[bytes, int] = defaultdict(int)
    for word, n in word_counts.items():
        for gram in grams(word.encode(), order):
            whole[gram] += n
    tree: Contexts = defaultdict(lambda: defaultdict(int))
    for gram, n in whole.items():
        for start in range(len(gram)):
            tree[gram[start:-1]][gram[-1]] += n
    return {context: dict(counts) for context, counts in tree.items()}


def code_length(tree: Contexts, gram: bytes) -> float:
    """Bits for the last byte of ``gram`` behind the others."""
    context, byte = gram[:-1], gram[-1]
    excluded: set[int] = set()
    bits = 0.0
    for start in range(len(context) + 1):
        counts = tree.get(context[start:])
        if counts is None:
            continue
        left = {b: n for b, n in counts.items() if b not in excluded} if excluded else counts
        if not left:
            continue
        total = sum(left.values()) + len(left)
        if byte in left:
            return bits - log2(left[byte] / total)
        bits -= log2(len(left) / total)
        excluded |= left.keys()
    return bits + log2(256 - len(excluded))


class Coder:
    """Bits of words under every language, remembering what it has worked out."""

    def __init__(self, trees: dict[str, Contexts], order: int):
        self.languages = sorted(trees)
        self.trees = [trees[language] for language in self.languages]
        self.order = order
        self.places: dict[bytes, int] = {}
        self.bits = np.zeros((0, len(self.trees)))
        self.words = WordRows(self.rows_of, len(self.languages))

    def rows_of(self, words: list[str]) -> np.ndarray:
        if len(self.places) > 200_000:
            self.places = {}
        at: list[int] = []
        starts, fresh, known = [], [], len(self.places)
        for word in words:
            starts.append(len(at))
            for gram in grams(word.encode("utf-8", "surrogatepass"), self.order):
                place = self.places.get(gram)
                if place is None:
                    place = self.places[gram] = len(self.places)
                    fresh.append([code_length(tree, gram) for tree in self.trees])
                at.append(place)
        if fresh:
            self.bits = np.concatenate([self.bits[:known], fresh])
        return np.add.reduceat(self.bits.take(at, axis=0), starts, axis=0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability, all languages being as likely beforehand."""
        readable = [
            bool(self.languages) and text is not None and any(map(str.isalpha, text))
            for text in texts
        ]
        bits = self.words.sums([t.split() if ok else [] for t, ok in zip(texts, readable)])
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        best = bits.argmin(axis=1)
        shorter = bits.min(axis=1, keepdims=True) - bits
        scores = 1 / np.exp2(np.maximum(shorter, -1000)).sum(axis=1)
        names = [self.languages[i] if ok else UNDETERMINED for i, ok in zip(best, readable)]
        return names, np.where(readable, scores, 0.0).tolist()


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    rows: int = ROWS_PER_LANGUAGE,
    order: int = ORDER,
) -> dict[str, Contexts]:
    """The context tree of each language in ``labelled``.

    Fitted on the whole texts of at most ``rows`` rows a language, those whose ids have the
    smallest hashes; an id that occurs several times counts once, with the text of the smallest
    hash. Only the counts of their words come to the driver.
    """
    usable = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    keys = usable.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_class"))
    chosen = sample_per_class(keys, "_class", "_id", rows)
    texts = usable.select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_class"), F.col(text_col).alias("_text")
    )
    words = (
        texts.join(F.broadcast(chosen), ["_id", "_class"], "left_semi")  # ``rows`` a language
        .groupBy("_id", "_class")
        .agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
        .select("_class", F.explode(F.split("_text", f"[{BLANKS}]+")).alias("_word"))
        .filter("_word != ''")
        .groupBy("_class", "_word")
        .count()
    )
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for language, word, n in words.collect():
        counts[language][word] = n
    return {language: context_tree(found, order) for language, found in counts.items()}


def predict_language(
    docs: DataFrame,
    trees: dict[str, Contexts],
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, the columns in ``keep``, ``lang_pred`` and ``score`` for each row."""
    shared = share(docs.sparkSession, (trees, order))  # as large as the training sample lets it be
    columns = list(dict.fromkeys([id_col, *keep]))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        model = per_worker(shared, lambda trained: Coder(*trained))
        for batch in batches:
            yield [*(batch[name] for name in columns), *model.predict(batch[text_col])]

    fields = ", ".join(f"`{name}` {type_of(docs, name)}" for name in columns)
    needed = list(dict.fromkeys([*columns, text_col]))
    return map_rows(docs.select(*needed), f"{fields}, lang_pred string, score double", work)
