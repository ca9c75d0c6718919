"""What several of the text operators need."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from receivables.scratch import new_folder


BATCH_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once and
    a lost executor costs no more than reading a file again."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text leaves 2 modulo 4. A NULL id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1))
    return (batch.slice(first, rows) for first in range(0, batch.num_rows, rows))


def map_rows(
    df: DataFrame, fields: str, work: Callable[[Iterator[dict[str, list]]], Iterator[Sequence]]
) -> DataFrame:
    """``df`` through Python, batch by batch.

    ``work`` gets an iterator of batches, each a list of values per column, and gives, for
    each batch it makes, the output columns in the order of ``fields`` (a DDL text). Python
    objects take many times the space of a text, so a batch is no larger than about
    ``BATCH_BYTES`` where rows are not larger themselves.
    """
    schema = StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (
            {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
            for batch in batches
            for part in _parts(batch)
        )
        for out in work(columns):
            arrays = [pa.array(values, field.type) for values, field in zip(out, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def share(spark: SparkSession, model: object) -> Broadcast:
    """Sends ``model``, plain data of bounded size, to the executors, for ``per_worker``."""
    return spark.sparkContext.broadcast({"model": model})


def per_worker(shared: Broadcast, make: Callable[[object], object]) -> object:
    """What ``make`` builds from the shared model, kept for later tasks of the same worker:
    a worker holds on to its copy of a broadcast."""
    state = shared.value
    if "made" not in state:
        state["made"] = make(state["model"])
    return state["made"]


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def sample_per_class(labelled: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """At most ``rows`` keys of each class, those with the smallest hashes; copies are one.

    ``labelled`` needs narrow rows only. Numbers of different keys, to within some hundredths,
    give each class a bound on the hash that leaves about twice as many keys as wanted, so that
    just those are told apart and ranked.
    """
    counts = labelled.groupBy(label).agg(F.approx_count_distinct(key).alias("count"))
    spread = F.pmod(F.xxhash64(key, F.lit(label)), F.lit(1 << 30)) / float(1 << 30)
    near = (
        labelled.join(F.broadcast(counts), label)  # a row for each class
        .withColumn("_spread", spread)
        .filter(F.col("_spread") * F.col("count") <= 2 * rows + 50)
        .select(label, key, "_spread")
        .distinct()
    )
    order = Window.partitionBy(label).orderBy("_spread", key)
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= rows).select(key, label)


class WordRows(dict):
    """Word to row of numbers, worked out once per word; forgets all when it has grown large.

    ``rows_of`` gets a list of new words and returns one row of ``width`` numbers for each.
    """

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], width: int, most: int = 200_000):
        super().__init__()
        self.rows_of, self.width, self.most = rows_of, width, most
        self.rows, self.new, self.chars = np.zeros((1024, width)), [], 0

    def __missing__(self, word: str) -> int:
        place = len(self)
        self[word] = place
        self.new.append(word)
        self.chars += len(word)
        return place

    def places(self, words: Iterable[str], n: int) -> np.ndarray:
        """The row number of each of the ``n`` words; stays valid until the next call."""
        if len(self) > self.most or self.chars > 40_000_000:
            self.clear()
            self.chars = 0
        found = np.fromiter(map(self.__getitem__, words), np.int64, n)
        if self.new:
            first = len(self) - len(self.new)
            if len(self.rows) < len(self):
                grown = np.zeros((2 * len(self), self.width))
                grown[:first] = self.rows[:first]
                self.rows = grown
            self.rows[first : len(self)] = self.rows_of(self.new)
            self.new = []
        return found

    def sums(self, texts: Sequence[list[str]], at_once: int = 100_000) -> np.ndarray:
        """For each list of words the sum of their rows."""
        out = np.zeros((len(texts), self.width))
        some = [i for i, words in enumerate(texts) if words]
        sizes = np.array([len(texts[i]) for i in some], np.int64)
        groups = np.cumsum(sizes) // at_once
        for group in np.unique(groups):
            rows = np.flatnonzero(groups == group)
            n = sizes[rows]
            words = chain.from_iterable(texts[some[i]] for i in rows)
            places = self.places(words, int(n.sum()))
            found = np.add.reduceat(self.rows.take(places, axis=0), np.cumsum(n) - n, axis=0)
            out[[some[i] for i in rows]] = found
        return out
