"""Jaccard self-join of word n-gram sets: a size-aware heavy-light join, and its components.

Two sets link when 100 times their intersection is at least ``LEAST`` times their union, so
sets of n and m shingles must share t(n, m), the ceiling of LEAST (n + m) / (100 + LEAST).

Equal sets are one class, found by a 128-bit digest. Classes are light or heavy by size:

- *Light*, up to a boundary: two sets share t shingles if and only if they have a subset of t
  shingles in common, so each set lists its subsets of the few sizes t that some partner
  calls for. The smallest set under a subset links with all others there that the subset
  suffices for, which connects whatever the subset connects.
- *Heavy*: inverted lists of shingles are scanned, for pairs of which one at least is heavy.
  A set is listed under its rarest shingles alone, one more than it may lack, as two sets
  that link share one of them. Pairs in a list must agree in size, have enough shingles
  left after the list's, and differ in no more of 512 parity bits than linked sets may;
  then the whole sets are compared.

The boundary is the one of least cost: subsets of light sets against list entries and list
lengths of the others, as counted in the data.

Heavy pairs are checked in two rounds, so that a group of n copies with small changes costs
about n checks: first each set of a list with the partner that has most partners there and
with the one nearest by parity bits, then all pairs whose sets are not yet known to be
connected. Rarity is by counts of shingles in ``BUCKETS`` buckets, over all documents: any
order gives the same links. Lists longer than ``TILE`` are cut into tiles by size and hash,
and tiles are compared pair by pair. For a check the whole texts of both sides are read
again; a bitmap of their hashes leaves out most other texts.

Results by case: a NULL or empty text, or one without words, has an empty set, links with
nothing, not even its like, and is its own component; fewer words than a shingle make one
shingle; copies and repeated rows are of one class, so they link; a component's id is the
smallest non-NULL id in it (NULL if there is none); an empty table gives an empty one;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivables.functions import key_hash
from receivables.functions.keys import KEY_HASH
from receivables.llm.common import share, stored, type_of
from receivables.llm.simhash import connected

SHINGLE = 3
LEAST = 90
BUCKETS = 1 << 18
SKETCH = 512
TILE = 4096
#: Sets beyond this size are never light: they lack three shingles and more.
LIGHT = 39
FILTER_BITS = 24
MEMBERS = 256

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The set of the text's shingles as sorted 64-bit hashes."""
    # bytes.lower changes A-Z only; bytes.split takes the blank and 0x09 to 0x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    taken = min(width, len(words))
    n = len(words) - taken + 1
    total = np.full(n, taken, np.uint64)
    for i in range(taken):
        total = mixed(total * _ODD[0] + hashes[i : i + n] * _ODD[1])
    return np.unique(total)


def needed_overlap(n: int | np.ndarray, m: int | np.ndarray, least: int = LEAST) -> int | np.ndarray:
    return -(-least * (n + m) // (100 + least))


def prefix_length(n: int, least: int = LEAST) -> int:
    """One more than a set of ``n`` may lack of any set it links with."""
    return n - -(-least * n // 100) + 1


def subset_sizes(n: int, most: int, least: int = LEAST) -> list[int]:
    """What a set of ``n`` must share with the sets up to ``most`` that it may link with."""
    partners = range(-(-least * n // 100), min(100 * n // least, most) + 1)
    return sorted({int(needed_overlap(n, m, least)) for m in partners})


def parity(h: np.ndarray) -> bytes:
    """For each of ``SKETCH`` remainders whether an odd number of hashes has it. Two sets'
    bits differ in no more places than the sets have shingles apart."""
    odd = np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Small parts of the batches, with the texts in the last column."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            yield part, part.column(part.num_columns - 1).to_pylist()


def bucket_levels(docs: DataFrame, text_col: str, width: int, buckets: int) -> np.ndarray:
    """For each bucket of hashes how many documents have a shingle in it, on a scale of
    sixteenths of doublings."""
    low = np.uint64(64 - buckets.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches):
            found = [shingles(text, width) for text in texts]
            total += np.bincount((np.concatenate(found) >> low).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sums = docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    counts = np.zeros(buckets)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return (16 * np.log2(counts + 1)).astype(np.uint16)


def describe(
    docs: DataFrame, id_col: str, text_col: str, levels: np.ndarray, width: int, least: int
) -> DataFrame:
    """Per document: ``id``, ``n``, ``set`` (the set's digest), ``text`` (the text's hash),
    ``prefix`` (its rarest shingles, rarest first), ``sketch``, and ``whole`` for light sets."""
    shared = share(docs.sparkSession, levels)
    low = np.uint64(64 - len(levels).bit_length() + 1)
    names = ["id", "n", "set", "text", "prefix", "sketch", "whole"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value["model"]
        for part, texts in _texts(batches):
            sets = [shingles(text, width) for text in texts]
            prefixes = []
            for h in sets:
                # Sorted hashes and a stable sort: one order of all shingles for all sets.
                order = np.argsort(rank[(h >> low).astype(np.int64)], kind="stable")
                prefixes.append(h[order[: prefix_length(len(h), least)]].view(np.int64) if len(h) else None)
            columns = [
                part.column(0),
                pa.array([len(h) for h in sets], pa.int32()),
                pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets], pa.binary()),
                part.column(1),
                pa.array(prefixes, pa.list_(pa.int64())),
                pa.array([parity(h) if len(h) else None for h in sets], pa.binary()),
                pa.array([h.view(np.int64) if 0 < len(h) <= LIGHT else None for h in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = type_of(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        work, f"id {kind}, n int, set binary, text long, prefix array<long>, sketch binary, whole array<long>"
    )


def boundary(classes: DataFrame, listed: DataFrame, least: int) -> int:
    """The greatest light size: that of least cost, counted in subsets made, and in entries
    of inverted lists and the lengths of those."""
    small = f"n <= {LIGHT}"
    sets = dict(classes.filter(small).groupBy("n").count().collect())
    lengths = dict(listed.filter(small).groupBy("n").agg(F.sum("length")).collect())

    def cost(most: int) -> int:
        subsets = sum(
            count * comb(n, t) for n, count in sets.items() if n <= most for t in subset_sizes(n, most, least)
        )
        lists = sum(
            prefix_length(n, least) * count + lengths.get(n, 0)
            for n, count in sets.items()
            if 100 * n >= least * (most + 1)
        )
        return subsets + lists

    return min(range(LIGHT + 1), key=cost)


@lru_cache(maxsize=256)
def _left_out(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)


def light_links(classes: DataFrame, most: int, least: int) -> DataFrame:
    """Links ``(a, b)`` that connect the classes of up to ``most`` shingles."""

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found: list[tuple] = []
                for c, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h = np.array(whole, np.int64).view(np.uint64)
                    second = mixed(h ^ _ODD[2])
                    for t in subset_sizes(len(h), most, least):
                        out = _left_out(len(h), len(h) - t)
                        sums = (x.sum() - x[out].sum(axis=1, dtype=np.uint64) for x in (h, second))
                        found.append((c, len(h), t, *(np.asarray(s, np.uint64) for s in sums)))
                sizes = [len(row[3]) for row in found]
                columns = [pa.array(np.repeat(np.array([row[i] for row in found], np.int64), sizes)) for i in range(3)]
                columns += [
                    pa.array(np.concatenate([row[i] for row in found] or [np.zeros(0, np.uint64)]).view(np.int64))
                    for i in (3, 4)
                ]
                yield pa.RecordBatch.from_arrays(columns, ["c", "n", "t", "s", "s2"])

    light = classes.filter(f"n <= {most}").select("c", "whole")
    subsets = light.mapInArrow(enumerate_subsets, "c long, n long, t long, s long, s2 long")
    subset = ["t", "s", "s2"]
    shared = subsets.groupBy(*subset).agg(F.min(F.struct("n", "c")).alias("first"), F.count("*").alias("sets"))
    shared = shared.filter("sets > 1").withColumn(KEY_HASH, key_hash(subset))
    pairs = subsets.withColumn(KEY_HASH, key_hash(subset)).join(shared, [KEY_HASH, *subset])
    enough = F.expr(f"t * {100 + least} >= {least} * (n + first.n)")
    return pairs.filter(enough & F.expr("c <> first.c")).select(_ordered("c", "first.c")).select("p.*").distinct()


def _ordered(one: str, other: str) -> Column:
    return F.struct(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).alias("p")


def scan_tasks(listed: DataFrame, tile: int, least: int) -> DataFrame:
    """The entries of ``listed`` dealt out to tasks: ``task``, ``side``, ``c``, ``n``, ``pos``.

    A list of up to ``tile`` entries is one task. Others are cut by size, so that sets that
    link are in the same part or the next, then by a hash, into tiles; each pair of tiles that
    may hold links is a task, its sides told apart.
    """
    entry = ["c", "n", "pos"]
    short = listed.filter(F.col("length") <= tile).select(
        F.xxhash64("token").alias("task"), F.lit(-1).alias("side"), *entry
    )
    step = log(100 / least) + 1e-9
    crowd = listed.filter(F.col("length") > tile).withColumn("size", F.floor(F.log("n") / step).cast("int"))
    parts = crowd.groupBy("token", "size").count().select(
        "token", "size", F.ceil(F.col("count") / tile).cast("int").alias("parts")
    )
    cut = crowd.join(parts, ["token", "size"]).withColumn(
        "part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    )
    tiles = parts.select("token", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnsRenamed({"size": f"size_{name}", "part": f"part_{name}"})

    one, two = ("size_a", "part_a"), ("size_b", "part_b")
    # A row here is a tile, which stands for up to ``tile`` entries.
    pairs = side(tiles, "a").join(side(tiles, "b"), "token").filter(
        (F.struct(*one) <= F.struct(*two)) & (F.col("size_b") - F.col("size_a") <= 1)
    )
    alike = F.struct(*one) == F.struct(*two)
    task = F.xxhash64("token", *one, *two).alias("task")
    left = side(cut, "a").join(pairs, ["token", *one]).select(
        task, F.when(alike, -1).otherwise(0).alias("side"), *entry
    )
    right = side(cut, "b").join(pairs.filter(~alike), ["token", *two]).select(task, F.lit(1).alias("side"), *entry)
    return short.union(left).union(right)


def _passing(
    rows: dict[str, np.ndarray], most_light: int, least: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs of different ``label`` that may link, in parts, each pair once, and in how
    many parity bits they differ. Rows are sorted by task and size."""
    task, n, pos, side, label, sketch = (rows[k] for k in ("task", "n", "pos", "side", "label", "sketch"))
    i, shift = np.arange(len(n)), 0
    while len(i):
        shift += 1
        i = i[: np.searchsorted(i, len(n) - shift)]
        j = i + shift
        # Sizes rise within a task, so what fails here fails for the rest of the list.
        on = (task[i] == task[j]) & (100 * n[i] >= least * n[j])
        i, j = i[on], j[on]
        need = needed_overlap(n[i], n[j], least)
        left = np.minimum(n[i] - pos[i], n[j] - pos[j])  # this shingle and what follows
        open_ = (left >= need) & (n[j] > most_light) & (label[i] != label[j])
        open_ &= (side[i] < 0) | (side[i] != side[j])
        a, b, need = i[open_], j[open_], need[open_]
        if len(a):
            apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
            near = apart <= n[a] + n[b] - 2 * need
            yield a[near], b[near], apart[near]


def near_pairs(rows: dict[str, np.ndarray], most_light: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may link and whose labels differ."""
    found = [(a, b) for a, b, _ in _passing(rows, most_light, least)]
    nothing = np.zeros(0, np.int64)
    return tuple(np.concatenate([nothing, *(pair[k] for pair in found)]) for k in (0, 1))


def lead_pairs(
    rows: dict[str, np.ndarray], most_light: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs that may link, places of each row and of its leads: the partner that has most
    partners in the list itself, and the nearest one. Also the tasks that have further pairs."""
    n = len(rows["n"])
    degree, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, b, _ in _passing(rows, most_light, least):
        degree[a] += 1
        degree[b] += 1
        left[a] += 1
    # By degree, then by place: a total order, so that leads form trees.
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), degree))] = np.arange(n)
    lead, most = np.arange(n), rank.copy()
    close, least_apart = np.arange(n), np.full(n, np.iinfo(np.int64).max)
    for a, b, apart in _passing(rows, most_light, least) if left.any() else ():
        for x, y in ((a, b), (b, a)):
            more = rank[y] > most[x]
            most[x[more]], lead[x[more]] = rank[y[more]], y[more]
            closer = apart < least_apart[x]
            least_apart[x[closer]], close[x[closer]] = apart[closer], y[closer]
    x = np.arange(n)
    # Not what is there as a lead already, in either direction, and mutual ones once.
    new = (close != lead) & (lead[close] != x) & ((close[close] != x) | (close < x))
    x, y = np.concatenate([x, x[new]]), np.concatenate([lead, close[new]])
    x, y = x[x != y], y[x != y]
    tasks, place = np.unique(rows["task"], return_inverse=True)
    further = np.bincount(place, left, len(tasks)) > np.bincount(place[x], minlength=len(tasks))
    return x, y, tasks[further]


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows by column, cut between tasks."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        bits = b"".join(rows["sketch"])
        rows["sketch"] = np.frombuffer(bits, np.uint64).reshape(-1, SKETCH // 64)
        rows = rows if rest is None else {k: np.concatenate([rest[k], rows[k]]) for k in rows}
        cut = int(np.searchsorted(rows["task"], rows["task"][-1]))
        if cut:
            yield {k: v[:cut] for k, v in rows.items()}
        rest = {k: v[cut:] for k, v in rows.items()}
    if rest is not None:
        yield rest


def candidates(
    tasks: DataFrame, classes: DataFrame, labels: DataFrame | None, most_light: int, least: int
) -> DataFrame:
    """Distinct pairs ``(lead, member)`` from the lists: each set with its leads, and the tasks
    with further pairs as leads without a member; or, with ``labels`` ``(node, root)``, all
    pairs of different roots."""
    about, leads_only = classes.select("c", "sketch"), labels is None
    if labels is not None:
        about = about.join(labels, F.col("c") == F.col("node"), "left").select(
            "c", "sketch", F.coalesce("root", "c").alias("label")
        )
    else:
        about = about.withColumn("label", F.col("c"))
    rows = tasks.join(about, "c").select(
        "task", F.col("n").cast("long"), "c", F.col("pos").cast("long"), "side", "label", "sketch"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_tasks(batches):
            if leads_only:
                x, y, open_ = lead_pairs(part, most_light, least)
            else:
                (x, y), open_ = near_pairs(part, most_light, least), np.zeros(0, np.int64)
            leads = pa.array(np.concatenate([part["c"][y], open_]))
            members = pa.concat_arrays([pa.array(part["c"][x]), pa.nulls(len(open_), pa.int64())])
            yield pa.RecordBatch.from_arrays([leads, members], ["lead", "member"])

    dealt = rows.repartition("task").sortWithinPartitions("task", "n", "c")
    return dealt.mapInArrow(scan, "lead long, member long").distinct()


def _texts_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``key`` and ``body``, packed: a text of each hash in ``wanted``'s column ``text``, and, as a
    bitmap is asked, some others."""
    bits = wanted.select(F.shiftrightunsigned("text", 64 - FILTER_BITS).alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("bit")
    )
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = share(docs.sparkSession, words.view(np.uint64))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen, packer = shared.value["model"], set(), zstandard.ZstdCompressor()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            place = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            on = (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
            rows = [i for i in np.flatnonzero(on).tolist() if keys[i] not in seen]
            if len(seen) > 100_000:
                seen.clear()
            seen.update(keys[rows].tolist())
            for first in range(0, len(rows), 256):
                part = batch.take(pa.array(rows[first : first + 256], pa.int64()))
                bodies = [packer.compress((text or "").encode()) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bodies, pa.binary())], ["key", "body"])

    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("body"))
    picked = texts.mapInArrow(pick, "key long, body binary")
    return picked.groupBy("key").agg(F.first("body").alias("body"))


def linked(docs: DataFrame, text_col: str, classes: DataFrame, pairs: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs ``(lead, member)`` whose whole sets link, as ``(a, b)``.

    A lead's text goes to one task with up to ``MEMBERS`` of its members' texts, to several
    tasks if it has more members.
    """
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.withColumn(KEY_HASH, key_hash(["lead"])).join(
        parts.withColumn(KEY_HASH, key_hash(["lead"])), [KEY_HASH, "lead"]
    )
    members = dealt.select(
        "lead",
        F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"),
        F.lit(1).alias("side"),
        F.col("member").alias("c"),
    )
    leads = parts.select(
        "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"),
        F.col("lead").alias("c"),
    )
    wanted = stored(members.union(leads).join(classes.select("c", "set", "text"), "c"), "wanted")
    texts = _texts_of(docs, text_col, wanted)
    rows = wanted.join(texts, wanted["text"] == texts["key"]).select("lead", "part", "side", "c", "set", "body")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, unpacker = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                for lead, number, c, name, body in zip(*(part[k] for k in ("lead", "part", "c", "set", "body"))):
                    if (lead, number) != at:
                        at, first = (lead, number), None
                    items = shingles(unpacker.decompress(body).decode(), width)
                    if xxhash.xxh3_128_digest(items.tobytes()) != name:  # another text of that hash
                        continue
                    if first is None:
                        first = items if c == lead else None
                        continue
                    shared = len(first) + len(items) - len(np.union1d(first, items))
                    if 100 * shared >= least * (len(first) + len(items) - shared):
                        found.append((lead, c))
            columns = [pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    sorted_rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "side", "c")
    return sorted_rows.mapInArrow(check, "a long, b long")


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    least: int = LEAST,
    buckets: int = BUCKETS,
    tile: int = TILE,
    most_light: int | None = None,
) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` for each document. ``most_light`` sets the
    boundary instead of its being worked out."""
    levels = bucket_levels(docs, text_col, width, buckets)
    described = stored(describe(docs, id_col, text_col, levels, width, least), "sets")
    kept = ("n", "text", "prefix", "sketch", "whole")
    classes = stored(
        described.filter("n > 0").groupBy("set")
        .agg(F.min("id").alias("least"), *(F.first(name).alias(name) for name in kept))
        .withColumn("c", F.monotonically_increasing_id()),
        "classes",
    )
    entries = classes.select("c", "n", F.posexplode("prefix").alias("pos", "token"))
    lengths = entries.groupBy("token").agg(F.count("*").alias("length")).filter("length > 1")
    # As ``key_hash``, but in two bytes: there is an entry for a tenth of all shingles.
    dealt = F.pmod(F.xxhash64("token"), F.lit(1 << 16)).alias(KEY_HASH)
    listed = stored(
        entries.withColumn(KEY_HASH, dealt).join(lengths.withColumn(KEY_HASH, dealt), [KEY_HASH, "token"])
        .select("c", "n", "pos", "token", "length"),
        "lists",
    )
    light = boundary(classes, listed, least) if most_light is None else most_light
    links = stored(light_links(classes, light, least), "light")
    tasks = scan_tasks(listed.filter(100 * F.col("n") >= least * (light + 1)), tile, least)

    def checked(pairs: DataFrame) -> DataFrame:
        return stored(linked(docs, text_col, classes, pairs, width, least), "links")

    found = stored(candidates(tasks, classes, None, light, least), "pairs")
    first, further = found.filter("member IS NOT NULL"), found.filter("member IS NULL")
    links = links.union(checked(first))
    groups = stored(connected(links), "groups")
    tasks = tasks.join(further.select(F.col("lead").alias("task")), "task", "left_semi")
    known = first.union(first.select("member", "lead"))
    second = candidates(tasks, classes, groups, light, least).join(known, ["lead", "member"], "left_anti")
    second = stored(second, "pairs")
    if not second.isEmpty():
        groups = stored(connected(links.union(checked(second))), "groups")

    rooted = classes.join(groups, classes["c"] == groups["node"], "left").select(
        "set", "least", F.coalesce("root", "c").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.withColumn(KEY_HASH, key_hash(["root"])).join(
        lowest.withColumn(KEY_HASH, key_hash(["root"])), [KEY_HASH, "root"]
    )
    found = named.select("set", "component_id", F.xxhash64("set").alias(KEY_HASH))
    rows = described.select("id", "n", "set").withColumn(KEY_HASH, key_hash(["set"]))
    return rows.join(found, [KEY_HASH, "set"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
