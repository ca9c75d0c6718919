"""SimHash fingerprints, exact links within a few bits, and connected groups.

Links are found by comparing tiles of distinct fingerprints with exclusive-or and bit
counts. Two fingerprints that differ in at most ``RADIUS`` bits agree in at least one of
``RADIUS + 1`` bands of bits, so only fingerprints with a band in common meet. A band
value shared by more fingerprints than a tile holds is cut into tiles by population
count, and pairs of tiles whose population counts differ by more than ``RADIUS`` are
skipped, as the difference of the counts is a lower bound of the distance. A task reports
the links of a spanning forest instead of all of them, which connects the same groups.

Results by case: a NULL text counts as empty and has fingerprint zero, which links like
any other; a text with fewer words than a shingle is one shingle; copies and repeated
rows share a fingerprint and hence a group; an empty table gives an empty one; a group's
id is the smallest non-NULL id in it (NULL if there is none); further columns of the
input are ignored, unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivables.functions import key_hash
from receivables.functions.keys import KEY_HASH
from receivables.llm.common import map_rows, stored, type_of

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 4096


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of the text's word shingles, as 64 bits."""
    # bytes.lower changes A-Z only; bytes.split takes the blank and 0x09 to 0x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    last = ends.tolist()[width - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, last)]
    bits = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[first : first + (1 << 16)], "<u8")
        rows = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += rows.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col``, the columns in ``keep`` and ``fp``, the fingerprint as a signed long."""
    columns = list(dict.fromkeys([id_col, *keep]))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        for batch in batches:
            found = [_signed(fingerprint(text)) for text in batch[text_col]]
            yield [*(batch[name] for name in columns), found]

    fields = ", ".join(f"`{name}` {type_of(docs, name)}" for name in columns)
    needed = list(dict.fromkeys([*columns, text_col]))
    return map_rows(docs.select(*needed), f"{fields}, fp long", work)


def _bands(radius: int) -> Column:
    """An array of (band, value of its bits)."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [
        F.struct(
            F.lit(i).alias("band"),
            F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"),
        )
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]
    return F.array(*parts)


def _groups(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the place of the first of its group; every pair is compared."""
    group = np.full(len(fps), -1)
    if len(fps) <= 64:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        if near.sum() == len(fps):  # none but each with itself
            return np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        first, left, reached = left[0], left[1:], [left[0]]
        group[first] = first
        while reached and len(left):
            near = np.bitwise_count(fps[left] ^ fps[reached.pop()]) <= radius
            if near.any():
                found, left = left[near], left[~near]
                group[found] = first
                reached.extend(found.tolist())
    return group


def links_within(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs that connect what the radius connects within one tile: each fingerprint with
    the first one of its group, reached by way of others."""
    group = _groups(fps, radius)
    return [(int(fps[i]), int(fps[g])) for i, g in enumerate(group) if i != g]


def links_across(one: np.ndarray, other: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between two tiles that connect, with the pairs within them, what the radius does."""
    group_one, group_other = _groups(one, radius), _groups(other, radius)
    leads = list(range(len(other))), {}

    def lead(node: int) -> int:
        while leads[0][node] != node:
            leads[0][node] = node = leads[0][leads[0][node]]
        return node

    links = []
    for i in range(len(one)):
        near = np.bitwise_count(other ^ one[i]) <= radius
        if not near.any():
            continue
        for g in np.unique(group_other[near]):
            root = lead(int(g))
            mine = leads[1].setdefault(int(group_one[i]), None)
            if mine is not None and lead(mine) == root:
                continue
            links.append((int(one[i]), int(other[np.flatnonzero(near & (group_other == g))[0]])))
            if mine is not None:
                leads[0][root] = lead(mine)
            leads[1][int(group_one[i])] = root
    return links


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints in column ``fp``.

    Exact for every pair within ``radius`` bits. Needs ``distinct`` stored, as it is read
    several times.
    """
    count = F.bit_count("fp")
    banded = distinct.select("fp", F.inline(_bands(radius))).withColumn("pc", count.cast("int"))
    sizes = banded.groupBy("band", "value").count()
    small = sizes.filter((F.col("count") > 1) & (F.col("count") <= tile)).select("band", "value")
    large = sizes.filter(F.col("count") > tile).select("band", "value")

    # Band values that fit one tile make one task each.
    first, second = ("pc_a", "part_a"), ("pc_b", "part_b")
    task = ["band", "value", *first, *second]
    alone = banded.join(small, ["band", "value"]).select(
        "band", "value", *(F.lit(0).alias(c) for c in (*first, *second)), F.lit(0).alias("side"), "fp"
    )
    # The others are cut into tiles by population count, large counts further by a hash.
    crowd = banded.join(large, ["band", "value"])
    parts = crowd.groupBy("band", "value", "pc").count().withColumn(
        "parts", F.ceil(F.col("count") / tile).cast("int")
    )
    cut = crowd.join(parts.drop("count"), ["band", "value", "pc"]).withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    )
    tiles = parts.select(
        "band", "value", "pc", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )

    def side(names: tuple[str, str], df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(dict(zip(("pc", "part"), names)))

    # A row here is a tile, which stands for up to ``tile`` fingerprints.
    pairs = side(first, tiles).join(side(second, tiles), ["band", "value"]).filter(
        (F.struct(*first) <= F.struct(*second)) & (F.col("pc_b") - F.col("pc_a") <= radius)
    )
    left = side(first, cut).join(pairs, ["band", "value", *first])
    right = side(second, cut).join(
        pairs.filter(F.struct(*first) != F.struct(*second)), ["band", "value", *second]
    )
    tiled = left.select(*task, F.lit(0).alias("side"), "fp").union(
        right.select(*task, F.lit(1).alias("side"), "fp")
    )

    def compare(batches: Iterator[dict[str, np.ndarray]]) -> Iterator[list]:
        for tasks in _whole_groups(batches):
            found: list[tuple[int, int]] = []
            for sides in tasks:
                one, two = (np.sort(side).view(np.uint64) for side in sides)
                found += links_across(one, two, radius) if len(two) else links_within(one, radius)
            yield [[_signed(a) for a, _ in found], [_signed(b) for _, b in found]]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (
            {name: batch.column(i).to_numpy() for i, name in enumerate(batch.schema.names)}
            for batch in batches
        )
        for a, b in compare(columns):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = alone.union(tiled).select(F.xxhash64(*task).alias("task"), "side", "fp")
    return (
        rows.repartition("task").sortWithinPartitions("task", "side")
        .mapInArrow(batches_of, "a long, b long").distinct()
    )


def _whole_groups(batches: Iterator[dict[str, np.ndarray]]) -> Iterator[list[list[np.ndarray]]]:
    """The two sides of each task; rows come in the tasks' order."""
    rest: dict[str, np.ndarray] | None = None

    def split(rows: dict[str, np.ndarray]) -> list[list[np.ndarray]]:
        cuts = np.flatnonzero(np.diff(rows["task"])) + 1
        return [
            [fps[sides == 0], fps[sides == 1]]
            for fps, sides in zip(np.split(rows["fp"], cuts), np.split(rows["side"], cuts))
        ]

    for batch in batches:
        if not len(batch["task"]):
            continue
        rows = batch if rest is None else {k: np.concatenate([rest[k], batch[k]]) for k in batch}
        cut = np.searchsorted(rows["task"], rows["task"][-1])
        if cut:
            yield split({k: v[:cut] for k, v in rows.items()})
        rest = {k: v[cut:] for k, v in rows.items()}
    if rest is not None:
        yield split(rest)


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the links ``(a, b)``; the root is the group's least.

    Large-star and small-star steps by turns, each written to the shared folder, until no
    link changes. A star's centre is found by a grouped minimum, which is partial before
    its shuffle, and brought back by a join that Spark can split.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def join_least(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) with m, the least of u and its partners."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"), key_hash(["u"]))
        return pairs.withColumn(KEY_HASH, key_hash(["u"])).join(least, [KEY_HASH, "u"]).drop(KEY_HASH)

    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # large: u greater than v, so v's least partner is u's smallest neighbour
        small = join_least(large)
        edges = stored(
            small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v")).filter("u != v").distinct(),
            "links",
        )
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    radius: int = RADIUS,
) -> DataFrame:
    """``id_col``, the columns in ``keep``, ``fingerprint`` (hexadecimal) and ``component_id``,
    the smallest id of the group, for each row."""
    prints = stored(fingerprints(docs, id_col, text_col, keep), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct")
    groups = stored(connected(links(distinct, radius)), "groups")
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root")
    )
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.withColumn(KEY_HASH, key_hash(["_root"])).join(
        least.withColumn(KEY_HASH, key_hash(["_root"])), [KEY_HASH, "_root"]
    )
    found = named.select("fp", "component_id", F.xxhash64("fp").alias(KEY_HASH))
    return (
        prints.withColumn(KEY_HASH, key_hash(["fp"]))
        .join(found, [KEY_HASH, "fp"])
        .select(
            id_col,
            *(name for name in keep if name != id_col),
            F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
            "component_id",
        )
    )
