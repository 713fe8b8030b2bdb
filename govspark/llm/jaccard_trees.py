"""Exact join of documents whose word n-grams overlap, with signature trees.

A document's set is the hashes of its distinct n-grams of words. Documents with equal sets are one
class. Two classes can only reach the threshold if they share one of the first tokens of their
sets in any fixed order; tokens that many documents have come last in that order, so that the
passages many documents share bring no classes together.

Classes that share such a token meet in its bucket. First each meets the smallest class of the
bucket, which joins groups of near copies without their pairs. That class is done then. Where the
others of a bucket still are of several components, a signature tree is built over them: leaves hold the bitmap of a class's
tokens, how many tokens fall in each of some cells, and its size, nodes the OR of the bitmaps and the ranges of sizes, free bits and
components. A dual traversal from the root pairs nodes with nodes and drops a pair whose largest
possible overlap is below the threshold, or that lies in one component. A pair that meets in many
buckets is left to one of the first. What is left is compared by whole sets. Buckets of many classes are dealt out as pairs of tiles; no pair is left out.

Words are runs of other characters than ASCII white space, with A-Z lower-cased. Texts with fewer
words than an n-gram are one n-gram; texts without words, and nulls, have no set and no links. Equal
rows are members of one class. Null ids are not counted in the smallest id; a group of null ids
only has a null component. An empty table gives no rows. Sets and tokens are told apart by 64-bit
hashes. Memory of a task follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.common import WORD, materialise, slices, utf8
from govspark.llm.components import components
from govspark.llm.rolling import Ranges, bit, bitmap, contains, mixed


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    #: Bits of a signature in the trees, children of a node, classes of a tile. A class's own
    #: signature has that many bits or, for large sets, a power of 2 that is twice the size.
    bits: int = 1024
    fan: int = 8
    tile: int = 4096
    #: One of so many documents is looked at for common tokens, and the most of these that are kept.
    #: They change which tokens come last, so the work, and never the result.
    sample: int = 32
    common: int = 20_000


#: Cells of a set's counts. Bitmaps of large sets are full; counts of cells still tell them apart.
CELLS, FULL = 128, 255
#: Pairs of nodes that are looked at together, and candidate pairs that a task gives at once.
BLOCK = 1 << 17
#: Smallest tokens of a class's buckets that go with it, and what fills up shorter lists.
LEAST, NONE = 8, (1 << 63) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shingles(offsets: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct n-grams of each text."""
    count = len(offsets) - 1
    data = LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    blank = BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1]))
    end = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1
    if not len(start):
        return [np.zeros(0, np.uint64)] * count
    one = Ranges(data, 11)(start, end)
    # Positions count, so a sum over the words of an n-gram tells their order.
    total = np.zeros(len(one), np.uint64)
    row = np.searchsorted(offsets, start, "right") - 1
    per_row = np.bincount(row, minlength=count)
    first = np.cumsum(per_row) - per_row
    length = np.minimum(per_row, words)
    have = np.maximum(per_row - words + 1, (per_row > 0).astype(np.int64))
    at = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + np.repeat(first, have)
    size = np.repeat(length, have)
    total = mixed(size.astype(np.uint64))
    for k in range(words):
        live = size > k
        total[live] = mixed(total[live] * np.uint64(0x9E3779B97F4A7C15) + one[at[live] + k])
    ends = np.cumsum(have)
    return [np.unique(total[b - n : b]) for n, b in zip(have.tolist(), ends.tolist())]


def key_of(tokens: np.ndarray) -> int:
    """A hash of a set."""
    folded = mixed(np.array([np.add.reduce(mixed(tokens + np.uint64(7))), len(tokens)], np.uint64))
    return int(mixed(folded[:1] * np.uint64(3) + folded[1:]).view(np.int64)[0])


def signature(tokens: np.ndarray, bits: int) -> bytes:
    """Bitmap of the tokens; folding its halves together gives the bitmap of half the width."""
    width = max(bits, 1 << (2 * len(tokens)).bit_length())
    out = np.zeros(width, bool)
    out[(mixed(tokens) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def counted(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each cell by another hash; ``FULL`` stands for that many or more."""
    cells = (mixed(tokens * np.uint64(5) + np.uint64(3)) & np.uint64(CELLS - 1)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=CELLS), FULL).astype(np.uint8).tobytes()


def most_shared(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Most tokens that sets with these counts can share, pair by pair; ``least`` where cells are full."""
    shared = np.minimum(a, b)
    full = (shared == FULL).any(1)
    return np.where(full, least, np.minimum(shared.sum(1, dtype=np.int64), least))


def folded(sign: bytes, size: int) -> np.ndarray:
    """A signature as 64-bit numbers, folded to ``size`` bytes."""
    return np.bitwise_or.reduce(np.frombuffer(sign, np.uint64).reshape(-1, size // 8), 0)


def common_tokens(docs: DataFrame, s: Settings) -> np.ndarray:
    """Tokens that many documents of a sample share: at most ``common`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(0))
            for a, b in slices(offsets):
                found = np.concatenate(shingles(offsets[a : b + 1], data, s.words))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["token"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(s.sample)) == 0)
    tokens = sample.select(F.col("text").cast("string")).mapInArrow(run, "token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 2")
    best = often.orderBy(F.desc("n"), "token").limit(s.common).toArrow()
    return np.sort(best["token"].to_numpy().view(np.uint64))


def described(docs: DataFrame, common: np.ndarray, s: Settings) -> DataFrame:
    """Row, id, size, class and signature of each document, with the tokens it meets others by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            sizes, keys, signs, cells, first = [], [], [], [], []
            for a, b in slices(offsets):
                for tokens in shingles(offsets[a : b + 1], data, s.words):
                    n = len(tokens)
                    sizes.append(n)
                    keys.append(key_of(tokens) if n else None)
                    signs.append(signature(tokens, s.bits))
                    cells.append(counted(tokens))
                    # Rare tokens first. Two sets over the threshold share one of the first ones.
                    last = np.isin(tokens, common, assume_unique=True)
                    take = n - -(-s.percent * n // 100) + 1 if n else 0
                    first.append(np.concatenate([tokens[~last], tokens[last]])[:take].view(np.int64))
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(signs, pa.binary()), pa.array(cells, pa.binary()), lists],
                names=["row", "doc_id", "n", "key", "signature", "cells", "first"],
            )

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, key long, signature binary, cells binary, first array<long>")


def whole_sets(docs: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Class and whole set of the listed rows and of a few others, each class once."""
    bits = bitmap(rows, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(0).filter(pa.array(contains(bits, batch.column(1).to_numpy()))))
            for a, b in slices(offsets):
                sets = [x for x in shingles(offsets[a : b + 1], data, s.words) if len(x)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                keys = pa.array([key_of(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["key", "tokens"])

    chosen = docs.select(F.col("text").cast("string"), bit(F.xxhash64("doc_id", "text")).alias("bit"))
    return chosen.mapInArrow(run, "key long, tokens array<long>").dropDuplicates(["key"])


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs of classes (a, b) whose sets reach the threshold."""
    named = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    sets = materialise(whole_sets(docs, classes.join(named, "key", "left_semi"), s), "jaccard-sets")
    one = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = 100 * both >= s.percent * (F.size("x") + F.size("y") - both)
    return pairs.join(one, "a").join(two, "b").filter(enough).select("a", "b").distinct()


# ---------------------------------------------------------------- signature trees

class Level:
    """Nodes of one level: OR of the bitmaps, and ranges of sizes, free bits and components."""

    def __init__(self, bitmaps, low, high, ones, spare, least, most) -> None:
        self.bitmaps, self.low, self.high = bitmaps, low, high
        self.ones, self.spare, self.least, self.most = ones, spare, least, most

    def above(self, fan: int) -> Level:
        cut = np.arange(0, len(self.low), fan)
        return Level(
            np.bitwise_or.reduceat(self.bitmaps, cut), np.minimum.reduceat(self.low, cut), np.maximum.reduceat(self.high, cut),
            np.minimum.reduceat(self.ones, cut), np.maximum.reduceat(self.spare, cut),
            np.minimum.reduceat(self.least, cut), np.maximum.reduceat(self.most, cut),
        )

    def possible(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Pairs of nodes that may hold a linked pair of two components."""
        split = (self.least[i] != self.most[i]) | (self.least[i] != self.least[j]) | (self.least[j] != self.most[j])
        low, high = self.low, self.high
        split &= 100 * np.minimum(high[i], high[j]) >= percent * np.maximum(low[i], low[j])
        i, j, at = i[split], j[split], np.flatnonzero(split)
        shared = np.bitwise_count(self.bitmaps[i] & self.bitmaps[j]).sum(1, dtype=np.int64)
        # A set has at most ``spare`` more tokens than bits, and shares no token without its bit.
        overlap = np.minimum(shared + np.minimum(self.spare[i], self.spare[j]), np.minimum(high[i], high[j]))
        good = (100 + percent) * overlap >= percent * (low[i] + low[j])
        out = np.zeros(len(split), bool)
        out[at[good]] = True
        return out


def tree_pairs(
    sizes: np.ndarray, bitmaps: np.ndarray, comps: np.ndarray, cells: np.ndarray, s: Settings
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of a bucket that the dual traversal leaves: two components, enough overlap.

    The traversal goes down by blocks of pairs, the last one first, so that its memory does not
    follow the number of pairs. Leaves are then judged by the counts of their cells as well.
    """
    ones = np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
    order = np.lexsort((comps, sizes))
    leaf = Level(bitmaps[order], sizes[order], sizes[order], ones[order], (sizes - ones)[order], comps[order], comps[order])
    levels = [leaf]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above(s.fan))
    block, grid = max(1, BLOCK // s.fan**2), np.arange(s.fan)
    root = np.zeros(1, np.int64)
    waiting = [(len(levels) - 1, root, root)]
    while waiting:
        depth, i, j = waiting.pop()
        if len(i) > block:
            waiting.append((depth, i[:-block], j[:-block]))
            i, j = i[-block:], j[-block:]
        if depth:
            # Children of the pairs that are left; each unordered pair once.
            level = levels[depth - 1]
            n = len(level.low)
            x = (i[:, None, None] * s.fan + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
            y = (j[:, None, None] * s.fan + 0 * grid[None, :, None] + grid[None, None, :]).ravel()
            ok = (x < n) & (y < n) & (x <= y)
            x, y = x[ok], y[ok]
            ok = level.possible(x, y, s.percent)
            if ok.any():
                waiting.append((depth - 1, x[ok], y[ok]))
            continue
        ok = i != j
        i, j = order[i[ok]], order[j[ok]]
        overlap = most_shared(cells[i], cells[j], np.minimum(sizes[i], sizes[j]))
        good = (100 + s.percent) * overlap >= s.percent * (sizes[i] + sizes[j])
        if good.any():
            yield i[good], j[good]


def first_met(least: np.ndarray, i: np.ndarray, j: np.ndarray, token: int) -> np.ndarray:
    """Which pairs have no token below ``token`` in the lists of both."""
    out = np.ones(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        x, y = least[i[k : k + (1 << 14)]], least[j[k : k + (1 << 14)]]
        out[k : k + (1 << 14)] = ~((x[:, :, None] == y[:, None, :]) & (x < token)[:, :, None]).any((1, 2))
    return out


def bucket_pairs(members: DataFrame, s: Settings) -> DataFrame:
    """Candidate pairs of classes from buckets of (token, key, n, comp, signature, cells, least, count).

    A pair is judged alike in each bucket it meets in, so the bucket of a token leaves it out if the
    lists ``least`` of both name a smaller one: its bucket holds both and gives the pair.
    """
    tiles = F.ceil(F.col("count") / s.tile).cast("long")
    tiled = members.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    group = ["token", "low", "high"]
    rows = tiled.select(
        "token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key", "n", "comp", "signature", "cells", "least"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = rest[group].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(cut):
                yield from pairs(rest.iloc[: cut[-1]], cut[:-1])
                rest = rest.iloc[cut[-1] :].reset_index(drop=True)
        if rest is not None:
            yield from pairs(rest, np.zeros(0, np.int64))

    def pairs(frame: pd.DataFrame, cut: np.ndarray) -> Iterator[pd.DataFrame]:
        keys, sizes, comps = (frame[c].to_numpy(np.int64) for c in ("key", "n", "comp"))
        bitmaps = np.frombuffer(b"".join(frame["signature"]), np.uint64).reshape(len(frame), -1)
        cells = np.frombuffer(b"".join(frame["cells"]), np.uint8).reshape(len(frame), -1)
        tokens, least = frame["token"].to_numpy(np.int64), np.stack(frame["least"].to_numpy())
        out, held = [], 0
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(frame)]):
            for i, j in tree_pairs(sizes[a:b], bitmaps[a:b], comps[a:b], cells[a:b], s):
                new = first_met(least[a:b], i, j, tokens[a])
                out.append(np.sort(np.stack([keys[a + i[new]], keys[a + j[new]]], 1), 1))
                held += len(out[-1])
                if held >= BLOCK:
                    yield distinct(out)
                    out, held = [], 0
        if held:
            yield distinct(out)

    def distinct(found: list[np.ndarray]) -> pd.DataFrame:
        out = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    ordered = rows.repartition(*group).sortWithinPartitions(*group)
    return ordered.mapInPandas(run, "a long, b long").distinct()


def grouped_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """Row key, id, size of the set and group of each document; no group without words."""
    about = materialise(described(docs, common_tokens(docs, s), s), "jaccard-docs")
    meet = about.filter("n > 0").select(F.explode("first").alias("token"), "key")
    buckets = meet.groupBy("token").agg(F.min("key").alias("centre"), F.max("key").alias("top")).filter("centre != top").drop("top")
    # Both sides are shuffled for this join alone, so a frequent token's rows can be split.
    buckets = materialise(buckets, "jaccard-centres")
    members = materialise(meet.join(buckets, "token").distinct(), "jaccard-buckets")
    # Each class that meets another, with one of its rows.
    met = about.join(members.select("key").distinct(), "key", "left_semi")
    classes = materialise(
        met.groupBy("key").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.first("signature").alias("signature"), F.first("cells").alias("cells")),
        "jaccard-classes",
    )
    signs = classes.select("key", "n", "signature", "cells")
    stars = members.filter("key != centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    stars = materialise(likely(stars, signs, s), "jaccard-stars")
    links = materialise(linked(docs, classes, stars, s), "jaccard-first")
    comps = components(links, "jaccard-first")
    # Buckets that still hold several components besides the centre, all of whose pairs were stars.
    placed = members.filter("key != centre").select("token", "key").join(comps.withColumnRenamed("node", "key"), "key", "left")
    placed = materialise(placed.select("token", "key", F.coalesce("component", "key").alias("comp")), "jaccard-placed")
    split = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("count"))
    split = materialise(split.filter("low != high").select("token", "count"), "jaccard-split")
    open_ = placed.join(split, "token")
    listed = F.concat(F.sort_array(F.collect_set("token")), F.array_repeat(F.lit(NONE), LEAST))
    least = open_.groupBy("key").agg(F.slice(listed, 1, LEAST).alias("least"))
    # Written, as the join below would else be run on each pair as often as buckets gave it.
    found = materialise(bucket_pairs(open_.join(narrow(signs, s), "key").join(least, "key"), s), "jaccard-found")
    found = materialise(likely(found.join(stars, ["a", "b"], "left_anti"), signs, s), "jaccard-pairs")
    more = linked(docs, classes, found, s)
    comps = components(links.union(more), "jaccard-last").withColumnRenamed("node", "key")
    group = F.coalesce(F.col("component"), F.col("key"))
    return about.select("row", "doc_id", "n", "key").join(comps, "key", "left").select("row", "doc_id", "n", group.alias("group"))


def joined(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Id, size of the set and component of each document."""
    grouped = grouped_rows(docs, s)
    least = grouped.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    return grouped.join(least, "group", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def narrow(signs: DataFrame, s: Settings) -> DataFrame:
    """Signatures folded to the width of the trees."""

    @F.pandas_udf("binary")
    def fold(x: pd.Series) -> pd.Series:
        return pd.Series([folded(v, s.bits // 8).tobytes() for v in x], dtype=object)

    return signs.withColumn("signature", fold("signature"))


def likely(pairs: DataFrame, signs: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose sizes and whole signatures allow the threshold."""
    one = signs.select(F.col("key").alias("a"), F.col("signature").alias("x"), F.col("n").alias("nx"))
    two = signs.select(F.col("key").alias("b"), F.col("signature").alias("y"), F.col("n").alias("ny"))

    def fits(p: bytes, q: bytes, n: int, m: int) -> bool:
        size = min(len(p), len(q))
        p, q = folded(p, size), folded(q, size)
        shared, ones, twos = (int(np.bitwise_count(v).sum(dtype=np.int64)) for v in (p & q, p, q))
        overlap = min(shared + min(n - ones, m - twos), n, m)
        return (100 + s.percent) * overlap >= s.percent * (n + m)

    @F.pandas_udf("boolean")
    def allowed(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        return pd.Series([fits(*v) for v in zip(x, y, nx, ny)], dtype=bool)

    sized = pairs.join(one, "a").join(two, "b").filter(100 * F.least("nx", "ny") >= s.percent * F.greatest("nx", "ny"))
    return sized.filter(allowed("x", "y", "nx", "ny")).select("a", "b")


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of each component: that with the smallest id, null last, then the smallest hash.

    Equal rows, which have one hash of id and text, count once. Documents without words are linked
    with nothing and stay, repeated ones too.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    firsts = grouped_rows(docs, s).filter("group IS NOT NULL").groupBy("group").agg(first.alias("__row")).select("__row")
    spoken = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    rows = docs.filter(spoken).withColumn("__row", F.xxhash64("doc_id", "text"))
    kept = rows.join(firsts, "__row", "left_semi").dropDuplicates(["__row"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).union(docs.filter(~spoken).select(*columns))
