"""Exact top-k search by inner product, block at a time.

Vectors, sorted by id, are cut into blocks: ranges of documents with a forward index (the integer
components, row by row) and the largest and smallest component of each dimension. For a query the
sum of the largest products per dimension bounds every score in a block. Each query takes its
blocks in the order of these bounds, scores a block through its forward index, and stops when the
next bound is below its k-th score so far.

Blocks are gathered into shards of a fixed number of blocks, and queries into batches of a fixed
number. A task holds one shard and lets the batches pass by one after the other, so memory is
bounded. The extremes of a shard's dimensions are kept in a small table. Every batch first
searches the shard with the largest bounds; the scores found there are the starting point in all
others. A batch is sent only to shards whose bound reaches the k-th score of one of its queries,
and there a block whose bound is below the k-th score is not scored. At most k rows per query and
shard leave a task. Bounds are computed where pages of shards meet groups of batches, both of a
fixed size.

Components beyond the range of a long count as the end of that range, and so do scores; sums are
exact in between. Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null
id. Vectors of different lengths are padded with zeros. A candidate with the query's own id is the
query's own; a repeated query row has its own result, repeated candidates are ranked each.
Ties go to the smaller id. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.llm.common import materialise

BLOCK = 1024
SHARD_BLOCKS = 16
BATCH = 256
#: Shards of a page and batches of a group, which meet in one step to be bounded.
PAGE = 1024
GROUP = 64
HIGHEST = np.iinfo(np.int64).max
LOWEST = -HIGHEST


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """Ids and integer components of the vectors that take part."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x")
    ).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.filter(finite).select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v"))


def packed(rows: list, width: int = 0) -> tuple[int, str, bytes]:
    """Rows of components, padded with zeros, in the narrowest integers."""
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    most = max(int(out.max(initial=0)), -int(out.min(initial=0)))
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if t == "<i8" or most < np.iinfo(t).max)
    return width, kind, out.astype(kind).tobytes()


def unpacked(ids: bytes, width: int, kind: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(data, kind).astype(np.int64).reshape(len(ids), width)


def gathered(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a task in turn, ``size`` in one: number in the task, ids and components."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, ids, held = TaskContext.get().partitionId(), 0, [], []

        def one() -> pd.DataFrame:
            width, kind, data = packed(held)
            line = [part, number, width, kind, np.array(ids, "<i8").tobytes(), data]
            return pd.DataFrame([line], columns=["part", "number", "width", "kind", "ids", "data"])

        for frame in frames:
            for i, v in zip(frame["vec_id"], frame["v"]):
                ids.append(i)
                held.append(v)
                if len(ids) == size:
                    yield one()
                    number, ids, held = number + 1, [], []
        if ids:
            yield one()

    return rows.mapInPandas(run, "part int, number int, width int, kind string, ids binary, data binary")


def product(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point only where every sum is exact in it."""
    width = min(q.shape[1], b.shape[1])
    q, b = q[:, :width], b[:, :width]
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(width, 1)
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return q @ b.T
    return np.clip(q.astype(object) @ b.T.astype(object), LOWEST + 1, HIGHEST - 1).astype(np.int64)


def bounded(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Largest possible score of each query with vectors between the rows of ``high`` and ``low``."""
    width = min(queries.shape[1], high.shape[1])
    queries, high, low = queries[:, :width], high[:, :width], low[:, :width]
    return product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1), np.concatenate([high, low], 1))


def search(queries: np.ndarray, own: np.ndarray, known: np.ndarray, parts: list, k: int) -> list:
    """Scores and ids, best first, that a shard's blocks add to the ``k`` best of each query.

    ``known`` holds the best scores and ids of each query so far, filled up with the lowest number.
    ``parts`` are (ids, components) of the blocks.
    """
    n = len(queries)
    bounds = np.empty((n, len(parts)), np.int64)
    for j, (_, data) in enumerate(parts):
        bounds[:, j] = bounded(queries, data.max(0, keepdims=True), data.min(0, keepdims=True))[:, 0]
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = [(s, i, np.zeros(len(s), bool)) for s, i in zip(known[:, 0], known[:, 1])]
    kth = known[:, 0, -1].copy()
    for turn in range(len(parts)):
        at = order[:, turn]
        # A block whose bound equals the k-th score may hold a tie with a smaller id.
        live = np.flatnonzero(bounds[np.arange(n), at] >= kth)
        if not len(live):
            break
        for j in np.unique(at[live]):
            rows = live[at[live] == j]
            ids, data = parts[j]
            for r, scores in zip(rows.tolist(), product(queries[rows], data)):
                take = np.flatnonzero((scores >= kth[r]) & (ids != own[r]))
                if len(take):
                    s, i, new = best[r]
                    s, i = np.concatenate([s, scores[take]]), np.concatenate([i, ids[take]])
                    first = np.lexsort((i, -s))[:k]
                    best[r] = s[first], i[first], np.concatenate([new, np.ones(len(take), bool)])[first]
                    kth[r] = s[first[-1]]
    return [(s[new], i[new]) for s, i, new in best]


def _round(batches: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """Every batch against the shard at its ``place``."""
    none = F.lit(None).cast("binary")
    blocks = shards.select("place", F.lit(0).alias("what"), F.col("number").cast("long").alias("id"), "width", "kind", "ids", "data", none.alias("known"))
    asked = batches.select("place", F.lit(1).alias("what"), F.col("batch").alias("id"), "width", "kind", "ids", "data", "known")
    together = blocks.unionByName(asked).repartition("place").sortWithinPartitions("place", "what", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, parts, empty = None, [], np.zeros((0, 0), np.int64)
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.place != place:
                    place, parts = row.place, []
                ids, data = unpacked(row.ids, row.width, row.kind, row.data)
                if row.what == 0:
                    parts.append((ids, data))
                    continue
                known = np.full((len(ids), 2, k), LOWEST, np.int64)
                known[:, 1] = HIGHEST
                if row.known is not None:
                    known = np.frombuffer(row.known, "<i8").reshape(len(ids), 2, k)
                found = search(data, ids, known, parts, k) if parts else [(empty[:0], empty[:0])] * len(ids)
                sizes = [len(s) for s, _ in found]
                yield pd.DataFrame(
                    {
                        "batch": np.full(sum(sizes), row.id, np.int64),
                        "n": np.repeat(np.arange(len(ids)), sizes),
                        "query_id": np.repeat(ids, sizes),
                        "score": np.concatenate([s for s, _ in found]) if sum(sizes) else np.zeros(0, np.int64),
                        "vec_id": np.concatenate([i for _, i in found]) if sum(sizes) else np.zeros(0, np.int64),
                    }
                )

    return together.mapInPandas(run, "batch long, n long, query_id long, score long, vec_id long")


def _carried(batches: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Batches with the scores and ids found for their queries, as bytes."""

    def run(key: tuple, batch: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = batch.copy()
        for at, ids in enumerate(batch["ids"]):
            known = np.full((len(ids) // 8, 2, k), LOWEST, np.int64)
            known[:, 1] = HIGHEST
            ordered = found.sort_values(["n", "score", "vec_id"], ascending=[True, False, True])
            place = ordered.groupby("n").cumcount().to_numpy()
            known[ordered["n"], 0, place] = ordered["score"]
            known[ordered["n"], 1, place] = ordered["vec_id"]
            out.at[out.index[at], "known"] = known.astype("<i8").tobytes()
        return out

    # A group is one batch: a fixed number of queries and at most k rows found for each.
    return batches.groupBy("batch").cogroup(first.groupBy("batch")).applyInPandas(run, batches.schema)


def extremes(shards: DataFrame) -> DataFrame:
    """Width, largest and smallest component of each dimension, of each shard: one small row each."""

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [unpacked(*row)[1] for row in zip(frame["ids"], frame["width"], frame["kind"], frame["data"])]
            ends = [(x.max(0).astype("<i8").tobytes(), x.min(0).astype("<i8").tobytes()) for x in found]
            yield pd.DataFrame({"place": frame["place"], "width": frame["width"], "high": [h for h, _ in ends], "low": [x for _, x in ends]})

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        high, low = (rows_of(frame[c], frame["width"]) for c in ("high", "low"))
        # Shorter vectors are padded with zeros.
        line = [frame["place"].iloc[0], high.shape[1], high.max(0).astype("<i8").tobytes(), low.min(0).astype("<i8").tobytes()]
        return pd.DataFrame([line], columns=["place", "width", "high", "low"])

    kinds = "place int, width int, high binary, low binary"
    # A group is one shard: SHARD_BLOCKS rows.
    return shards.select("place", "width", "kind", "ids", "data").mapInPandas(block, kinds).groupBy("place").applyInPandas(shard, kinds)


def rows_of(data: pd.Series, width: pd.Series) -> np.ndarray:
    out = np.zeros((len(data), max(width, default=0)), np.int64)
    for row, x in zip(out, data):
        row[: len(x) // 8] = np.frombuffer(x, "<i8")
    return out


def reached(batches: DataFrame, ends: DataFrame, pages: int, groups: int, k: int, best: bool) -> DataFrame:
    """Shards whose bound reaches the k-th score of a query of a batch, or the best of each page: batch, place, bound.

    Pages of shards meet groups of batches, so that each meeting holds a page and one batch at a time.
    """
    none = F.lit(None)
    group = F.pmod(F.xxhash64("batch"), F.lit(groups)).cast("int")
    asked = batches.select(
        F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"), group.alias("group"), F.lit(1).alias("what"), F.col("batch").alias("id"),
        "width", "kind", "ids", "data", "known", none.cast("binary").alias("high"), none.cast("binary").alias("low"),
    )
    listed = ends.select(
        F.floor(F.col("place") / PAGE).cast("int").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(0).alias("what"), F.col("place").cast("long").alias("id"), "width", none.cast("string").alias("kind"),
        *[none.cast("binary").alias(c) for c in ("ids", "data", "known")], "high", "low",
    )
    together = listed.unionByName(asked).repartition("page", "group").sortWithinPartitions("page", "group", "what", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, high = None, [], None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.page, row.group) != at:
                    at, rows, high = (row.page, row.group), [], None
                if row.what == 0:
                    rows.append((row.id, row.width, row.high, row.low))
                    continue
                if high is None:
                    places, widths, *sides = zip(*rows)
                    places, (high, low) = np.array(places, np.int64), (rows_of(x, widths) for x in sides)
                ids, data = unpacked(row.ids, row.width, row.kind, row.data)
                bounds = bounded(data, high, low)
                total = bounds.astype(np.float64).sum(0)
                if best:
                    take = np.array([total.argmax()])
                else:
                    kth = np.frombuffer(row.known, "<i8").reshape(len(ids), 2, k)[:, 0, -1]
                    take = np.flatnonzero((bounds >= kth[:, None]).any(0))
                yield pd.DataFrame({"batch": np.full(len(take), row.id, np.int64), "place": places[take].astype(np.int32), "bound": total[take]})

    return together.mapInPandas(run, "batch long, place int, bound double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """The ``k`` candidates with the highest score of each query row: query_id, rank, vec_id, score."""
    rows = quantised(vectors, scale)
    ranged = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    stored = materialise(gathered(ranged, BLOCK), "topk-blocks")
    shard = F.floor(F.col("number") / SHARD_BLOCKS)
    # One row per shard, thousands of vectors each: a small table, and a window over it.
    listed = stored.select("part", shard.alias("shard")).distinct()
    places = listed.withColumn("place", F.row_number().over(Window.orderBy("part", "shard")) - 1)
    shards = materialise(stored.withColumn("shard", shard).join(places, ["part", "shard"]), "topk-shards")
    batches = materialise(
        gathered(rows.filter(is_query), BATCH).select(
            (F.col("part").cast("long") * (1 << 32) + F.col("number")).alias("batch"),
            "width", "kind", "ids", "data", F.lit(None).cast("binary").alias("known"),
        ),
        "topk-queries",
    )
    ends = materialise(extremes(shards), "topk-extremes")
    pages = int(shards.agg(F.max("place")).first()[0] or 0) // PAGE + 1
    groups = -(-batches.count() // GROUP) or 1
    likeliest = F.max_by("place", F.struct("bound", -F.col("place"))).alias("home")
    homes = reached(batches, ends, pages, groups, k, best=True).groupBy("batch").agg(likeliest)
    homes = materialise(batches.join(homes, "batch"), "topk-homes")
    first = materialise(_round(homes.withColumn("place", F.col("home")), shards, k), "topk-first")
    carried = materialise(_carried(homes, first, k), "topk-carried")
    sent = reached(carried, ends, pages, groups, k, best=False).select("batch", "place")
    rest = carried.join(sent, "batch").filter(F.col("place") != F.col("home"))
    best = Window.partitionBy("batch", "n").orderBy(F.desc("score"), "vec_id")
    found = first.unionByName(_round(rest, shards, k)).withColumn("rank", F.row_number().over(best))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
