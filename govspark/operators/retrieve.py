"""Exact top-k retrieval by cosine similarity, routed by role, and context assembly."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from govspark import rules
from govspark.functions import detect
from govspark.operators.access import PERMISSIVE
from govspark.operators.joins import lookup_join
from govspark.session import scratch_dir

# The scoring function travels to the executors by value: they need numpy, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RAW, MASKED = "raw", "masked"

# Query vectors go to every task while all of them together stay below this size. Beyond it,
# blocks of queries are joined with the parts of the corpus that can hold one of their best.
MAX_QUERY_BYTES = 64 * 1024 * 1024
# Parts of a corpus: items by the nearest of so many of them. Sides of the blocks that meet.
PIVOTS = 256
BLOCK_ITEMS, BLOCK_QUERIES = 4096, 1024
# Angles and scores are compared with this margin, so that rounding never drops an item.
MARGIN = 1e-6
MERGE_BUCKETS = 64
# Scores of one step fill at most this many cells, however many queries there are.
SCORE_CELLS = 4_000_000
# Similarities that agree in this many digits are ties, as sums in floating point do not tell
# them apart; the result shows fewer digits than the ranking uses.
RANK_DIGITS = 12
SHOWN_DIGITS = 5


def corpus_of(role: Column) -> Column:
    """The permissive role reads the raw corpus, everybody else the masked one."""
    return F.when(role == PERMISSIVE, F.lit(RAW)).otherwise(F.lit(MASKED))


def visible_text(df: DataFrame, text: str, corpus: str = "corpus", out: str = "visible_text") -> DataFrame:
    """Add the text as the corpus holds it: raw, or redacted in the masked corpus."""
    masked = F.when(F.col(corpus) == MASKED, F.col(text))
    redacted = detect.redact(df.withColumn("_masked", masked), "_masked", "_masked")
    return redacted.withColumn(out, F.coalesce("_masked", text)).drop("_masked")


def centroids(vectors: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """The mean vector per group, as (group, embedding).

    Sums run per (group, position), so a large group is added up map side in every task.
    """
    parts = vectors.select(group, F.posexplode(embedding).alias("pos", "x"))
    means = parts.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(group).agg(F.transform(ordered, lambda p: p["x"]).alias("embedding"))


def _query_vectors(queries: DataFrame, query_id: str, embedding: str) -> tuple[list, np.ndarray] | None:
    """Query ids and unit vectors, or None if they are above the size limit."""
    wanted = queries.select(query_id, F.col(embedding).cast("array<double>").alias("v")).persist()
    try:
        size = wanted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
        if size["n"] * ((size["dim"] or 1) * 8 + 64) > MAX_QUERY_BYTES:
            return None
        rows = wanted.collect()
    finally:
        wanted.unpersist()
    return [r[0] for r in rows], _unit(np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), size["dim"] or 0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _score_partition(ids: list, unit_queries: np.ndarray, k: int, schema: pa.Schema):
    """Scores each batch against all queries and keeps a running top-k per query."""
    dim = unit_queries.shape[1]
    step = max(1, SCORE_CELLS // len(ids))
    scale = 10.0**RANK_DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_score = np.empty((len(ids), 0), dtype=np.int64)
        best_id = np.empty((len(ids), 0), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows = part.num_rows
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if flat.size != rows * dim:
                    raise ValueError(f"every corpus vector must have {dim} entries")
                items = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                by_id = np.argsort(items, kind="stable")
                items, unit = items[by_id], _unit(flat.reshape(rows, dim)[by_id])
                score = np.rint((unit_queries @ unit.T) * scale).astype(np.int64)
                doc = np.broadcast_to(items, score.shape)
                if rows > k:
                    # Scores are whole numbers here and positions follow the ids, so one
                    # integer orders by score first and id second: no full sort is needed.
                    rank = np.arange(rows) - score * rows
                    top = np.argpartition(rank, k - 1, axis=1)[:, :k]
                    score, doc = np.take_along_axis(score, top, axis=1), items[top]
                score = np.concatenate([best_score, score], axis=1)
                doc = np.concatenate([best_id, doc], axis=1)
                # Highest score first, smaller id among equals.
                order = np.lexsort((doc, -score), axis=1)[:, :k]
                best_score = np.take_along_axis(score, order, axis=1)
                best_id = np.take_along_axis(doc, order, axis=1)
        if best_score.shape[1]:
            width = best_score.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(ids), dtype=np.int64), width)),
                    pa.array(best_id.ravel()),
                    pa.array(best_score.ravel() / scale),
                ],
                schema=schema,
            )

    return run


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str = "query_id",
    item_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = rules.INVOKE_TOP_K,
) -> DataFrame:
    """The k most similar corpus items per query: (query_id, rank, item_id, similarity).

    Exact. Up to ``MAX_QUERY_BYTES`` of query vectors, every task scores its share of the corpus
    against all of them with one matrix product per batch and emits at most k rows per query, so no
    query-corpus pair is ever materialised. More queries go block by block to the parts of the
    corpus they need, see ``_blocked_scores``. The winners are merged in two steps to keep the last
    one small. Query ids are unique.
    """
    spark = corpus.sparkSession
    schema = pa.schema([("q", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64())])
    vectors = corpus.select(F.col(item_id).cast("long").alias("item"), embedding).filter(
        F.col(embedding).isNotNull()
    )
    id_type = queries.schema[query_id].dataType
    held = _query_vectors(queries, query_id, embedding)
    if held is None:
        asked = queries.select(F.col(query_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        vectors = vectors.select("item", F.col(embedding).cast("array<double>").alias("v"))
        scored = _blocked_scores(asked.filter("v IS NOT NULL"), vectors, k).withColumnRenamed("id", query_id)
    else:
        ids, unit = held
        lookup = spark.createDataFrame(
            list(enumerate(ids)), T.StructType([T.StructField("q", T.LongType()), T.StructField(query_id, id_type)])
        )
        schema_text = "q long, item long, similarity double"
        if ids:
            part = vectors.mapInArrow(_score_partition(ids, unit, k, schema), schema_text)
        else:
            part = spark.createDataFrame([], schema_text)
        scored = part.join(lookup, "q").select(query_id, "item", "similarity")
    best = _best(scored, query_id, k)
    return best.select(query_id, "rank", F.col("item").alias(item_id), F.round("similarity", SHOWN_DIGITS).alias("similarity"))


def _best(scored: DataFrame, query_id: str, k: int) -> DataFrame:
    """The k best rows of each query, ranked: first per bucket of items, then of all."""
    best = [F.desc("similarity"), F.asc("item")]
    bucket = F.pmod(F.xxhash64("item"), F.lit(MERGE_BUCKETS))
    first = Window.partitionBy(query_id, "_bucket").orderBy(*best)
    final = Window.partitionBy(query_id).orderBy(*best)
    return (
        scored.withColumn("_bucket", bucket)
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .drop("_bucket")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size != len(column) * dim:
        raise ValueError(f"every vector must have {dim} entries")
    return flat.reshape(len(column), dim)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _placed(pivots: np.ndarray):
    """Items with the part of their nearest pivot and the angle to it; vectors of zeros have part -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), pivots.shape[1]))
            angles = _angles(unit, pivots)
            part = np.where(unit.any(axis=1), angles.argmin(axis=1), -1)
            arrays = [pa.array(part), pa.array(angles.min(axis=1)), batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "angle", "id", "v"])

    return run


def _blocks(rows: DataFrame, dim: int, height: int, id_type: str) -> DataFrame:
    """(part, angle, ids, vectors): unit vectors of a part in blocks of ``height``, with the widest angle.

    Rows of a part are spread over several tasks, and a task holds one block at a time.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            together = pa.concat_batches(held)
            ids = pa.ListArray.from_arrays(pa.array([0, together.num_rows], pa.int32()), together.column("id"))
            vectors = _unit(_matrix(together.column("v"), dim)).tobytes()
            angle = together.column("angle").to_numpy().max()
            arrays = [together.column("part").slice(0, 1), pa.array([angle]), ids, pa.array([vectors], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "angle", "ids", "vectors"])

        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for first, last in zip(edges[:-1], edges[1:]):
                if held and held[0].column("part")[0].as_py() != part[first]:
                    yield block()
                    held.clear()
                while first < last:
                    size = min(last - first, height - sum(b.num_rows for b in held))
                    held.append(batch.slice(first, size))
                    first += size
                    if sum(b.num_rows for b in held) == height:
                        yield block()
                        held.clear()
        if held:
            yield block()

    spread = rows.withColumn("_deal", F.pmod(F.xxhash64("id"), F.lit(32))).repartition("part", "_deal")
    ordered = spread.sortWithinPartitions("part").select("part", "angle", "id", "v")
    return ordered.mapInArrow(packed, f"part long, angle double, ids array<{id_type}>, vectors binary")


def _sent(pivots: np.ndarray, radius: np.ndarray, nearest: bool):
    """Queries with each part they have to see: the nearest one, or all whose bound reaches the k-th score.

    No item of a part is nearer to a query than their pivot's angle less the part's radius. Queries
    of zeros score 0 everywhere, and so do items of zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), pivots.shape[1]))
            angles = _angles(unit, pivots)
            if nearest:
                angles[:, radius[1:] < 0] = np.inf
                rows, parts = np.arange(len(unit)), angles.argmin(axis=1)
            else:
                bound = np.cos(np.maximum(0, angles - radius[1:] - MARGIN))
                bound[~unit.any(axis=1)] = 0
                bound = np.concatenate([np.zeros((len(unit), 1)), bound], axis=1)
                reached = bound + MARGIN >= batch.column("least").to_numpy()[:, None]
                rows, parts = np.nonzero(reached & (radius >= 0))
                parts = parts - 1
            ids, vectors = (batch.column(c).take(pa.array(rows)) for c in ("id", "v"))
            arrays = [pa.array(parts.astype(np.int64)), pa.array(np.zeros(len(rows))), ids, vectors]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "angle", "id", "v"])

    return run


def _met(dim: int, k: int):
    """The k best items of a block for each query of a block."""
    scale = 10.0**RANK_DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, items = batch.column("ids")[r].values, batch.column("items")[r].values.to_numpy()
                asked = np.frombuffer(batch.column("asked")[r].as_py()).reshape(-1, dim)
                unit = np.frombuffer(batch.column("vectors")[r].as_py()).reshape(-1, dim)
                by_id = np.argsort(items, kind="stable")
                items, unit = items[by_id], unit[by_id]
                score = np.rint((asked @ unit.T) * scale).astype(np.int64)
                width = min(k, len(items))
                rank = np.arange(len(items)) - score * len(items)
                top = np.argpartition(rank, width - 1, axis=1)[:, :width]
                score = np.take_along_axis(score, top, axis=1)
                arrays = [ids.take(pa.array(np.repeat(np.arange(len(asked)), width))), pa.array(items[top].ravel()), pa.array(score.ravel() / scale)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "item", "similarity"])

    return run


def _blocked_scores(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(id, item, similarity) with the k best items of each query (id, v), and some more.

    Items belong to the part of the nearest of ``PIVOTS`` sampled ones. A query first meets its
    nearest part, which bounds its k-th score from below, and then only the parts that may hold a
    better item. Blocks of both sides meet in a join on the part, which adaptive execution splits
    where a part is large; a task holds one pair of blocks. On the driver are the pivots and the
    parts' radii.
    """
    spark = queries.sparkSession
    place = scratch_dir(spark, "blocked-top-k")
    sample = items.filter("exists(v, x -> x != 0)").orderBy(F.xxhash64("item"), "item").limit(PIVOTS).select("v").collect()
    dim = len(sample[0]["v"]) if sample else queries.agg(F.max(F.size("v"))).first()[0]
    pivots = _unit(np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), dim)) if sample else np.eye(1, dim)
    id_type = queries.schema["id"].dataType.simpleString()
    row = "part long, angle double, id {}, v array<double>"
    placed = items.selectExpr("item AS id", "v").mapInArrow(_placed(pivots), row.format("long"))
    _blocks(placed, dim, BLOCK_ITEMS, "long").write.parquet(place)
    blocks = spark.read.parquet(place).withColumnRenamed("ids", "items")
    radius = np.full(len(pivots) + 1, -1.0)
    for r in blocks.groupBy("part").agg(F.max("angle").alias("angle")).collect():  # one row per part
        radius[r["part"] + 1] = max(0.0, r["angle"])

    def scores(asked: DataFrame, nearest: bool) -> DataFrame:
        sent = asked.mapInArrow(_sent(pivots, radius, nearest), row.format(id_type))
        sent = _blocks(sent, dim, BLOCK_QUERIES, id_type).select("part", "ids", F.col("vectors").alias("asked"))
        pairs = blocks.join(sent, "part").select("ids", "items", "asked", "vectors")
        return pairs.mapInArrow(_met(dim, k), f"id {id_type}, item long, similarity double")

    first = _best(scores(queries, True), "id", k).groupBy("id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    least = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0))
    known = queries.join(first, "id", "left").select("id", "v", F.coalesce(least, F.lit(-2.0)).alias("least"))
    return scores(known, False)


def routed_top_k(
    queries: DataFrame, corpora: dict[str, DataFrame], role: str = "role", query_id: str = "query_id", **options
) -> DataFrame:
    """Top-k of each query over the corpus its role may read."""
    routed = queries.withColumn("corpus", corpus_of(F.col(role))).persist()
    parts = [
        top_k(routed.filter(F.col("corpus") == name), corpus, query_id, **options).withColumn("corpus", F.lit(name))
        for name, corpus in corpora.items()
    ]
    routed.unpersist()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_text(cells: Column) -> Column:
    """``name: value`` pairs joined by commas; cells without a name or value are skipped.

    ``cells`` is an array of (columnName, columnValue). No cell left gives an empty text.
    """
    parts = F.transform(cells, lambda c: F.concat(c["columnName"], F.lit(": "), c["columnValue"]))
    return F.array_join(parts, ", ")


def content_text(content: Column, row_first: bool) -> Column:
    """The text of one retrieval hit, null when it is empty.

    A hit has a row of cells or a text. Where both exist, ``row_first`` decides which is read;
    the other one is then ignored, even if the first turns out empty.
    """
    row, text = content["row"], content["text"]
    if row_first:
        chosen = F.when(row.isNotNull(), row_text(row)).otherwise(text)
    else:
        chosen = F.when(text.isNotNull(), text).otherwise(row_text(row))
    return F.nullif(chosen, F.lit(""))


def assemble_context(
    hits: DataFrame,
    query_id: str = "query_id",
    rank: str = "rank",
    content: str = "content",
    row_first: bool = True,
    separator: str = "\n",
    max_chars: int | None = rules.MAX_CONTEXT_CHARS,
) -> DataFrame:
    """Join the hits of a query in rank order: (query_id, parts, context).

    ``hits`` comes from a top-k, so a group has at most k rows and may be collected.
    """
    text = content_text(F.col(content), row_first)
    parts = hits.select(query_id, rank, text.alias("part")).groupBy(query_id).agg(
        F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct(rank, "part")))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), separator)
    if max_chars is not None:
        joined = F.left(joined, F.lit(max_chars))
    return parts.select(query_id, F.size("parts").alias("parts"), joined.alias("context"))


def invoke_context(hits: DataFrame, query_id: str = "query_id", **names) -> DataFrame:
    """Rows before texts, one line per hit, cut to the context limit."""
    return assemble_context(hits, query_id, row_first=True, separator="\n", **names)


def retrieve_context(hits: DataFrame, query_id: str = "query_id", **names) -> DataFrame:
    """Texts before rows, a blank line between hits, not cut."""
    return assemble_context(hits, query_id, row_first=False, separator="\n\n", max_chars=None, **names)


def with_context_status(queries: DataFrame, contexts: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Contexts onto queries. A query without context is flagged, never answered."""
    # The flag is made before the join, so a caller that drops the texts does not move them.
    flagged = contexts.select(query_id, "context", (F.length("context") > 0).alias("_has"))
    joined = lookup_join(queries, flagged, query_id)
    missing = ~F.coalesce("_has", F.lit(False))
    return joined.withColumns(
        {
            "context_status": F.when(missing, F.lit("no_context")).otherwise(F.lit("ok")),
            "fallback_reply": F.when(missing, F.lit(rules.NO_CONTEXT_REPLY)),
        }
    ).drop("_has")
