"""Removal of repeated passages with a sparse suffix array, refined bucket by bucket.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Every such
string holds one anchor: the leftmost place, in its first ``window`` places, whose gram has the
smallest hash. Equal strings have the same anchor, so only suffixes at anchors are sorted:

1. Buckets: anchors with equal cores, the bytes that all strings of an anchor share. An anchor
   alone in its bucket has no repeated string.
2. Classes: anchors of a bucket whose whole contexts (all of their strings) are equal. In a class
   of two or more every string is repeated; so it is for a bucket with one class only.
3. Refinement: the strings of the other classes are told apart by extending the core byte by byte
   to either side. The bucket after an extension is the sorted rank of (bucket before, byte), and
   a string's bucket is the pair of its left and right buckets: each pointer is computed once and
   used by all longer strings. Buckets of many classes do not fit one task; their strings are
   hashed and counted by Spark instead.

Texts are UTF-8 bytes; a null is empty. Rows are told apart by id and text, so a null id and equal
ids with different texts are fine, and an equal row is another place of the same strings. An empty
table gives no rows. Further columns are ignored by the digests and kept by ``without_repeats``.
Memory of a task follows the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.llm.common import materialise, slices, utf8
from govspark.llm.rolling import Ranges, bit, bitmap, contains, mixed


@dataclass(frozen=True)
class Settings:
    length: int = 400
    window: int = 200
    gram: int = 32
    #: Classes of a bucket that one task refines together.
    together: int = 20_000

    @property
    def core(self) -> int:
        return self.length - self.window + 1


def row_key(docs: DataFrame):
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def anchors_of(offsets: np.ndarray, data: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Anchors of some texts: row, first and last string start, anchor, hashes of core and context."""
    base, data = int(offsets[0]), data[offsets[0] : offsets[-1]]
    offsets, n = offsets - base, len(data)
    none = {k: np.zeros(0, np.int64) for k in ("row", "first", "last", "anchor", "core", "context")}
    if n < s.length:
        return none
    one = Ranges(data, 1)
    at = np.arange(n - s.gram + 1)
    order = (one(at, at + s.gram) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    # Smallest of each window: from the end of one block and the start of the next.
    pad = -len(order) % s.window
    grid = np.concatenate([order, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, s.window)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    rows = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - s.length + 1, 0))
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[rows]
    if not len(starts):
        return none
    anchor = (np.minimum(behind[starts], ahead[starts + s.window - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])]))
    last = np.append(new[1:], len(starts)) - 1
    first_start, last_start, anchor, row = starts[new], starts[last], anchor[new], rows[new]
    two = Ranges(data, 2)
    shape = ((anchor - first_start) << 32 | (last_start - first_start)).astype(np.uint64)
    context = mixed(two(first_start, last_start + s.length) ^ mixed(shape))
    origin = offsets[row]
    return {
        "row": row, "first": first_start - origin, "last": last_start - origin, "anchor": anchor - origin,
        "core": one(anchor, anchor + s.core).view(np.int64), "context": context.view(np.int64),
    }


def anchors(docs: DataFrame, s: Settings) -> DataFrame:
    """All anchors: key of the row, core, context, first and last string start, anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            offsets, data = utf8(batch.column(1))
            for a, b in slices(offsets):
                found = anchors_of(offsets[a : b + 1], data, s)
                columns = [pa.array(keys[a:b][found["row"]], pa.int64()), pa.array(found["core"]), pa.array(found["context"])]
                columns += [pa.array(found[c].astype(np.int32)) for c in ("first", "last", "anchor")]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "core", "context", "first", "last", "anchor"])

    rows = docs.select(row_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, core long, context long, first int, last int, anchor int")


def refined(frame: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Runs of repeated string starts of the classes with one member; ``frame`` holds whole buckets."""
    n = len(frame)
    data = frame["bytes"].tolist()
    left_room = (frame["anchor"] - frame["first"]).to_numpy()
    sizes = np.array([len(d) for d in data])
    joined = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    place = np.cumsum(sizes) - sizes + left_room  # of the anchor in the joined bytes
    right_room = sizes - left_room - s.core
    weight = np.minimum(frame["n"].to_numpy(), 2)
    bucket = np.unique(frame["core"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    spare = s.length - s.core

    def extend(room: np.ndarray, byte_at) -> np.ndarray:
        """Buckets after each number of bytes; -1 where the context ends before."""
        out = np.full((spare + 1, n), -1, np.int64)
        out[0] = bucket
        live = np.arange(n)
        for k in range(1, spare + 1):
            live = live[room[live] >= k]
            if not len(live):
                break
            out[k, live] = np.unique(out[k - 1, live] * 256 + joined[byte_at(live, k)], return_inverse=True)[1]
        return out

    left = extend(left_room, lambda rows, k: place[rows] - k)
    right = extend(right_room, lambda rows, k: place[rows] + s.core + k - 1)
    repeated = np.zeros((spare + 1, n), bool)
    for k in range(spare + 1):
        rows = np.flatnonzero((left[k] >= 0) & (right[spare - k] >= 0))
        if len(rows) > 1:
            same = np.unique(left[k, rows] * (n + 1) + right[spare - k, rows], return_inverse=True)[1]
            repeated[k, rows] = np.bincount(same, weight[rows])[same] >= 2
    # A string that begins k bytes before the anchor; only classes of one are still open.
    k, rows = np.nonzero(repeated & (weight == 1)[None, :])
    start = frame["anchor"].to_numpy()[rows] - k
    return pd.DataFrame({"key": frame["key"].to_numpy()[rows], "first": start, "last": start + s.length})


def duplicate_spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Byte ranges to remove, by key of the row; they may overlap."""
    found = materialise(anchors(docs, s), "suffix-anchors")
    buckets = found.groupBy("core").agg(
        F.count("*").alias("members"), F.min("context").alias("low"), F.max("context").alias("high")
    )
    # Written, so that the join below shuffles both sides for itself and can split frequent cores.
    buckets = materialise(buckets.filter("members > 1"), "suffix-buckets")
    shared = materialise(
        found.join(buckets, "core").withColumn("mixed", F.col("low") != F.col("high")).drop("members", "low", "high"),
        "suffix-shared",
    )
    span = ["key", F.col("first"), (F.col("last") + s.length).alias("last")]
    plain = shared.filter(~F.col("mixed")).select(*span)
    open_ = shared.filter("mixed")
    # One member of each class stands for it; which one does not matter.
    classes = open_.groupBy("core", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "anchor")).alias("one")
    )
    classes = materialise(classes.select("core", "context", "n", "one.*"), "suffix-classes")
    repeated = classes.filter("n > 1").select("core", "context")
    same = open_.join(repeated, ["core", "context"], "left_semi").select(*span)
    # Buckets in which a class has one member need the bytes of all their classes.
    counted = classes.groupBy("core").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("least = 1")
    needed = materialise(classes.join(counted.drop("least"), "core"), "suffix-open")
    with_bytes = materialise(contexts(docs, needed, s), "suffix-contexts")
    small = with_bytes.filter(F.col("classes") <= s.together)

    def refine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < 4000:
                continue
            rows = pd.concat(held, ignore_index=True)
            # The last bucket may go on in the next batch.
            complete = rows["core"] != rows["core"].iloc[-1]
            if complete.any():
                yield refined(rows[complete].reset_index(drop=True), s)
            held = [rows[~complete]]
        if held:
            yield refined(pd.concat(held, ignore_index=True), s)

    schema = "key long, first int, last int"
    tidy = small.repartition("core").sortWithinPartitions("core").mapInPandas(refine, schema)
    spans = plain.unionByName(same).unionByName(tidy).unionByName(counted_spans(with_bytes, s))
    # Equal rows share a key and bring the same spans: once each, so that lists of a key stay as long as one row's.
    return materialise(spans.distinct(), "suffix-spans")


def counted_spans(with_bytes: DataFrame, s: Settings) -> DataFrame:
    """The same for large buckets: every string is hashed, and strings are counted by Spark."""

    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                data = np.frombuffer(row.bytes, np.uint8)
                at = np.arange(len(data) - s.length + 1)
                yield pd.DataFrame(
                    {
                        "key": row.key, "first": row.first + at, "n": min(row.n, 2),
                        "one": Ranges(data, 3)(at, at + s.length).view(np.int64),
                        "two": Ranges(data, 4)(at, at + s.length).view(np.int64),
                    }
                )

    large = with_bytes.filter(F.col("classes") > s.together)
    hashed = large.mapInPandas(strings, "key long, first int, n int, one long, two long")
    twice = hashed.groupBy("one", "two").agg(F.sum("n").alias("places")).filter("places > 1").drop("places")
    left = hashed.filter("n = 1").join(twice, ["one", "two"], "left_semi")
    return left.select("key", "first", (F.col("first") + s.length).alias("last"))


def flagged(docs: DataFrame, bits: np.ndarray, digests: bool = False) -> DataFrame:
    """Key, id and text of each row; the text only of rows whose key may be in ``bits``.

    With ``digests`` all rows stay, with the number of bytes and the digest of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = contains(bits, batch.column(3).to_numpy())
            if not digests:
                yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["key", "doc_id", "text"]).filter(pa.array(hit))
                continue
            texts = [x or "" for x in batch.column(2).to_pylist()]
            raw = [None if h else x.encode() for x, h in zip(texts, hit)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2], pa.array([x if h else None for x, h in zip(texts, hit)], pa.string()),
                    pa.array([None if r is None else len(r) for r in raw], pa.int64()),
                    pa.array([None if r is None else hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                ],
                names=["key", "doc_id", "text", "plain_bytes", "plain_sha256"],
            )

    key = row_key(docs)
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), bit(key).alias("bit"))
    more = ", plain_bytes long, plain_sha256 string" if digests else ""
    return rows.mapInArrow(run, "key long, doc_id long, text string" + more)


def contexts(docs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The classes with the bytes of their contexts, from the rows that hold them."""
    texts = flagged(docs, bitmap(classes, "key")).select("key", "text").dropDuplicates(["key"])
    wanted = classes.groupBy("key").agg(F.collect_list(F.struct("core", "n", "classes", "first", "last", "anchor")).alias("wanted"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                data = row.text.encode()
                for w in row.wanted:
                    rows.append(
                        (row.key, w["core"], w["n"], w["classes"], w["first"], w["anchor"], data[w["first"] : w["last"] + s.length])
                    )
            yield pd.DataFrame(rows, columns=["key", "core", "n", "classes", "first", "anchor", "bytes"])

    return wanted.join(texts, "key").mapInPandas(
        cut, "key long, core long, n long, classes long, first int, anchor int, bytes binary"
    )


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the ranges; runs that touch are one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
    return first[new], last[np.append(new[1:], len(first)) - 1]


def _kept(data: bytes, spans) -> tuple[list[bytes], int]:
    first = np.array([x["first"] for x in spans], np.int64)
    last = np.array([x["last"] for x in spans], np.int64)
    a, b = merged(first, last)
    return [data[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)])], len(a)


def removal_digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Bytes, removed bytes, removed runs and digest of what is left, by document."""
    spans = duplicate_spans(docs, s)
    grouped = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = flagged(docs, bitmap(spans, "key"), digests=True).join(grouped, "key", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.text is None:
                    out.append((row.doc_id, int(row.plain_bytes), 0, 0, row.plain_sha256))
                    continue
                data = row.text.encode()
                parts, runs = _kept(data, row.spans) if row.spans is not None else ([data], 0)
                kept = b"".join(parts)
                out.append((row.doc_id, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows with repeated passages cut out of ``text``; characters cut in two go as well.

    ``n_chars``, where there is such a column, follows the text. A null text stays null.
    """
    spans = duplicate_spans(docs, s)
    grouped = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    rows = docs.withColumn("__key", row_key(docs)).join(grouped.withColumnRenamed("key", "__key"), "__key", "left")

    @F.pandas_udf(T.StringType())
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [t if x is None else b"".join(_kept(t.encode(), x)[0]).decode("utf-8", "ignore") for t, x in zip(text, found)], dtype=object
        )

    out = rows.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut("text", "__spans")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
