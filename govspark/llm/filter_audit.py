"""Filter interaction audit: what each of five filters removes, alone and in every order.

The texts become a sparse matrix of documents by words in shards of compressed rows (CSR). Words
have global numbers: each shard lists its distinct words, all lists together make the dictionary,
and its numbers come back to the shards. The sum of a row is a document's number of words and its
nonzero entries are the distinct ones; they decide filters A and B. C and D come from the bytes of
the same batch, E from digests of whole texts.

Documents are then counted by digest and flags, so that any number of copies is one row, and by
part and pattern of failed filters. Orders are applied to patterns, never to documents.

A null text is empty, a null part is ''. A null id is neither smaller nor larger than another one:
its document is no copy, has no label and makes no other a copy. Rows repeated with one id count
each; none of them is a copy of the others. An id with several labels has a label if any row of it
says so. Parts without documents do not exist; an empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.llm import shards
from govspark.llm.common import materialise, utf8

LETTERS = "ABCDE"
#: Bytes that filter D does not accept.
MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))


@dataclass(frozen=True)
class Limits:
    """Parameters of the filters."""

    least_words: int = 200
    least_distinct_percent: int = 50
    most_upper_percent: int = 3


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards whose columns are places among their own words."""
    number = shards.numbers()
    for batch in shards.gathered(batches):
        offsets, data = utf8(batch.column("text"))
        counts, words = shards.split(offsets, data, shards.NOT_SPACE, shards.AS_IS)
        codes, distinct = shards.by_hash(*shards.coded(words))
        rows = np.repeat(np.arange(len(counts)), counts)
        cells, times = np.unique(rows * max(1, len(distinct)) + codes, return_counts=True)
        row, column = np.divmod(cells, max(1, len(distinct)))
        bounds = np.searchsorted(row, np.arange(len(counts) + 1))
        # Steps between columns of a row are small numbers, which compress well.
        steps = np.diff(column, prepend=0)
        steps[bounds[:-1][bounds[:-1] < len(column)]] = column[bounds[:-1][bounds[:-1] < len(column)]]

        def sums(hits: np.ndarray) -> np.ndarray:
            upto = np.append(0, np.cumsum(hits[data[offsets[0] : offsets[-1]]]))
            return np.diff(upto[offsets - offsets[0]])

        upper, points = sums(_UPPER), sums(_LEADING)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([next(number)], pa.int64()),
                pa.array([shards.packed_words(distinct)], pa.binary()),
                pa.array([len(distinct)], pa.int64()),
                pa.array([shards.packed(bounds.astype(np.int64))], pa.binary()),
                pa.array([shards.packed(steps.astype(np.int32))], pa.binary()),
                pa.array([shards.packed(times.astype(np.int32))], pa.binary()),
                shards.listed(batch.column("row")),
                shards.listed(pa.array(upper)),
                shards.listed(pa.array(points)),
                shards.listed(pa.array(sums(MARKS) > 0)),
            ],
            names=["shard", "words", "distinct", "bounds", "steps", "times", "rows", "upper", "points", "marked"],
        )


_UPPER = np.isin(np.arange(256), np.arange(65, 91))
#: First bytes of code points.
_LEADING = (np.arange(256) & 0xC0) != 0x80
_ROW = "struct<doc_id:bigint,part:string,digest:binary>"
_SHARD = (
    f"shard long, words binary, distinct long, bounds binary, steps binary, times binary, rows array<{_ROW}>,"
    "upper array<bigint>, points array<bigint>, marked array<boolean>"
)


def _numbered(chunks: pa.Table) -> pa.Table:
    """Words of a bucket numbered in their order; numbers of buckets lie apart."""
    words = [shards.unpacked_words(x.as_py()) for x in chunks["words"]]
    codes, distinct = shards.coded(pa.concat_arrays(words))
    place = np.empty(len(distinct), np.int64)
    place[pc.sort_indices(distinct).to_numpy()] = np.arange(len(distinct))
    value = (chunks["bucket"][0].as_py() << 32) + place[codes]
    parts = np.split(value, np.cumsum([len(w) for w in words])[:-1])
    return pa.table({"shard": chunks["shard"], "bucket": chunks["bucket"], "values": pa.array([shards.packed(v) for v in parts], pa.binary())})


def dictionary(local: DataFrame) -> DataFrame:
    """(shard, bucket, values): the global numbers of each shard's words, the same for equal words."""
    return shards.met(local, _numbered, "shard long, bucket long, values binary")


def _global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in a shard's own list become numbers of the dictionary; columns of a row ascend."""
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            bounds = shards.unpacked(batch.column("bounds")[k].as_py(), np.int64)
            steps = shards.unpacked(batch.column("steps")[k].as_py(), np.int32).astype(np.int64)
            times = shards.unpacked(batch.column("times")[k].as_py(), np.int32)
            numbers = shards.attached(batch.column("values"), k)
            # Sums of steps over all rows, less what the rows before have summed up to.
            upto = np.append(0, np.cumsum(steps))
            rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            place = upto[1:] - upto[bounds[:-1]][rows]
            columns = numbers[place]
            order = np.lexsort((columns, rows))
            out.append((shards.packed(columns[order]), shards.packed(times[order])))
        arrays = {n: batch.column(n) for n in ("shard", "bounds", "rows", "upper", "points", "marked")}
        arrays |= {"columns": pa.array([c for c, _ in out], pa.binary()), "counts": pa.array([t for _, t in out], pa.binary())}
        yield pa.RecordBatch.from_pydict(arrays)


def matrix(docs: DataFrame, part: str = "lang") -> DataFrame:
    """CSR shards of the documents: bounds of rows, global columns and counts, with the rows' keys.

    ``bounds`` and ``columns`` are packed 64-bit numbers, ``counts`` 32-bit ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    local = materialise(docs.select(text.alias("text"), key.alias("row")).mapInArrow(_local, _SHARD), "local-shards")
    # The words themselves are not needed any more.
    numbered = shards.attach(local.drop("words", "distinct"), dictionary(local))
    return numbered.mapInArrow(
        _global,
        f"shard long, bounds binary, rows array<{_ROW}>, upper array<bigint>, points array<bigint>, marked array<boolean>,"
        "columns binary, counts binary",
    )


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            bounds = shards.unpacked(batch.column("bounds")[k].as_py(), np.int64)
            counts = shards.unpacked(batch.column("counts")[k].as_py(), np.int32)
            upto = np.append(0, np.cumsum(counts, dtype=np.int64))
            rows = batch.column("rows")[k].values
            yield pa.RecordBatch.from_arrays(
                [*rows.flatten(), pa.array(np.diff(upto[bounds])), pa.array(np.diff(bounds))]
                + [batch.column(n)[k].values for n in ("upper", "points", "marked")],
                names=["doc_id", "part", "digest", "n_words", "n_distinct", "upper", "points", "marked"],
            )


def row_totals(csr: DataFrame) -> DataFrame:
    """A row per document: sum and nonzero entries of its row, and what its bytes say."""
    return csr.mapInArrow(
        _totals,
        "doc_id long, part string, digest binary, n_words long, n_distinct long, upper long, points long, marked boolean",
    )


def patterns(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """(part, pattern, n, good, toxic): documents by the set of filters they fail, A as bit 1."""
    failed = [
        F.col("n_words") < limits.least_words,
        100 * F.col("n_distinct") < limits.least_distinct_percent * F.col("n_words"),
        100 * F.col("upper") > limits.most_upper_percent * F.col("points"),
        F.col("marked"),
    ]
    flags = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0)).alias("flags")
    rows = row_totals(matrix(docs, part)).select("doc_id", "part", "digest", flags)
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    no = F.lit(False)
    rows = rows.join(said, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    # Rows of one id first, then rows of one digest that are alike: copies are one row from here on.
    alike = ["digest", "flags", "part", "good", "toxic"]
    by_id = rows.groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    groups = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.min(known).alias("first"), nameless)
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # rows of a digest: parts times labels
    firsts = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0) + F.col("nameless")
    groups = groups.withColumn("firsts", firsts)
    last = F.lit(1 << 4)
    split = F.explode(
        F.array(
            F.struct(F.col("flags").alias("pattern"), F.col("firsts").alias("n")),
            F.struct((F.col("flags") + last).alias("pattern"), (F.col("n") - F.col("firsts")).alias("n")),
        )
    )
    counted = groups.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.pattern", "s.n")
    return counted.groupBy("part", "pattern").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def _steps() -> Column:
    """All orders of the filters with their steps: letters before and the letter itself as bits."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for k, letter in enumerate(order):
            rows.append((("".join(LETTERS[i] for i in order)), k + 1, before, 1 << letter))
            before |= 1 << letter
    names = ("filter_order", "step", "before", "bit")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step, zeros included."""
    found = patterns(docs, labels, limits, part)
    rows = found.withColumn("s", F.explode(_steps())).select("part", "pattern", "n", "good", "toxic", "s.*")
    fails = F.col("pattern").bitwiseAND(F.col("bit")) > 0
    gone = F.col("pattern").bitwiseAND(F.col("before")) > 0
    removed = fails & ~gone

    def total(value: str | Column, when: Column, name: str) -> Column:
        return F.sum(F.when(when, value if isinstance(value, Column) else F.col(value)).otherwise(0)).cast("long").alias(name)

    # Of the filters that a document fails, each comes first in an equal share of all orders.
    share = F.col("n") * F.element_at(F.array(*[F.lit(factorial(len(LETTERS)) // max(1, k)) for k in range(len(LETTERS) + 1)]), F.bit_count("pattern") + 1)
    return rows.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total("n", ~fails & ~gone, "kept"),
        total("n", removed, "removed"),
        total("n", fails & gone, "redundant"),
        total("n", F.col("pattern") == F.col("bit"), "unique_fails"),
        total("good", removed, "good_lost"),
        total("toxic", removed, "toxic_lost"),
        total(share, fails, "shapley"),
    )
