"""Token ids in ORC files, sorted by document id.

Each range of document ids is one file. Within a file the rows stand in ascending order, so the
row index of each stripe has narrow ranges of ids and Bloom filters answer for single ids; ids of
tokens are integer run-length encoded. Readers prune whole files, stripes and row groups by their
metadata, and a large file is read by one task per stripe or more.

A null text has no tokens besides the end id. Rows with a null document id come first. Rows with
the same id stand in the order of their texts, nulls first. Further columns are not stored.
An empty table gives files without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govspark.llm import shards
from govspark.llm.byte_bpe import Remembered, pack
from govspark.llm.common import utf8

SCHEMA = "part int, doc_id long, local_start long, n_ids long, ids array<int>"
#: File format settings: stripes, row groups, Bloom filters and compression.
ORC_OPTIONS = {
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}
REMEMBERED = 600_000
#: Bytes of texts whose distinct words are looked up once.
GATHERED = 8 << 20
#: New words that are encoded together.
TOGETHER = 200


class WordEncoder:
    """Ids of the tokenizers library for a file whose pieces never hold white space.

    Such a tokenizer handles the words between ASCII white space one by one, so the ids of words
    that occur again are remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if tokenizer.encode("a b", add_special_tokens=False).ids != [
            i for word in ("a", "b") for i in tokenizer.encode(word, add_special_tokens=False).ids
        ]:
            raise ValueError("this tokenizer does not handle words one by one")
        lower = [tokenizer.encode(word, add_special_tokens=False).ids for word in ("ABC", "abc", "abc.", ".")]
        self.folds, self.parts = lower[0] == lower[1], lower[2] == lower[1] + lower[3]
        self.tokenizer, self.words = tokenizer, Remembered(self.ids)
        # Bytes of each id's piece, one character of the vocabulary a byte; an end of word has none.
        self.lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
        for piece, i in tokenizer.get_vocab().items():
            self.lengths[i] = len(piece.removesuffix(suffix))

    def ids(self, word: bytes) -> bytes:
        """Ids of a word. A stop or comma behind a letter is a piece of its own, so are the letters."""
        if self.parts and word[-1:] in (b".", b",") and word[-2:-1].isalpha():
            return self.words[word[:-1]] + self.words[word[-1:]]
        return pack(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def split(self, text: str) -> list[bytes]:
        """Words of a text. ``bytes.split`` parts at ASCII white space only."""
        data = text.encode()
        if self.folds and b"<|" not in data:  # a special string is looked for before case is folded
            data = data.lower()
        return data.split()

    def learn(self, words: set[bytes]) -> None:
        """Remember the ids of new words, encoded some hundred at a time with blanks between.

        The ids of each are told by how many bytes they stand for. That is known for characters up
        to U+00FF, which no normalisation joins and whose lower case has as many bytes; words with
        others, and those with special strings, are encoded one by one when they are needed.
        """
        if self.parts:
            ends = {w for w in words if w[-1:] in (b".", b",") and w[-2:-1].isalpha()}
            words = words - ends | {w[:-1] for w in ends}
        new = [w for w in words if w not in self.words and b"<|" not in w and (w.isascii() or simple(w))]
        groups = [new[k : k + TOGETHER] for k in range(0, len(new), TOGETHER)]
        together = [b" ".join(group).decode() for group in groups]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast(together, add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            upto = np.append(0, np.cumsum(self.lengths[ids]))
            ends = np.cumsum([len(w) for w in group])
            cuts = np.searchsorted(upto, ends)
            if cuts[-1] != len(ids) or (upto[cuts] != ends).any():
                continue  # this tokenizer leaves something out: its words go one by one
            data, cuts = ids.tobytes(), (4 * cuts).tolist()
            for word, a, b in zip(group, [0, *cuts], cuts):
                self.words[word] = data[a:b]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one text."""
        words = self.split(text)
        self.learn(set(filterfalse(self.words.__contains__, words)))
        return b"".join(map(self.words.__getitem__, words))

    def encode_rows(self, column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, ``end`` behind each, and how many each text has.

        Each distinct word of the column is looked up once.
        """
        if len(self.words) > REMEMBERED:
            self.words.clear()
        offsets, data = utf8(column)
        counts, found = shards.split(offsets, data, shards.NOT_SPACE, shards.LOWER if self.folds else shards.AS_IS)
        # Special strings are looked for before case is folded: such texts are encoded by themselves.
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        special = np.zeros(len(counts), bool)
        special[np.searchsorted(offsets, marks[(marks >= offsets[0]) & (marks < offsets[-1])], "right") - 1] = True
        codes, distinct = shards.coded(found)
        words = distinct.cast(pa.large_binary()).to_pylist()
        self.learn(set(filterfalse(self.words.__contains__, words)))
        pieces = [*map(self.words.__getitem__, words), *(self.encode(column[k].as_py()) for k in np.flatnonzero(special).tolist()), end]
        sizes = np.array([len(p) // 4 for p in pieces])
        ids, places = np.frombuffer(b"".join(pieces), "<i4"), np.cumsum(sizes) - sizes
        # What each text is made of: its words or, where it is special, its own piece; then the end.
        bounds = np.append(0, np.cumsum(np.where(special, 1, counts) + 1))
        made = np.full(bounds[-1], len(pieces) - 1)
        made[bounds[:-1][special]] = len(words) + np.arange(special.sum())
        inner = np.ones(len(made), bool)
        inner[bounds[1:] - 1] = False
        inner[bounds[:-1][special]] = False
        made[inner] = codes[~np.repeat(special, counts)]
        lengths = sizes[made]
        upto = np.cumsum(lengths)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(places[made] - (upto - lengths), lengths)
        return ids[at], np.diff(np.append(0, upto)[bounds])


def simple(word: bytes) -> bool:
    """No character beyond U+00FF, and none that is white space to Unicode."""
    return max(word.decode()) <= "\xff" and b"\xc2\x85" not in word and b"\xc2\xa0" not in word


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, parts: int | None = None) -> None:
    """Write the ids of every text, each followed by ``end_id``, below ``path``.

    ``parts`` is the number of ranges of document ids; by default Spark's number of shuffle
    partitions, merged by adaptive execution where they are small.
    """
    end = pack([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in shards.gathered(batches, GATHERED):
            ids, sizes = coder.encode_rows(batch.column(1), end)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sizes), part, np.int32)),
                    batch.column(0),
                    pa.array(start + ends - sizes),
                    pa.array(sizes),
                    lists,
                ],
                names=["part", "doc_id", "local_start", "n_ids", "ids"],
            )
            start += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranges = rows.repartitionByRange(parts, "doc_id") if parts else rows.repartitionByRange("doc_id")
    ordered = ranges.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    ordered.mapInArrow(run, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows. Filters on ``doc_id`` and the choice of columns reach the files."""
    return spark.read.schema(SCHEMA).orc(path)


def starts(stored: DataFrame) -> DataFrame:
    """How many ids stand before each file's first, by ``part``: one row per file."""
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def token_digests(stored: DataFrame) -> DataFrame:
    """Place, number and CRC-32 of the ids of each document, as read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy().tolist()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(ids[a:b].data) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )

    read = stored.select("part", "doc_id", "local_start", "ids").mapInArrow(
        run, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    # One row per file: as many as there are ranges.
    return read.join(F.broadcast(starts(stored)), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
