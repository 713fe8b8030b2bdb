"""Texts as numbers: words split in whole batches, and shards with a dictionary of their own.

A shard holds some megabytes of documents: its distinct words once (``words``) and numbers that
point at them. Only the distinct words of a shard are shuffled, once, to meet the same words of
other shards, never the words of the texts one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.rolling import Ranges

#: Bytes of documents from which a shard is closed (one Arrow batch at least).
SHARD_BYTES = 4 << 20
#: Words of all shards, repeated ones too, in a bucket of hashes.
BUCKET_WORDS = 1 << 18
_BYTES = np.arange(256)
#: Bytes of a word: all but ``[\x20\x09-\x0D]``.
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Bytes of a term: letters A to Z in both cases, and all beyond ASCII.
LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
AS_IS = _BYTES.astype(np.uint8)
#: Lower case for A to Z alone.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def split(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words of each text in ``data``, the texts one after the other, and how many each text has.

    A word is a longest run of bytes for which ``inside`` holds; ``folded`` replaces its bytes. A
    word never crosses texts. Separators are ASCII, so words are valid UTF-8.
    """
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    keep = inside[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = keep[edges]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    body = folded[data[keep]]
    places = np.append((np.cumsum(keep) - 1)[starts], len(body)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(body)])
    return counts, words


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as its place among the distinct words, and these in order of first use."""
    found = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.cast(pa.large_string())


def listed(column: pa.Array) -> pa.Array:
    """A column of a batch as the one list of a shard's row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``limit`` bytes, so that their words are counted once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def numbers() -> Iterator[int]:
    """Numbers for the shards of a task that no other task of the job has."""
    k = TaskContext.get().partitionId() << 32
    while True:
        yield k
        k += 1


# ------------------------------------------------------------------ words of all shards together


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes; read with the same type."""
    data = numbers.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), kind)


def parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of words."""
    _, places, body = words.buffers()
    places = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1] if places else np.zeros(1, np.int64)
    return places, np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)


def packed_words(words: pa.Array) -> bytes:
    """Words one after the other with blanks between, compressed."""
    places, body = parts(words)
    sizes = np.diff(places)
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    out[inside] = body[places[0] : places[-1]]
    return packed(out)


def unpacked_words(data: bytes) -> pa.Array:
    body = unpacked(data, np.uint8)
    return split(np.array([0, len(body)]), body, NOT_SPACE, AS_IS)[1]


def hashes(words: pa.Array) -> np.ndarray:
    places, body = parts(words)
    return Ranges(body, 29)(places[:-1], places[1:]) if len(words) else np.zeros(0, np.uint64)


def by_hash(codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same, with the distinct words in order of their hashes: any bucket of hashes is a range of them."""
    order = np.argsort(hashes(words), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[codes], words.take(pa.array(order))


_CHUNK = "bucket long, shard long, words binary, carried binary"


def _chunks(bits: int, carried: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = unpacked_words(batch.column("words")[k].as_py())
                if not len(words):
                    continue
                own = unpacked(batch.column(carried)[k].as_py(), np.int64) if carried else None
                bucket = (hashes(words) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                rows = [
                    (int(bucket[a]), batch.column("shard")[k].as_py(), packed_words(words.slice(a, b - a)), packed(own[a:b]) if carried else None)
                    for a, b in zip(edges[:-1], edges[1:])
                ]
                names = ["bucket", "shard", "words", "carried"]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def met(shards: DataFrame, meet: Callable[[pa.Table], pa.Table], schema: str, carried: str | None = None) -> DataFrame:
    """What ``meet`` makes of equal words of all shards: it gets the chunks of one bucket of hashes.

    Chunks are (bucket, shard, words, carried): ``carried`` names packed 64-bit numbers, one for
    each word. There are as many buckets as keep a bucket near ``BUCKET_WORDS`` words, so chunks
    shrink down to single words where there are very many shards. ``shards`` has ``distinct``.
    """
    entries = shards.agg(F.sum("distinct")).first()[0] or 0
    bits = int(entries // BUCKET_WORDS).bit_length()
    chunks = shards.select("shard", "words", *([carried] if carried else [])).mapInArrow(_chunks(bits, carried), _CHUNK)
    return chunks.groupBy("bucket").applyInArrow(meet, schema)


def attach(shards: DataFrame, values: DataFrame) -> DataFrame:
    """Shards with ``values``: packed numbers of their words bucket by bucket, from (shard, bucket, values).

    A shard without words gets no numbers.
    """
    lists = values.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "values")))["values"].alias("values"))
    none = F.array().cast("array<binary>")
    return shards.join(lists, "shard", "left").withColumn("values", F.coalesce("values", none))


def attached(column: pa.Array, k: int) -> np.ndarray:
    """The numbers of a shard's words, in the order of the words."""
    parts = [unpacked(x.as_py(), np.int64) for x in column[k].values]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
