"""Language-model scores by online logistic context mixing.

A text is its words in lower case (A to Z alone) and one end. Each is told bit by bit: by the path
in a Huffman tree of the frequent training words, the end and an escape, and an escaped word by its
bytes and a blank, each by its path in a smaller tree. Below a depth the words' tree alone tells
the rest of a path. Three predictors look a bit up under hashed contexts: a word's bits under their
place in the tree alone, with the last very frequent word, and with the word before; a byte's bits
with one, two and three bytes before. They hold how often the bit was 0 and 1 in the training documents.
Their logits are added with weights that a gate picks (kind, depth in the code, longest context
seen), and the weights go on learning from the document itself, block by block. The code lengths
add up to the total bits of the text, and so to its probability.

All training documents are gone through: words are counted in one shuffle, each task adds the
bits it sees to tables of a fixed number of slots, which are then added block by block. The
starting weights, 3 for each of 30 gates, are fitted on all their bits as well, each told without
its own count: one more pass counts bits by gate and by logits rounded to ``UNIT``, and Newton steps
go over these counts.
The tables hold three times 2 ** ``slot_bits`` pairs of 16-bit counts, the code at most ``words``
words: that bounds the model, not what it counts.

A null text is empty: its only token is the end. A null id is not held out. Repeated rows count
and are scored each. A text is scored whole, whatever its length. Without training documents all
counts are 0. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.llm import shards
from govspark.llm.common import materialise, utf8

ORDERS = 3
#: Words by rank that count as frequent in a context.
FREQUENT, COMMON = 256, 4096
#: Entries that are gone through at a time.
PIECE = 1 << 12
#: Slots of a table in one row of its parts.
BLOCK = 4096
#: Gates: kind of bit (word, byte), place in the code, longest context seen.
PLACES, SEEN = 5, 3
GATES = 2 * PLACES * SEEN
#: Logits beyond this are cut, so that no bit costs without end.
_MOST = np.float32(12)
#: Sign of a bit.
_SIDES = np.array([-1, 1], np.float32)
_PLACE = np.array([0, 1, 2, 2, 3, 3, 3, 3] + [4] * 248, np.int32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BLANK = 32


@dataclass(frozen=True)
class Settings:
    """Parameters of the model."""

    words: int = 1 << 17
    slot_bits: int = 20
    #: Steps of a word's path that predictors tell; the ones below cost what the tree says.
    depth: int = 10
    #: Count that each bit value starts with.
    start: float = 0.4
    #: Weights before training, how many bits of evidence they are worth, and steps of training.
    weights: tuple[float, ...] = (0.8, 0.3, 0.2)
    ridge: float = 16.0
    steps: int = 3
    #: The same for a document's own weights.
    steady: float = 48.0
    #: Tokens after which a document's weights are learned anew.
    block: int = 64
    #: Documents that are gone through side by side.
    lanes: int = 256


class Paths(NamedTuple):
    """First steps of the paths from the root to all symbols, and what the other ones cost."""

    #: Where the path of each symbol starts in the inner nodes passed and the bits taken.
    starts: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    #: Bits of the steps left out, by the weights of the tree.
    rest: np.ndarray
    #: The nodes spread over 64 bits, and the places in the code (times ``SEEN``, as gates count them).
    spread: np.ndarray
    places: np.ndarray
    #: Last node of each path.
    ends: np.ndarray


@dataclass
class Model:
    """What a task needs to tell and score bits. Arrays of fixed size, see ``Settings``."""

    settings: Settings
    words: pa.Array
    #: Trees of the words and of the bytes, see ``huffman``.
    word_tree: tuple[np.ndarray, np.ndarray, np.ndarray]
    byte_tree: tuple[np.ndarray, np.ndarray, np.ndarray]

    @cached_property
    def word_paths(self) -> Paths:
        return paths(*self.word_tree, self.settings.depth)

    @cached_property
    def word_leaves(self) -> tuple[np.ndarray, Paths]:
        """Which of the different paths each symbol has, and these: words below one node share theirs."""
        whole = self.word_paths
        _, first, leaf = np.unique(whole.ends, return_index=True, return_inverse=True)
        _, place = _steps(whole, first)
        starts = np.append(0, np.cumsum(np.diff(whole.starts)[first]))
        parts = (x[place] for x in (whole.nodes, whole.bits))
        return leaf, Paths(starts, *parts, np.zeros(len(first)), whole.spread[place], whole.places[place], whole.ends[first])

    @cached_property
    def byte_paths(self) -> Paths:
        return paths(*self.byte_tree, 256)

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def escape(self) -> int:
        return len(self.words) + 1


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent of each node of the code's tree, its side there and its weight.

    Symbols are the first nodes, the root is the last one.
    """
    size = len(counts)
    order = sorted(range(size), key=lambda i: (counts[i], i))
    ascending, weight = [counts[i] for i in order], [*counts]
    parent, side = np.zeros(2 * size - 1, np.int32), np.zeros(2 * size - 1, np.uint8)
    leaf, inner = 0, size
    # Leaves and inner nodes both come in ascending weight, so the lightest is at one of two fronts.
    for node in range(size, 2 * size - 1):
        both = 0
        for bit in (0, 1):
            if leaf < size and (inner >= node or ascending[leaf] <= weight[inner]):
                child, leaf = order[leaf], leaf + 1
            else:
                child, inner = inner, inner + 1
            parent[child], side[child] = node, bit
            both += weight[child]
        weight.append(both)
    return parent, side, np.array(weight, np.int64)


def paths(parent: np.ndarray, side: np.ndarray, weight: np.ndarray, depth: int) -> Paths:
    size = (len(parent) + 1) // 2
    symbols, nodes, bits = [], [], []
    at = who = np.arange(size)
    while len(who):
        stays = at != len(parent) - 1
        who, at = who[stays], at[stays]
        symbols.append(who)
        bits.append(side[at])
        at = parent[at]
        nodes.append(at)
    symbols, nodes, bits = np.concatenate(symbols), np.concatenate(nodes), np.concatenate(bits)
    # Stable by symbol, from the root on.
    turned = np.argsort(symbols[::-1], kind="stable")
    symbols, nodes, bits = symbols[::-1][turned], nodes[::-1][turned], bits[::-1][turned]
    starts = np.append(0, np.cumsum(np.bincount(symbols, minlength=size)))
    far = np.arange(len(symbols)) - starts[symbols]
    rest = np.zeros(size)
    deep = far == depth
    rest[symbols[deep]] = np.log2(weight[nodes[deep]] / weight[symbols[deep]])
    ends = np.arange(size)
    ends[symbols[deep]] = nodes[deep]
    near = far < depth
    starts = np.append(0, np.cumsum(np.bincount(symbols[near], minlength=size)))
    nodes = (nodes[near] - size).astype(np.int32)
    return Paths(starts, nodes, bits[near], rest, (nodes.astype(np.uint64) + np.uint64(1)) * _ODD, _PLACE[far[near]] * SEEN, ends)


# ------------------------------------------------------------------ bits of the documents of a shard


class Bits:
    """Some units of each document (words, or escaped words) and the symbols that tell them.

    ``bounds`` are the units of each document, one document after the other. Called with numbers of
    units it gives, symbol by symbol: the place of the unit in that list, and the entry.

    An entry is a symbol under its contexts: all its bits and slots follow from the symbol's path in
    ``paths`` and from the numbers of the predictors' contexts. Units of one ``alike`` have the same
    entries, or ones with the same symbol and contexts.
    """

    kind: int
    #: Units that are gone through at a time.
    piece: int
    bounds: np.ndarray
    alike: np.ndarray
    paths: Paths
    symbols: np.ndarray
    contexts: list[np.ndarray]

    def __call__(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def spread(self, order: int, contexts: np.ndarray) -> np.ndarray:
        """Numbers of a predictor's contexts spread over 64 bits."""
        raise NotImplementedError


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of ranges one after the other: which range, how far in it, and the number itself."""
    which = np.repeat(np.arange(len(starts)), lengths)
    far = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return which, far, starts[which] + far


def _steps(paths: Paths, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps of the symbols' paths, one symbol after the other: which symbol, and place in the paths."""
    starts = paths.starts.take(symbols)
    lengths = paths.starts.take(symbols + 1) - starts
    which = np.repeat(np.arange(len(symbols)), lengths)
    place = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    place += np.arange(len(place))
    return which, place


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of nodes, which are spread already, under their contexts."""
    out = context ^ node
    out *= _MIX
    out >>= np.uint64(64 - bits)
    return out.view(np.int64)


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in ascending order, equal ones in the order they come, and where each different one starts there."""
    low = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + low < 64:
        # A sort of numbers is several times as fast as one of places.
        both = np.sort(keys << low | np.arange(len(keys)))
        order, keys = both & (1 << low) - 1, both >> low
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def _entries(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key comes first, in that order, and which of them each key is."""
    order, starts = _ordered(keys)
    first = order[starts]
    new = np.zeros(len(keys), bool)
    new[first] = True
    number = np.cumsum(new)[first] - 1
    entry = np.empty(len(keys), np.int64)
    entry[order] = np.repeat(number, np.diff(starts, append=len(keys)))
    return np.flatnonzero(new), entry


@lru_cache(1)
def _named() -> list[np.ndarray]:
    """Contexts of the word predictors by the number of the word before, spread; 0 is a document's start."""
    before = np.arange(COMMON + 100, dtype=np.uint64) * _ODD
    before[0] = 1
    return [np.zeros(len(before), np.uint64), before * _ODD + np.uint64(5), before * _MIX]


class WordBits(Bits):
    kind, piece = 0, 1 << 12

    def __init__(self, model: Model, symbols: np.ndarray, bounds: np.ndarray) -> None:
        self.bounds = bounds
        leaf, self.paths = model.word_leaves
        self.symbols = leaf.take(symbols)
        # Of a rare word only the order of its rank counts as context.
        kinds = np.arange(model.escape + 1)
        kinds = np.where(kinds < COMMON, kinds + 100, np.log2(kinds + 1)).astype(np.int64)
        before = np.append(0, kinds[symbols[:-1]])
        before[bounds[:-1]] = 0
        # The last one of the most frequent words tells more than a rare word before.
        places = np.where(np.append(False, symbols[:-1] < FREQUENT), np.arange(len(symbols)), 0)
        places[bounds[:-1]] = bounds[:-1]
        often = before.take(np.maximum.accumulate(places))
        self.contexts = [np.zeros_like(before), often, before]

    @property
    def alike(self) -> np.ndarray:
        size = COMMON + 100
        _, often, before = self.contexts
        return (self.symbols * size + often) * size + before

    def __call__(self, units):
        return np.arange(len(units)), units

    def spread(self, order, contexts):
        return _named()[order].take(contexts)


class ByteBits(Bits):
    kind, piece = 1, 1 << 10

    def __init__(self, model: Model, words: np.ndarray, places: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> None:
        self.bounds, self.paths = bounds, model.byte_paths
        words, self.alike = np.unique(words, return_inverse=True)
        lengths = places[words + 1] - places[words] + 1
        which, far, place = _spread(places[words], lengths)
        byte = np.where(far == lengths[which] - 1, np.uint8(_BLANK), data[np.minimum(place, len(data) - 1)])
        del which, place
        # Up to three bytes before, the last one lowest.
        before = np.zeros(len(byte), np.int64)
        for k in range(1, ORDERS + 1):
            back = np.append(np.zeros(min(k, len(byte)), np.uint8), byte[:-k])
            back[far < k] = 0
            before |= back.astype(np.int64) << 8 * (k - 1)
        self.starts = np.append(0, np.cumsum(lengths))
        entries, self.told = _entries(before << 8 | byte)
        self.symbols, before = byte.take(entries).astype(np.int64), before.take(entries)
        self.contexts = [before & (1 << 8 * k) - 1 for k in range(1, ORDERS + 1)]

    def __call__(self, units):
        words = self.alike.take(units)
        which, _, place = _spread(self.starts.take(words), self.starts.take(words + 1) - self.starts.take(words))
        return which, self.told.take(place)

    def spread(self, order, contexts):
        out = np.full(len(contexts), 3, np.uint64)
        for k in range(order + 1):
            out = (out * np.uint64(257) + (contexts >> 8 * k & 0xFF).astype(np.uint64) + np.uint64(1)) * _MIX
        return out


@dataclass
class Shard:
    """The documents of one shard and the bits of their words and escaped words."""

    trained: np.ndarray
    streams: list[Bits]
    #: Bits of each document that no predictor tells.
    rest: np.ndarray


def opened(model: Model, row: dict) -> Shard:
    words, lengths = row["words"], row["lengths"]
    places, body = shards.parts(words)
    body = body if len(body) else np.zeros(1, np.uint8)
    known = pc.index_in(words, value_set=model.words)
    symbol = np.append(pc.fill_null(known, model.escape).to_numpy(zero_copy_only=False).astype(np.int64), model.end)
    # Words of all documents with the end of each in its place.
    bounds = np.append(0, np.cumsum(lengths + 1))
    tokens = np.full(bounds[-1], len(words))
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    tokens[inner] = row["codes"]
    symbols = symbol[tokens]
    escaped = np.flatnonzero(symbols == model.escape)
    spelled = tokens[escaped]
    return Shard(
        row["trained"],
        [
            WordBits(model, symbols, bounds),
            ByteBits(model, spelled, places, body, np.searchsorted(escaped, bounds)),
        ],
        np.add.reduceat(model.word_paths.rest[symbols], bounds[:-1]),
    )


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        row = {
            "words": shards.unpacked_words(batch.column("words")[k].as_py()),
            "codes": shards.unpacked(batch.column("codes")[k].as_py(), np.int32),
            "lengths": shards.unpacked(batch.column("lengths")[k].as_py(), np.int64),
            "trained": ~np.asarray(batch.column("held")[k].values.to_numpy(zero_copy_only=False), bool),
        }
        yield row


def _met(stream: Bits, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the marked documents and how often they have each; units that are alike are told once."""
    units = np.flatnonzero(np.repeat(docs, np.diff(stream.bounds)))
    order, starts = _ordered(stream.alike.take(units))
    which, entry = stream(units.take(order.take(starts)))
    out = np.zeros(len(stream.symbols), np.int64)
    np.add.at(out, entry, np.diff(starts, append=len(units)).take(which))
    entries = np.flatnonzero(out)
    return entries, out.take(entries)


# ------------------------------------------------------------------ learning


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = shards.numbers()
    for batch in shards.gathered(batches):
        offsets, data = utf8(batch.column("text"))
        lengths, words = shards.split(offsets, data, shards.NOT_SPACE, shards.LOWER)
        codes, distinct = shards.by_hash(*shards.coded(words))
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        learned = codes[np.repeat(~held, lengths)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([next(number)], pa.int64()),
                pa.array([shards.packed_words(distinct)], pa.binary()),
                pa.array([len(distinct)], pa.int64()),
                pa.array([shards.packed(np.bincount(learned, minlength=len(distinct)).astype(np.int64))], pa.binary()),
                pa.array([shards.packed(codes.astype(np.int32))], pa.binary()),
                pa.array([shards.packed(lengths.astype(np.int64))], pa.binary()),
                shards.listed(batch.column("doc_id")),
                shards.listed(pa.array(held)),
                shards.listed(pa.array(np.diff(offsets))),
            ],
            names=["shard", "words", "distinct", "learned", "codes", "lengths", "doc_id", "held", "n_bytes"],
        )


def token_shards(docs: DataFrame, held_out: Column) -> DataFrame:
    """Documents as numbers of words, with what each shard's training documents hold of each word."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(
        _local,
        "shard long, words binary, distinct long, learned binary, codes binary, lengths binary,"
        "doc_id array<bigint>, held array<boolean>, n_bytes array<bigint>",
    )


def _summed(chunks: pa.Table) -> pa.Table:
    """Training counts of a bucket's words, for each shard, and once for the bucket."""
    words = [shards.unpacked_words(x.as_py()) for x in chunks["words"]]
    codes, distinct = shards.coded(pa.concat_arrays(words))
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, codes, np.concatenate([shards.unpacked(x.as_py(), np.int64) for x in chunks["carried"]]))
    parts = np.split(total[codes], np.cumsum([len(w) for w in words])[:-1])
    learned = np.flatnonzero(total)
    none = [None] * (len(words) - 1)
    return pa.table(
        {
            "shard": chunks["shard"],
            "bucket": chunks["bucket"],
            "values": pa.array([shards.packed(v) for v in parts], pa.binary()),
            "words": pa.array([shards.packed_words(distinct.take(pa.array(learned))), *none], pa.binary()),
            "totals": pa.array([shards.packed(total[learned]), *none], pa.binary()),
        }
    )


def word_counts(local: DataFrame) -> DataFrame:
    """(shard, bucket, values, words, totals): training counts of each shard's words.

    One row of each bucket has all its training words with their counts.
    """
    return shards.met(local, _summed, "shard long, bucket long, values binary, words binary, totals binary", "learned")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, totals in zip(batch.column("words"), batch.column("totals")):
            arrays = [shards.unpacked_words(words.as_py()).cast(pa.string()), pa.array(shards.unpacked(totals.as_py(), np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "value"])


def word_table(counts: DataFrame) -> DataFrame:
    """(word, value): each training word once with its count."""
    return counts.filter("words IS NOT NULL").select("words", "totals").mapInArrow(_listed, "word string, value long")


def frequent(table: DataFrame, most: int) -> list[tuple[str, int]]:
    """Words with a count at or above the least one for which there are at most ``most`` of them.

    Words that came once are left to the escape, which learns from them what new words are like.
    Counts are told apart by their first eight bits, so the driver gets some thousand sums and
    then ``most`` words.
    """
    named = table.filter("value > 1")
    low = F.greatest(F.lit(0), F.length(F.bin("value")) - 8)
    floor = F.expr("shiftleft(shiftright(value, `low`), `low`)")
    sizes = named.withColumn("low", low).groupBy(floor.alias("least")).agg(F.count("*").alias("n")).orderBy(F.desc("least")).collect()
    least, room = None, most
    for row in sizes:
        if row["n"] > room:
            break
        least, room = row["least"], room - row["n"]
    if least is None:
        return []
    found = named.filter(F.col("value") >= least).select("word", "value").toArrow()
    return sorted(zip(found["word"].to_pylist(), found["value"].to_pylist()), key=lambda w: (-w[1], w[0].encode()))


def coder(words: list[tuple[str, int]], ends: int, others: int, s: Settings) -> Model:
    """The code of the words, the end and the escape by their training counts (1 at least)."""
    tree = huffman([n for _, n in words] + [max(1, ends), max(1, others)])
    letters = np.ones(256, np.int64)
    letters[_BLANK] += len(words)
    letters += np.bincount(np.frombuffer("".join(w for w, _ in words).encode(), np.uint8), minlength=256)
    return Model(s, pa.array([w for w, _ in words], pa.large_string()), tree, huffman(letters.tolist()))


def tallied(model: Broadcast) -> Callable:
    """Counts of bits by slot of all training documents of a task, in parts of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        counts = np.zeros((ORDERS, 2 << m.settings.slot_bits), np.int64)
        for batch in batches:
            for row in _rows(batch):
                shard = opened(m, row)
                for stream in shard.streams:
                    entries, met = _met(stream, shard.trained)
                    for k, context in enumerate(stream.contexts):
                        # What a predictor does not tell apart is put together first.
                        size = len(stream.paths.starts)
                        order, starts = _ordered(context.take(entries) * size + stream.symbols.take(entries))
                        n = np.add.reduceat(met.take(order), starts) if len(order) else order
                        first = entries.take(order.take(starts))
                        for at in range(0, len(first), PIECE):
                            piece = first[at : at + PIECE]
                            which, place = _steps(stream.paths, stream.symbols.take(piece))
                            slot = _slot(stream.spread(k, context.take(piece)).take(which), stream.paths.spread.take(place), m.settings.slot_bits)
                            slot += slot
                            slot += stream.paths.bits.take(place)
                            np.add.at(counts[k], slot, n[at : at + PIECE].take(which))
        for order in range(ORDERS):
            for part, block in enumerate(counts[order].reshape(-1, 2 * BLOCK)):
                if block.any():
                    yield _part(order, part, block)

    return run


_PART = "order int, part int, width int, counts binary"


def _part(order: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    """A part of a table in the narrowest numbers that hold it."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 1 << 8 * w)
    return pa.RecordBatch.from_pydict(
        {
            "order": pa.array([order], pa.int32()),
            "part": pa.array([part], pa.int32()),
            "width": pa.array([width], pa.int32()),
            "counts": pa.array([counts.astype(f"u{width}").tobytes()], pa.binary()),
        }
    )


def _counts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for order, part, width, data in zip(*(batch.column(c) for c in ("order", "part", "width", "counts"))):
        yield order.as_py(), part.as_py(), np.frombuffer(data.as_py(), f"u{width.as_py()}").astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of a table that come to a task, halved together where they exceed 16 bits."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for order, part, counts in _counts(batch):
            if (order, part) in sums:
                sums[order, part] += counts
            else:
                sums[order, part] = counts
    for (order, part), counts in sorted(sums.items()):
        pairs = counts.reshape(-1, 2)
        over = np.maximum(1, -(-pairs.max(axis=1, keepdims=True) // 0xFFFF))
        yield _part(order, part, (-(-pairs // over)).ravel())


def tables(local: DataFrame, model: Broadcast, s: Settings) -> np.ndarray:
    """The predictors' counts: count of 0 in the low, of 1 in the high half of each number."""
    parts = local.mapInArrow(tallied(model), _PART).repartition("order", "part").mapInArrow(_added, _PART)
    out = np.zeros((ORDERS, 1 << s.slot_bits), np.uint32)
    for batch in parts.toArrow().to_batches():  # at most 4 bytes a slot
        for order, part, counts in _counts(batch):
            pairs = counts.reshape(-1, 2).astype(np.uint32)
            out[order, part * BLOCK : (part + 1) * BLOCK] = pairs[:, 0] | pairs[:, 1] << np.uint32(16)
    return out


@lru_cache(2)
def _logs(start: float) -> np.ndarray:
    return np.log(np.arange(1 << 16) + start).astype(np.float32)


def halves(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 1 and of 0."""
    return both >> np.uint32(16), both & np.uint32(0xFFFF)


def slots_of(m: Model, stream: Bits, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The bits of some entries: which entry in the list, place in the paths, slots of the predictors."""
    which, place = _steps(stream.paths, stream.symbols.take(entries))
    node = stream.paths.spread.take(place)
    slots = [_slot(stream.spread(k, c.take(entries)).take(which), node, m.settings.slot_bits) for k, c in enumerate(stream.contexts)]
    return which, place, slots


def _seen(second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Longest context that tells anything, 0 to 2, by whether the second and the third one do."""
    met = third.view(np.int8) * np.int8(2)
    return np.maximum(met, second.view(np.int8))


def _gate(kind: int, place: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Numbers of gates; ``place`` comes times ``SEEN``."""
    return place + (seen + np.int32(kind * PLACES * SEEN))


def _chance(z: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-z))


#: Evidence is rounded to this many nats for the starting weights: that many levels to either side of 0.
UNIT, REACH = 0.75, 16
LEVELS = 2 * REACH + 1


#: Mark of a level whose logit is not 0.
_TELLS = 64


def levels(model: Model, table: np.ndarray) -> np.ndarray:
    """Rounded logit of a bit by its predictor, slot and value, told for that value without the bit's own count."""
    log = _logs(model.settings.start)
    out = np.empty((ORDERS, table.shape[1], 2), np.uint8)
    for k in range(ORDERS):
        for at in range(0, table.shape[1], 1 << 16):
            ones, zeros = halves(table[k, at : at + (1 << 16)])
            for bit, (own, other) in enumerate(((zeros, ones), (ones, zeros))):
                told = log.take(own - np.minimum(own, 1)) - log.take(other)
                level = np.rint(told / np.float32(UNIT)).astype(np.int8) + np.int8(REACH)
                out[k, at : at + (1 << 16), bit] = level | (told != 0).view(np.int8) * np.int8(_TELLS)
    return out.reshape(ORDERS, -1)


def evidence(model: Broadcast, table: Broadcast) -> Callable:
    """How many bits of all training documents have which gate and which logits, told for the bit's own value.

    Logits are rounded, so there are at most ``GATES * LEVELS ** ORDERS`` cells for any input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        told = levels(m, table.value)
        counts = np.zeros(GATES * LEVELS**ORDERS, np.int64)
        for batch in batches:
            for row in _rows(batch):
                shard = opened(m, row)
                for stream in shard.streams:
                    entries, met = _met(stream, shard.trained)
                    for at in range(0, len(entries), PIECE):
                        which, place, slots = slots_of(m, stream, entries[at : at + PIECE])
                        bit = stream.paths.bits.take(place)
                        found = []
                        for k, slot in enumerate(slots):
                            slot += slot
                            slot += bit
                            found.append(told[k].take(slot))
                        cell = _gate(stream.kind, stream.paths.places.take(place), _seen(found[1] >= _TELLS, found[2] >= _TELLS))
                        for level in found:
                            cell = cell * LEVELS + (level & np.uint8(_TELLS - 1))
                        np.add.at(counts, cell, met[at : at + PIECE].take(which))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])

    return run


def fitted(cells: np.ndarray, counts: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of each gate (gates by predictors) after Newton steps over all cells of ``evidence``, in their order."""
    out = np.tile(np.array(s.weights, np.float32), (GATES, 1))
    cuts = np.searchsorted(cells, np.arange(GATES + 1) * LEVELS**ORDERS)
    for gate, (first, last) in enumerate(zip(cuts[:-1], cuts[1:])):
        places = np.unravel_index(cells[first:last] % LEVELS**ORDERS, (LEVELS,) * ORDERS)
        told, n = (np.stack(places, 1) - REACH) * UNIT, counts[first:last]
        for _ in range(s.steps):
            right = _chance(np.clip(told @ out[gate], -_MOST, _MOST))
            curve = np.eye(ORDERS) * s.ridge + (told * (n * right * (1 - right))[:, None]).T @ told
            step = np.linalg.solve(curve, told.T @ (n * (1 - right)))
            # Halved while it would cost more than it saves.
            spent = n @ np.logaddexp(0, -(told @ out[gate]))
            while n @ np.logaddexp(0, -(told @ (out[gate] + step))) > spent and np.abs(step).max() > 1e-6:
                step /= 2
            out[gate] += step
    return out


def starting_weights(local: DataFrame, model: Broadcast, table: Broadcast, s: Settings) -> np.ndarray:
    """Weights of each gate, from the bits of all training documents, each told without its own count."""
    sums = local.mapInArrow(evidence(model, table), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, counts = sums["cell"].to_numpy(), sums["n"].to_numpy()
    order = np.argsort(cells)
    return fitted(cells[order], counts[order], s)


# ------------------------------------------------------------------ scoring


class ByteTold:
    """The bits of all entries of escaped words, one entry after the other, told for the bit's own value."""

    def __init__(self, m: Model, logits: np.ndarray, stream: Bits) -> None:
        self.stream = stream
        self.starts = np.append(0, np.cumsum(np.diff(stream.paths.starts).take(stream.symbols)))
        self.st = [np.empty(self.starts[-1], np.float32) for _ in range(ORDERS)]
        self.gates = np.empty(self.starts[-1], np.int8)
        for at in range(0, len(stream.symbols), PIECE):
            entries = np.arange(at, min(at + PIECE, len(stream.symbols)))
            _, place, slots = slots_of(m, stream, entries)
            here = slice(self.starts[at], self.starts[entries[-1] + 1])
            side = _SIDES.take(stream.paths.bits.take(place))
            for x, table, slot in zip(self.st, logits, slots):
                np.multiply(table.take(slot), side, out=x[here])
            self.gates[here] = _gate(stream.kind, stream.paths.places.take(place), _seen(self.st[1][here] != 0, self.st[2][here] != 0))

    def __call__(self, units: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        which, entry = self.stream(units)
        starts = self.starts.take(entry)
        lengths = self.starts.take(entry + 1) - starts
        place = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        place += np.arange(len(place))
        cell = np.repeat(lane.take(which) * GATES, lengths)
        cell += self.gates.take(place)
        return cell, [x.take(place) for x in self.st], np.zeros(len(units))


class WordTold:
    """The same for words: a row of bits for each predictor's different contexts and paths, 0 where a path has ended."""

    def __init__(self, m: Model, logits: np.ndarray, stream: WordBits) -> None:
        starts = stream.paths.starts
        lengths = np.diff(starts)
        width = int(lengths.max())
        leaf, far, place = _spread(starts[:-1], lengths)
        node, side = np.zeros((len(lengths), width), np.uint64), np.zeros((len(lengths), width), np.float32)
        node[leaf, far], side[leaf, far] = stream.paths.spread[place], _SIDES[stream.paths.bits[place]]
        self.gates = stream.kind * PLACES * SEEN + _PLACE[:width].astype(np.int64) * SEEN
        self.ended = (width - lengths).take(stream.symbols)
        self.rows, self.st = [], []
        for k, table in enumerate(logits):
            if k:
                first, row = _entries(stream.contexts[k] * len(starts) + stream.symbols)
                leaf, context = stream.symbols.take(first), stream.contexts[k].take(first)
            else:
                # The path alone.
                leaf, row = np.arange(len(lengths)), stream.symbols
                context = np.zeros_like(leaf)
            out = np.empty((len(leaf), width), np.float32)
            for at in range(0, len(leaf), PIECE):
                here = slice(at, at + PIECE)
                slot = _slot(stream.spread(k, context[here])[:, None], node.take(leaf[here], axis=0), m.settings.slot_bits)
                np.multiply(table.take(slot), side.take(leaf[here], axis=0), out=out[here])
            self.rows.append(row)
            self.st.append(out)

    def __call__(self, units: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        st = [x.take(row.take(units), axis=0).ravel() for x, row in zip(self.st, self.rows)]
        cell = np.add.outer(lane * GATES, self.gates).ravel()
        cell += _seen(st[1] != 0, st[2] != 0)
        return cell, st, self.ended.take(units)


#: What a bit without evidence adds.
_EVEN = float(np.log(np.float32(0.5)))


def _lanes(m: Model, told: Callable, starting: np.ndarray, stream: Bits, docs: np.ndarray) -> np.ndarray:
    """Bits of some documents, longest first, each with weights of its own that go on learning.

    ``told`` gives the bits of units: cells of weights, logits for the bit's own value, and how many bits of each unit do not count.
    """
    s = m.settings
    firsts, lasts = stream.bounds[docs], stream.bounds[docs + 1]
    weights = [np.tile(starting[:, k], len(docs)) for k in range(ORDERS)]
    spent = np.zeros(len(docs))
    while (live := int(np.count_nonzero(firsts < lasts))) > 0:  # lengths descend: the first ones
        firsts, lasts = firsts[:live], lasts[:live]
        size = np.minimum(lasts - firsts, s.block)
        lane, _, units = _spread(firsts, size)
        cell, st, none = told(units, lane)
        z = weights[0].take(cell) * st[0]
        for w, x in zip(weights[1:], st[1:]):
            z += w.take(cell) * x
        np.minimum(np.maximum(z, -_MOST, out=z), _MOST, out=z)
        right = _chance(z)
        spent[:live] -= np.bincount(cell, np.log(right), live * GATES).reshape(live, GATES).sum(axis=1)
        spent[:live] += np.bincount(lane, none, live) * _EVEN
        miss = 1 - right
        force = sum(x * x for x in st)
        force *= miss
        force *= right
        curve = np.bincount(cell, force, live * GATES) + s.steady
        for w, x in zip(weights, st):
            x *= miss
            w[: live * GATES] += (np.bincount(cell, x, live * GATES) / curve).astype(np.float32)
        firsts = firsts + size
    return spent / np.log(2)


def code_lengths(m: Model, logits: np.ndarray, weights: np.ndarray, shard: Shard) -> np.ndarray:
    """Total bits of each document of a shard."""
    out = shard.rest.copy()
    for stream in shard.streams:
        told = (WordTold if stream.kind == 0 else ByteTold)(m, logits, stream)
        sizes = np.diff(stream.bounds)
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            # As many side by side as keep a step's arrays small.
            most = stream.piece // max(1, min(m.settings.block, sizes[order[at]]))
            docs = order[at : at + max(1, min(m.settings.lanes, most))]
            out[docs] += _lanes(m, told, weights, stream, docs)
            at += len(docs)
    return out


def scored(model: Broadcast, table: Broadcast, weights: np.ndarray, tokens: int, kinds: int, ends: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        log = _logs(m.settings.start)
        logits = np.stack([log[ones] - log[zeros] for ones, zeros in map(halves, table.value)])
        for batch in batches:
            for k, row in enumerate(_rows(batch)):
                lengths = row["lengths"]
                seen = shards.attached(batch.column("values"), k)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                share = np.log10((seen + 1) / (tokens + kinds + 1))[row["codes"]]
                base = np.bincount(owner, share, len(lengths)) + np.log10((ends + 1) / (tokens + kinds + 1))
                known = np.bincount(owner, seen[row["codes"]] > 0, len(lengths)) + (ends > 0)
                bits = code_lengths(m, logits, weights, opened(m, row))
                size = batch.column("n_bytes")[k].values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[k].values,
                        pa.array(~row["trained"]),
                        pa.array(lengths + 1),
                        pa.array(known.astype(np.int64)),
                        pa.array(np.full(len(lengths), tokens, np.int64)),
                        pa.array(base),
                        pa.array(-bits * np.log10(2)),
                        pa.array(bits / np.maximum(1, size)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                )

    return run


def score(docs: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """Each document's score by word counts alone and by the model, both learned from all that are not held out."""
    spark = docs.sparkSession
    local = materialise(token_shards(docs, held_out), "token-shards")
    counts = materialise(word_counts(local), "word-counts")
    ends = local.agg(F.sum(F.expr("size(filter(held, h -> NOT h))")).alias("n")).first()["n"] or 0
    table = word_table(counts)
    sums = table.agg(F.count("*").alias("kinds"), F.sum("value").alias("n")).first()
    tokens, kinds = (sums["n"] or 0) + ends, sums["kinds"] + (ends > 0)

    words = frequent(table, s.words)
    model = spark.sparkContext.broadcast(coder(words, ends, tokens - ends - sum(n for _, n in words), s))
    slots = spark.sparkContext.broadcast(tables(local, model, s))
    weights = starting_weights(local, model, slots, s)
    known = shards.attach(local, counts.select("shard", "bucket", "values"))
    return known.select("words", "codes", "lengths", "doc_id", "held", "n_bytes", "values").mapInArrow(
        scored(model, slots, weights, tokens, kinds, ends),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double,"
        "bits_per_byte double",
    )
