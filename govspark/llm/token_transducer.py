"""Token counts with a finite-state transducer.

The states of the transducer stand for what later bytes of a piece can depend on: the node of a
trie of all tokens that the longest usable ending of the piece reaches, and, for each usable
ending, the last token before it and how many tokens there are up to it. A transition carries the
change of the number of tokens, so the sum over a text is its count. States and transitions are
compiled when a text first needs them, into one integer table, and thrown away when there are too
many of them.

Texts are cut into chunks of equal length that step through the table side by side. A chunk has a
map from the state before it to the state behind it. With a piece border inside, the map is
constant, and only the bytes before the border depend on the state that comes in. Without one, the
map is a table over the states that can come in: first those that a run from the start of the chunk
before would leave, then, round by round, what the maps themselves give. Chunks of equal bytes
share a map. Each round composes the maps by doubling, a parallel prefix scan: the states that
come in are then known up to the first chunk whose map lacks one. A state seldom depends on bytes
far back, so a few rounds are enough for a run of any length.

Nulls and empty texts count 0. Texts are taken whole. Rows are independent of each other.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.byte_bpe import CONTRACTIONS, Vocabulary
from govspark.llm.common import slices, utf8

LETTER, NUMBER, WHITE, OTHER = range(4)
UNKNOWN, START = 0, 1
#: Bytes of text whose chunks run side by side.
TOGETHER = 1 << 20
#: Cells of 4 bytes after which the table is thrown away, rows that it grows by, and bytes of a chunk.
MOST_CELLS = 48_000_000
GROW = 32_768
CHUNK = 128
#: Rounds that an entry of a map is kept for after its last use.
ROUNDS = 8
#: Fewer lanes than this are stepped one by one.
FEW = 24


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for found in regex.finditer(pattern, every):
            out[[ord(c) for c in found[0]]] = kind
    # Format separators that the pattern language of the files does not count as white space.
    out[0x1C:0x20] = OTHER
    return out


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a piece; ``first`` marks those that begin a text."""
    n = len(points)
    kind = classes()[points]
    white = kind == WHITE
    before = np.concatenate([[False], ~first[1:]])  # there is a character before, in the same text
    after = np.concatenate([~first[1:], [False]])
    left_kind = np.concatenate([[OTHER], kind[:-1]])
    left_point = np.concatenate([[0], points[:-1]])
    next_white = np.concatenate([white[1:], [True]])
    start = ~before | (~white & (kind != left_kind) & (left_point != 32))
    start |= white & (~before | (left_kind != WHITE) | (after & ~next_white))
    apostrophe = np.flatnonzero((points == 39) & start & after)
    ends = np.flatnonzero(first)[1:]
    for text in CONTRACTIONS:
        here = apostrophe[apostrophe + len(text) <= n]
        limit = np.searchsorted(ends, here, "right")
        here = here[here + len(text) <= np.append(ends, n)[limit]]
        for k, c in enumerate(text[1:], 1):
            here = here[points[here + k] == ord(c)]
        start[here + 1] = False
        behind = here + len(text)
        start[behind[behind < n]] = True
    return start


class Transducer:
    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary(path)
        # Trie of all tokens with failure links; per node its children, link, depth and token.
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        depth = [0]
        for i, token in enumerate(v.tokens):
            node = 0
            for b in token:
                step = self.children[node].get(b)
                if step is None:
                    step = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                    depth.append(depth[node] + 1)
                node = step
            self.token[node] = i
        self.depth = depth
        self.link = [0] * len(depth)
        queue = list(self.children[0].values())
        for node in queue:
            for b, child in self.children[node].items():
                back = self.link[node]
                while back and b not in self.children[back]:
                    back = self.link[back]
                self.link[child] = self.children[back].get(b, 0)
                queue.append(child)
        self.empty()

    def empty(self) -> None:
        """Forget all states but the first two. A state: endings, longest first, as (node, last token, count)."""
        self.states: list[tuple] = [(), ((0, -1, 0),)]
        self.number = {self.states[1]: START}
        # Bytes get a column of the table when a text first holds them.
        self.column = np.full(256, -1, np.int16)
        self.bytes: list[int] = []
        self.table = np.full((GROW, 64), -1, np.int32)
        self.table[UNKNOWN] = UNKNOWN << 8 | 128

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = len(self.bytes)
                self.bytes.append(b)
        while len(self.bytes) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.table[UNKNOWN] = UNKNOWN << 8 | 128
        return self.column[data]

    def step(self, state: int, column: int) -> int:
        """Compile one transition: the state behind it and the change of the count, packed."""
        v, byte, now, endings = self.vocabulary, self.bytes[column], None, []
        for node, last, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if now is None and token >= 0 and (last < 0 or v.fits(last, token)):
                now = token, count + 1
            if self.children[child]:
                endings.append((child, last, count))
        last, total = now
        # Counts are kept relative to the present one.
        key = tuple((node, t, c - total) for node, t, c in endings) + ((0, last, 0),)
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
            if target >= len(self.table):
                self.table = np.concatenate([self.table, np.full((GROW, self.table.shape[1]), -1, np.int32)])
        change = total
        if not -128 <= change < 128:
            raise ValueError("a transition changes the count by too much")
        packed = target << 8 | (change + 128)
        self.table[state, column] = packed
        return packed

    def run(self, state: np.ndarray, data: np.ndarray, restart: np.ndarray | None, out: np.ndarray) -> np.ndarray:
        """Step lanes (columns of ``data``) from ``state``; ``out`` gets the changes."""
        for j in range(len(data)):
            if restart is not None:
                state = np.where(restart[j], START, state)
            width = self.table.shape[1]
            key = state.astype(np.int64) * width + data[j]
            packed = self.table.ravel()[key]
            missing = packed < 0
            if missing.any():
                for k in np.unique(key[missing]).tolist():
                    self.step(*divmod(k, width))
                packed = self.table.ravel()[key]
            state = packed >> 8
            out[j] = (packed & 255) - 128
        return state

    def composed(self, grid: np.ndarray, free: np.ndarray, end: np.ndarray) -> np.ndarray:
        """States behind the chunks ``free``, which have no border; ``end`` has those behind the others."""
        alike = np.ascontiguousarray(grid[:, free].T).view(np.dtype((np.void, grid.itemsize * CHUNK))).ravel()
        _, sample, kind = np.unique(alike, return_index=True, return_inverse=True)
        result, self.rounds = np.full(len(free), UNKNOWN, np.int32), 0
        # All maps in one sorted table: (kind of chunk, state that comes in), state behind, round.
        keys, images, made = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        left = np.arange(len(free))
        linked = np.concatenate([[False], np.diff(free) == 1])  # the chunk before is one of them as well
        coming = np.where(linked, START, end[free - 1]).astype(np.int64)
        while len(left):
            self.rounds += 1
            used = kind[left] << 32 | coming[left]
            made[np.isin(keys, used)] = self.rounds
            wanted = np.setdiff1d(used, keys)
            lanes = np.ascontiguousarray(grid[:, free[sample[wanted >> 32]]])
            behind = self.run((wanted & 0xFFFFFFFF).astype(np.int32), lanes, None, np.zeros(lanes.shape, np.int8))
            recent = made > self.rounds - ROUNDS
            keys, images, made = (
                np.concatenate(x) for x in ((keys[recent], wanted), (images[recent], behind), (made[recent], np.full(len(wanted), self.rounds)))
            )
            order = np.argsort(keys, kind="stable")
            keys, images, made = keys[order], images[order], made[order]
            state = self.scan(kind[left], linked[left], coming[left], keys, images)
            result[left] = state
            # What a map gives comes into the next chunk, for certain where the scan knows it.
            guess = images[np.searchsorted(keys, used)]
            guess = np.where(state != UNKNOWN, state, guess)
            rest = np.flatnonzero(state == UNKNOWN)
            coming[left[rest]] = guess[rest - 1]
            linked[left[rest]] &= state[rest - 1] == UNKNOWN
            left = left[rest]
        return result

    def scan(self, kind: np.ndarray, linked: np.ndarray, coming: np.ndarray, keys: np.ndarray, images: np.ndarray) -> np.ndarray:
        """State behind each chunk by maps composed over 1, 2, 4 ... chunks; unknown where a map lacks the state.

        A linked chunk follows the one before it in the arrays, the others start from ``coming``.
        """
        low, high = np.searchsorted(keys, kind << 32), np.searchsorted(keys, kind + 1 << 32)
        first = np.concatenate([[0], np.cumsum(high - low)])
        # An entry of a chunk's map is a node; its step leads to the entry of the next chunk that takes its state.
        chunk = np.repeat(np.arange(len(kind)), high - low)
        entry = np.arange(first[-1]) - first[chunk] + low[chunk]
        none = int(first[-1])
        step = np.full(none + 1, none)
        goes = np.flatnonzero(np.append(linked[1:], False)[chunk])
        wanted = kind[chunk[goes] + 1] << 32 | images[entry[goes]].astype(np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        step[goes] = np.where(keys[at] == wanted, first[chunk[goes] + 1] + at - low[chunk[goes] + 1], none)
        steps, heads = [step], np.flatnonzero(~linked)
        for _ in range(int(np.diff(np.append(heads, len(kind))).max() - 1).bit_length() - 1):
            steps.append(steps[-1][steps[-1]])
        known = first[heads] + np.searchsorted(keys, kind[heads] << 32 | coming[heads]) - low[heads]
        for step in steps[::-1]:
            known = np.concatenate([known, step[known]])
        known = known[known != none]
        out = np.full(len(kind), UNKNOWN, np.int32)
        out[chunk[known]] = images[entry[known]]
        return out

    def follow(self, state: int, data: np.ndarray, out: np.ndarray) -> None:
        """One lane, byte by byte."""
        item, state, changes = self.table.item, int(state), []
        for column in data.tolist():
            packed = item(state, column)
            if packed < 0:
                packed = self.step(state, column)
                item = self.table.item
            state = packed >> 8
            changes.append((packed & 255) - 128)
        out[:] = changes

    def changes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Change of the number of tokens at each byte; ``starts`` marks the first byte of each piece."""
        if self.table.size > MOST_CELLS:
            self.empty()
        n, data = len(data), self.columns(data)
        lanes = -(-n // CHUNK)
        pad = lanes * CHUNK - n
        grid = np.concatenate([data, np.zeros(pad, data.dtype)]).reshape(lanes, CHUNK).T.copy()
        restart = np.concatenate([starts, np.zeros(pad, bool)]).reshape(lanes, CHUNK).T.copy()
        out = np.zeros((CHUNK, lanes), np.int8)
        end = self.run(np.zeros(lanes, np.int32), grid, restart, out)
        # Maps of the chunks without a border; nobody needs the state behind the last chunk.
        free = np.flatnonzero(~restart[:, :-1].any(0))
        if len(free):
            end[free] = self.composed(grid, free, end)
        # Heads: the bytes before a chunk's first border, from the end state of the chunk before.
        head = np.where(restart.any(0), restart.argmax(0), CHUNK)
        head[-1] = min(head[-1], CHUNK - pad)
        ready = np.flatnonzero(head > 0)
        ready = ready[ready > 0]
        if len(ready) < FEW:
            for k in ready.tolist():
                self.follow(end[k - 1], grid[: head[k], k], out[: head[k], k])
            return out.T.reshape(-1)[:n]
        ready = ready[np.argsort(-head[ready], kind="stable")]
        state = end[ready - 1]
        for j in range(int(head[ready[0]])):
            live = int(np.searchsorted(-head[ready], -j, "left"))  # lanes with a longer head
            part = np.zeros((1, live), np.int8)
            state[:live] = self.run(state[:live], grid[j : j + 1, ready[:live]], None, part)
            out[j, ready[:live]] = part[0]
        return out.T.reshape(-1)[:n]

    def counts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Number of tokens of each text of ``data``."""
        base, data = int(offsets[0]), data[offsets[0] : offsets[-1]]
        offsets = offsets - base
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(rows, np.int64)
        whole = data.tobytes()
        borders, extra, spans = offsets, np.zeros(rows, np.int64), []
        for text in self.vocabulary.special:
            mark, at = text.encode(), whole.find(text.encode())
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(mark) <= offsets[row + 1]:
                    extra[row] += 1
                    spans.append((at, at + len(mark)))
                    at = whole.find(mark, at + len(mark))
                else:
                    at = whole.find(mark, at + 1)
        if spans:
            borders = np.unique(np.concatenate([offsets, np.array(spans).ravel()]))
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(points), bool)
        first[np.searchsorted(lead, borders[borders < len(data)])] = True
        starts = np.zeros(len(data), bool)
        starts[lead[piece_starts(points, first)]] = True
        change = self.changes(data, starts)
        for a, b in spans:
            change[a:b] = 0
        total = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]] + extra


@lru_cache(1)
def transducer(path: str) -> Transducer:
    """The transducer of a file, kept by each worker process."""
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Bytes and tokens of each document, and whether it has more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            counts = [machine.counts(offsets[a : b + 1], data) for a, b in slices(offsets, TOGETHER)]
            tokens = pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), tokens, pc.greater(tokens, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
