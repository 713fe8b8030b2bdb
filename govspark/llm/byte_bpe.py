"""Byte-level BPE: file format, splitting into pieces, exact linear-time encoding, decoding.

The encoder takes all tokens inside a piece from an Aho-Corasick automaton, walks them longest
first and steps back where a token does not fit behind the one before it. Two tokens fit when the
merges of their joined bytes give these two tokens, which a table of merge pairs answers. At most
one sequence of fitting tokens covers each prefix, so a position that failed once never has to be
tried again and the walk is linear.

Nulls and empty texts have no tokens and decode to an empty text. Texts of any length are taken
whole. Rows are handled one by one, so ties, repeated rows and further columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.common import texts

# Fixed values of the byte-level format: white space and the pattern of pieces.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: Texts kept in a worker's memory before the memory is emptied.
REMEMBERED = 600_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens in merge order: the 256 bytes first, then one token for each merge."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, byte_of = stored["model"], byte_characters()
        if stored.get("normalizer") or stored["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level files are supported")
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.tokens: list[bytes] = [bytes([b]) for b in range(256)]
        index = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right = list(range(256)), list(range(256))
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            one, two = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if one + two in index:
                raise ValueError("a token that two merges make is not supported")
            pair = index[one], index[two]
            self.pairs[pair] = index[one + two] = len(self.tokens)
            self.tokens.append(one + two)
            self.left.append(pair[0])
            self.right.append(pair[1])
        self.ids = [ids[t] for t in self.tokens]
        self.index = index
        self.known_fits: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b``, joined, are encoded as these two tokens.

        Undoes the later of the two tokens next to the border again and again. If the tokens at
        the border have a merge that comes before the one just undone, it would have won.
        """
        key = a << 20 | b
        known = self.known_fits.get(key)
        if known is None:
            if len(self.known_fits) > REMEMBERED:
                self.known_fits.clear()
            known = self.known_fits[key] = self._undo(a, b)
        return known

    def _undo(self, a: int, b: int) -> bool:
        limit = len(self.tokens)
        while True:
            merged = self.pairs.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary(path)
        self.found = ahocorasick.Automaton()
        for i, token in enumerate(v.tokens):
            self.found.add_word(token.decode("latin-1"), i)
        self.found.make_automaton()
        self.size = [len(token) for token in v.tokens]
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.pieces = regex.compile(PIECE)
        self.specials = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None
        self.pieces_seen: dict[str, bytes] = {}
        self.seen = Remembered(self.unit)
        # The offset table: token id -> place in the joined bytes of all tokens.
        by_id = dict(zip(v.ids, v.tokens)) | {i: s.encode() for s, i in v.special.items()}
        ordered = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(t) for t in ordered], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.joined = np.frombuffer(b"".join(ordered), np.uint8)

    def piece(self, data: bytes) -> list[int]:
        """Tokens, in merge order, of one piece."""
        n, size, fits = len(data), self.size, self.vocabulary.fits
        known = self.vocabulary.known_fits.get
        at: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.found.iter(data.decode("latin-1")):
            at[end + 1 - size[token]].append(token)
        out: list[int] = []
        failed = bytearray(n + 1)
        place, here, last = 0, at[0], -1
        while place < n:
            while here:
                token = here.pop()  # the longest one not tried yet
                end = place + size[token]
                if not failed[end]:
                    if last < 0:
                        break
                    fit = known(last << 20 | token)
                    if fit or fit is None and fits(last, token):
                        break
            else:
                failed[place] = 1
                place -= size[out.pop()]
                last = out[-1] if out else -1
                here = at[place]
                continue
            out.append(token)
            last, place = token, end
            if place < n:
                here = at[place]
        return out

    def unit(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit numbers, of white space and the run of other characters behind it."""
        out = []
        for piece in self.pieces.findall(text):
            ids = self.pieces_seen.get(piece)
            if ids is None:
                if len(self.pieces_seen) > REMEMBERED:
                    self.pieces_seen.clear()
                order = self.vocabulary.ids
                ids = pack([order[t] for t in self.piece(piece.encode())])
                if len(piece) < 64:
                    self.pieces_seen[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. A special string in it is its own token, as in the library's default."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        parts = self.specials.split(text) if self.specials else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(pack([self.vocabulary.special[part]]))
            else:
                out.extend(map(self.seen.__getitem__, self.units.findall(part)))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        take = np.repeat(self.starts[ids] - ends + lengths, lengths)
        take += np.arange(len(take))
        return self.joined[take].tobytes()


class Remembered(dict):
    """A dict that makes missing values with a function; long keys are not kept."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) < 64:
            self[key] = value
        return value


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by each worker process."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The frame with a column ``ids`` (array of int) and ``decoded`` (text) behind its own columns.

    ``ids`` and ``decoded`` replace columns of the same names.
    """
    from pyspark.sql import types as T

    own = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    kept = docs.select(*[F.col(f"`{f.name}`") for f in own])
    schema = T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    at = [f.name for f in own].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = [coder.encode(x) for x in texts(batch.column(at))]
            decoded = [coder.decode(x).decode("utf-8", "replace") for x in ids]
            columns = [*batch.columns, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the decoded text, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for x in texts(batch.column(1)):
                ids = coder.encode(x)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                back = coder.decode(ids).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
