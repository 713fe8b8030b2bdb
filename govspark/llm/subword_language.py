"""Language identification: hashed subword embeddings, averaged, with a linear softmax.

A text is the average of the embeddings of its subwords: overlapping runs of bytes of its words,
hashed into a fixed number of buckets. A linear layer and a softmax give the probabilities. Both
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. Part of
the sample is held back to calibrate, together with noise made of its rows: shuffled bytes, bytes
of other scripts, hexadecimal digits. A temperature makes the probabilities match the hits and
leaves noise undecided. A softmax cannot tell a text of none of the languages, so a text has a
familiarity besides: the mean log likelihood of its subwords in the predicted language over that
of all buckets alike. A prediction is rejected if its probability or its familiarity is below a
border. That of the probability lies midway between chance and the correct predictions; that of
the familiarity, by language, midway between noise and the rows of all other languages on one
side and the correct predictions on the other. Where these overlap, the border is set so that a
given share of the correct predictions is lost.

Only the text is read for a prediction. A null text and a text without a letter are ``und`` with
score 0 and count as rejected; a text of one letter alone has no subword and is rejected. Rows
with a null id are not held out and not learned from, rows with a null language are not learned
from. If nothing can be learned, every text is ``und``.
Ties go to the language that comes first in order. Repeated rows get the same prediction; further
columns are ignored by ``predict`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.llm.common import slices, utf8

UND = "und"


@dataclass(frozen=True)
class Settings:
    #: Bound of the sample: labelled rows that are learned from or calibrated with.
    sample: int = 4000
    buckets: int = 1 << 14
    width: int = 16
    lengths: tuple[int, ...] = (2, 3, 4)
    epochs: int = 12
    #: Steps at least: a small sample is gone through more often.
    steps: int = 1200
    rate: float = 0.5
    batch: int = 64
    seed: int = 11
    calibrate: float = 0.25
    #: Largest share of correct predictions that rejection may lose.
    lost: float = 0.0005
    #: Bytes of a noise text at most, and the correct predictions that a language's own border needs.
    noise: int = 1024
    enough: int = 20


def _letters() -> np.ndarray:
    """What each byte becomes: lower case, and one separator for all that is no letter."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        table[b] = ord(chr(b).lower()) if chr(b).isalpha() else 32
    return table


LETTERS = _letters()
HAS_LETTER = regex.compile(r"\p{L}")


def subwords(offsets: np.ndarray, data: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every subword of the texts; subwords do not span two separators."""
    base, data = int(offsets[0]), LETTERS[data[offsets[0] : offsets[-1]]].astype(np.uint64)
    offsets, rows, buckets = offsets - base, [], []
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shift = np.uint64(64 - int(settings.buckets).bit_length() + 1)
    for n in settings.lengths:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        inside = row_of[n - 1 :] == row_of[: len(row_of) - n + 1]
        for k in range(n):
            part = data[k : len(data) - n + 1 + k]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(29))
            if 0 < k < n - 1:
                inside &= part != 32
        rows.append(row_of[: len(h)][inside])
        buckets.append((h >> shift)[inside].astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def noise_of(data: np.ndarray, key: int, settings: Settings) -> np.ndarray:
    """What a text's bytes become as noise, by its key: shuffled, other scripts, or hex digits."""
    data, rng = data[: settings.noise], np.random.default_rng(key & 0x7FFFFFFFFFFFFFFF)
    if key % 3 == 0:
        return rng.permutation(data)
    if key % 3 == 1:
        return np.where(LETTERS[data] == 32, 32, rng.integers(128, 256, len(data))).astype(np.uint8)
    return np.frombuffer(b"0123456789abcdef", np.uint8)[rng.integers(0, 16, len(data))]


def border(right: np.ndarray, wrong: np.ndarray, lost: float) -> float:
    """Midway between nearly all of ``wrong`` and ``right``, or where the share ``lost`` of ``right`` is below."""
    low = float(np.quantile(right, lost))
    return low - max(0.0, low - float(np.quantile(wrong, 0.99))) / 2 if len(wrong) else low


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    #: Log likelihood ratio of each bucket in each language, and the least mean by language.
    known: np.ndarray
    least_known: np.ndarray
    settings: Settings

    def logits(self, rows: np.ndarray, buckets: np.ndarray, count: int) -> np.ndarray:
        """Before the softmax, by row. The average commutes with the layer, so buckets are mapped once."""
        mapped = self.embeddings @ self.layer
        sums = np.stack([np.bincount(rows, mapped[buckets, j], count) for j in range(len(self.languages))], 1)
        n = np.bincount(rows, minlength=count)
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def foreign(self, rows: np.ndarray, buckets: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Rows less familiar than texts of the predicted language are."""
        weight = (buckets != blank(self.settings)).astype(np.float64)
        n = np.bincount(rows, weight, len(best))
        sums = np.bincount(rows, weight * self.known[buckets, best[rows]], len(best))
        return (n == 0) | (sums / np.maximum(n, 1) < self.least_known[best])

    def predict(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, probability, and whether the text is foreign to it, by row."""
        rows, buckets = subwords(offsets, data, self.settings)
        p = softmax(self.logits(rows, buckets, len(offsets) - 1) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best], self.foreign(rows, buckets, best)


class Bags:
    """Buckets, counts and shares of the rows of a sample, each in one flat array."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ends = np.cumsum([0, *(len(b) for b, _ in pairs)]).tolist()
        self.buckets, self.counts = (np.empty(self.ends[-1], np.int32) for _ in range(2))
        self.weights = np.empty(self.ends[-1], np.float32)
        for (b, c), i, j in zip(pairs, self.ends, self.ends[1:]):
            self.buckets[i:j], self.counts[i:j], self.weights[i:j] = b, c, c / max(int(c.sum()), 1)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[i], self.ends[i + 1]
        return self.buckets[a:b], self.counts[a:b]

    def shares(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[i], self.ends[i + 1]
        return self.buckets[a:b], self.weights[a:b]


def packed(buckets: np.ndarray, counts: np.ndarray, settings: Settings) -> bytes:
    """Bytes of a count, then buckets and counts in the narrowest integers."""
    kind = next(t for t in ("<u1", "<u2", "<u4") if counts.max(initial=0) <= np.iinfo(t).max)
    return b"".join([kind[-1].encode(), buckets.astype(_kind(settings)).tobytes(), counts.astype(kind).tobytes()])


def unpacked(data: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    kind, wide = np.dtype(f"<u{chr(data[0])}"), np.dtype(_kind(settings))
    n = (len(data) - 1) // (wide.itemsize + kind.itemsize)
    return np.frombuffer(data, wide, n, 1), np.frombuffer(data, kind, n, 1 + n * wide.itemsize)


def _kind(settings: Settings) -> str:
    return "<u2" if settings.buckets <= 1 << 16 else "<u4"


def blank(settings: Settings) -> int:
    """Bucket of two separators, which says nothing about a text."""
    return int(subwords(np.array([0, 2]), np.full(2, 32, np.uint8), replace(settings, lengths=(2,)))[1][0])


def likelihoods(features: Bags, rows: np.ndarray, y: np.ndarray, languages: int, settings: Settings) -> np.ndarray:
    """Log likelihood of each bucket in each language, over that of all buckets alike."""
    seen = np.full((settings.buckets, languages), 0.5)
    for i in rows:
        b, c = features[i]
        seen[b, y[i]] += c
    seen[blank(settings)] = 0.5
    return np.log(seen * settings.buckets / seen.sum(0)).astype(np.float32)


def familiarity(features: Bags, rows: np.ndarray, known: np.ndarray, settings: Settings) -> np.ndarray:
    """Mean log likelihood of the subwords of each of the rows in each language."""
    skip, out = blank(settings), np.zeros((len(rows), known.shape[1]))
    for row, i in zip(out, rows):
        b, c = features[i]
        c = np.where(b == skip, 0, c)
        row[:] = c @ known[b] / max(c.sum(), 1)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(features: Bags, labels: list[str], settings: Settings, noise: Bags) -> Model | None:
    """Train on rows of (bucket, count) pairs, then calibrate on those held back and on noise."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(settings.seed)
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(y))
    held = order[: int(len(y) * settings.calibrate)]
    train = order[len(held) :]
    embeddings = rng.normal(0, 0.1, (settings.buckets, settings.width))
    layer = np.zeros((settings.width, len(languages)))
    bias = np.zeros(len(languages))

    def averages(of: Bags, rows: np.ndarray) -> np.ndarray:
        return np.array([s @ embeddings[b] for b, s in map(of.shares, rows)]).reshape(-1, settings.width)

    parts, step = max(1, -(-len(train) // settings.batch)), 0
    epochs = max(settings.epochs, -(-settings.steps // parts))
    steps = epochs * parts
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), parts):
            rate = settings.rate * (1 - step / steps)
            step += 1
            x = averages(features, part)
            error = softmax(x @ layer + bias)
            error[np.arange(len(part)), y[part]] -= 1
            back = error @ layer.T
            layer -= rate * (x.T @ error) / max(len(part), 1) * 10
            bias -= rate * error.mean(0)
            for (b, s), g in zip(map(features.shares, part), back):
                embeddings[b] -= rate * 10 * s[:, None] * g
    known = likelihoods(features, train, y, len(languages), settings)
    # As likely as in all buckets alike: the least where too few rows are held back to tell.
    model = Model(languages, embeddings, layer, bias, 1.0, 0.0, known, np.zeros(len(languages)), settings)
    if len(held):
        every = np.arange(len(noise))
        raw, other = (averages(*x) @ layer + bias for x in ((features, held), (noise, every)))

        def loss(t: float) -> float:
            p = np.maximum(softmax(raw / t)[np.arange(len(held)), y[held]], 1e-12)
            # Noise belongs to each language alike, which keeps the temperature from sharpening to the end.
            q = np.maximum(softmax(other / t), 1e-12)
            return float(-np.log(p).mean() - (np.log(q).mean() if len(q) else 0.0))

        model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
        p = softmax(raw / model.temperature)
        hit = p.argmax(1) == y[held]
        if hit.any():
            model.least = border(p.max(1)[hit], np.full(1, 1 / len(languages)), settings.lost)
            near, far = (familiarity(f, rows, known, settings) for f, rows in ((features, held), (noise, every)))
            for k in range(len(languages)):
                right = near[hit & (y[held] == k), k]
                if len(right) >= settings.enough:
                    wrong = np.concatenate([near[y[held] != k, k], far[:, k]])
                    model.least_known[k] = border(right, wrong, settings.lost)
    return model


def counted_subwords(offsets: np.ndarray, data: np.ndarray, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their counts."""
    rows, buckets = subwords(offsets, data, settings)
    cells, n = np.unique(rows * settings.buckets + buckets, return_counts=True)
    ends = np.searchsorted(cells, np.arange(1, len(offsets)) * settings.buckets)
    return [((cells[i:j] % settings.buckets).astype(np.int32), n[i:j].astype(np.int32)) for i, j in zip([0, *ends[:-1]], ends)]


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def learn(docs: DataFrame, held_out: Column, settings: Settings = Settings()) -> Model | None:
    """Train on the rows of ``doc_id``, ``text`` and ``lang`` that are not held out.

    The sample is the rows with the smallest hashes of their id. Their subword counts, not their
    texts, go to the driver: at most ``sample`` rows of at most ``buckets`` pairs. Some of them
    bring the counts of a short noise text along.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    key = F.xxhash64(F.col("doc_id"), F.lit(settings.seed))
    smallest = known.select(key.alias("key")).orderBy("key").limit(settings.sample)
    last = smallest.agg(F.max("key")).first()[0]
    if last is None:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            pairs = [p for a, b in slices(offsets) for p in counted_subwords(offsets[a : b + 1], data, settings)]
            noise = []
            for key, i, j in zip(batch.column(0).to_pylist(), offsets, offsets[1:]):
                # Another part of the key than the one that picks the kind.
                some = i < j and key // 3 % 4 == 0
                made = noise_of(data[i:j], key, settings) if some else data[:0]
                noise += counted_subwords(np.array([0, len(made)]), made, settings)
            columns = [pa.array([packed(*p, settings) for p in x], pa.binary()) for x in (pairs, noise)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["key", "lang", "bag", "noise"])

    chosen = known.select(key.alias("key"), F.col("lang").cast("string"), F.col("text").cast("string")).filter(F.col("key") <= last)
    counted = chosen.mapInArrow(count, "key long, lang string, bag binary, noise binary")
    table = counted.orderBy("key", "lang", "bag", "noise").limit(settings.sample).toArrow()
    if not table.num_rows:
        return None

    def bags(name: str, least: int) -> Bags:
        pairs = (unpacked(np.frombuffer(v.as_buffer(), np.uint8), settings) for v in table[name])
        return Bags([x for x in pairs if len(x[0]) >= least])

    labels, rows, noise = table["lang"].to_pylist(), bags("bag", 0), bags("noise", 1)
    del table
    pa.default_memory_pool().release_unused()
    return fit(rows, labels, settings, noise)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The frame with ``lang_pred``, ``score`` and ``rejected`` behind its own columns.

    The three replace columns of the same names.
    """
    new = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
    ]
    own = [f for f in docs.schema.fields if f.name not in {f.name for f in new}]
    at = [f.name for f in own].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(at))
            spoken = np.array([bool(x) and bool(HAS_LETTER.search(x)) for x in batch.column(at).to_pylist()], bool)
            best, score, strange = np.zeros(len(spoken), np.int64), np.zeros(len(spoken)), np.zeros(len(spoken), bool)
            if model is None:
                spoken[:] = False
            else:
                for a, b in slices(offsets):
                    best[a:b], score[a:b], strange[a:b] = model.predict(offsets[a : b + 1], data)
            names = [model.languages[k] if s else UND for k, s in zip(best.tolist(), spoken.tolist())]
            score = np.where(spoken, score, 0.0)
            rejected = ~spoken | strange | (score < (model.least if model else 0.0))
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in (*own, *new)])

    kept = docs.select(*[F.col(f"`{f.name}`") for f in own])
    return kept.mapInArrow(run, T.StructType([*own, *new]))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose prediction is not rejected, with their own columns."""
    marked = predict(docs.withColumn("__text", F.col("text").cast("string")), model, "__text")
    return marked.filter(~F.col("rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])
