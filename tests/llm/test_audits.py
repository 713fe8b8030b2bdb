"""Source divergence, filter interactions and model scores against plain versions on small documents."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from govspark.llm import context_mixing, filter_audit, level_tables, shards

COLUMNS = "doc_id long, text string, lang string, source string, n string, term string, pattern int"


@pytest.fixture
def corpus(ready):
    """Rows of (id, text, lang, source) with further columns whose names clash."""

    def make(rows, parts=3):
        rows = [(*r, "x", "y", 1) for r in rows]
        return ready.createDataFrame(rows, COLUMNS).repartition(parts)

    return make


def some_rows():
    rng = random.Random(4)
    words = ["the", "Of", "naïve", "x1y", "漢字", "A", "b", "c;d", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "de", None, "a:b"]), rng.choice(["s0", "s0", "s0", *(f"s{k}" for k in range(7)), None])))
    rows += [rows[3], rows[3], (3, "other text", "en", "s1"), (None, rows[5][1], "en", "s0"), (None, None, None, None)]
    rows += [(900 + k, t, "en", "only") for k, t in enumerate([None, "", " \t\n", "x" * 30_000, "AB " * 4000, "$"])]
    return rows


def plain_divergence(rows, least, s):
    docs = [(r[2] or "", r[3] or "", Counter(w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, total, by = Counter(), Counter(), defaultdict(Counter)
        for _, source, found in (d for d in docs if d[0] == lang):
            df.update(found.keys())
            total.update(found)
            by[source].update(found)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)

        def price(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + s.scale * (counts[t] + 2) // (n + 2 * v) for t in kept}

        prices, whole = {a: price(c) for a, c in by.items()}, price(total)
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for a, p in prices.items():
            pairs = [(sum(far(p[t], q[t]) for t in kept), b) for b, q in prices.items() if b != a]
            terms = [(far(p[t], whole[t]), t) for t in kept if by[a][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, s.top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, a, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize(
    "s", [level_tables.Settings(), level_tables.Settings(least_documents=2, group=3, sources=2, terms=4, least_terms=1, columns=6)]
)
def test_divergence_equals_brute_force(corpus, s):
    rows = some_rows()
    got = level_tables.audit(corpus(rows), s).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, s.least_documents, s)


def test_joint_tables_hold_each_pair_of_levels(corpus, ready):
    priced = ready.createDataFrame(
        [("l", a, t, n, 9, a == "s", n + 5, 1) for t, levels in {"x": (1, 2), "y": (1, 2), "z": (3, 0)}.items() for a, n in zip("st", levels) if n],
        "lang string, source string, term string, n long, lang_n long, first boolean, p long, zero long",
    )
    got = level_tables.joint_tables(priced).groupBy("source", "level", "item", "item_level").agg(F.sum("terms").alias("n"))
    assert sorted(map(tuple, got.collect())) == [("s", 1, "s", 1, 2), ("s", 1, "t", 2, 2), ("s", 3, "s", 3, 1), ("t", 2, "t", 2, 2)]


def plain_audit(rows, labels, limits):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, lang, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < limits.least_words,
            "B": 100 * len(set(w)) < limits.least_distinct_percent * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > limits.most_upper_percent * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        parts[lang or ""].append(({c for c in fails if fails[c]}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        orders = ["".join(o) for o in permutations("ABCDE")]
        shapley = Counter()
        for order in orders:
            for failed, *_ in docs:
                shapley[next((c for c in order if c in failed), None)] += 1
        for order in orders:
            for k, c in enumerate(order):
                before = set(order[:k])
                here = [d for d in docs if c in d[0] and not d[0] & before]
                kept = sum(1 for d in docs if not d[0] & (before | {c}))
                redundant = sum(1 for d in docs if c in d[0] and d[0] & before)
                alone = sum(1 for d in docs if d[0] == {c})
                out.append((part, order, k + 1, kept, len(here), redundant, alone, sum(d[1] for d in here), sum(d[2] for d in here), shapley[c]))
    return sorted(out)


def test_filters_equal_brute_force(corpus, ready):
    rows = some_rows() + [(50 + k, "same words $ here", "en", "s") for k in range(30)]
    rng = random.Random(1)
    labels = [(rng.randrange(170), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1)]
    limits = filter_audit.Limits(least_words=20)
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    table = ready.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(corpus(rows), table, limits).select(*names)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels, limits)


def test_matrix_has_one_number_for_a_word(corpus):
    rows = [(k, "alpha beta beta", "en", "s") for k in range(9)] + [(9, "beta", "de", "s"), (10, "", "de", "s")]
    found = set()
    for row in filter_audit.matrix(corpus(rows, parts=5)).collect():
        bounds, columns, counts = (shards.unpacked(bytes(row[c]), t) for c, t in (("bounds", "i8"), ("columns", "i8"), ("counts", "i4")))
        for k, r in enumerate(row["rows"]):
            found.add((r["doc_id"], tuple(zip(columns[bounds[k] : bounds[k + 1]].tolist(), counts[bounds[k] : bounds[k + 1]].tolist()))))
    cells = dict(found)
    assert len({cells[k] for k in range(9)}) == 1 and sorted(n for _, n in cells[0]) == [1, 2]
    assert cells[9][0][0] in dict(cells[0]) and cells[10] == ()


def test_empty_tables(corpus, ready):
    none = corpus([]).limit(0)
    labels = ready.createDataFrame([], "doc_id long, quality int, toxic int")
    assert level_tables.audit(none).count() == 0
    assert filter_audit.audit(none, labels).count() == 0
    assert context_mixing.score(none, F.lit(False)).count() == 0


# ------------------------------------------------------------------ model scores

def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_scores(rows, s):
    """Bit by bit, with contexts themselves in place of their hashes and the weights not fitted."""
    learned = [tokens(t) for i, t, *_ in rows if not held(i)]
    counts = Counter(w for d in learned for w in d)
    frequent = sorted(((w, n) for w, n in counts.items() if n > 1), key=lambda x: (-x[1], x[0].encode()))
    rank = {w: k for k, (w, _) in enumerate(frequent)}
    end, escape = len(rank), len(rank) + 1
    others = sum(n for w, n in counts.items() if w not in rank)
    letters = Counter("".join(w for w, _ in frequent).encode())

    def codes(weights):
        parent, side, weight = context_mixing.huffman(weights)
        out = []
        for leaf in range(len(weights)):
            at, path = leaf, []
            while at != len(parent) - 1:
                path.append((int(parent[at]), int(side[at])))
                at = parent[at]
            out.append(path[::-1])
        return out, weight

    words, weight = codes([n for _, n in frequent] + [max(1, len(learned)), max(1, others)])
    spelled, _ = codes([1 + letters[b] + (len(rank) if b == 32 else 0) for b in range(256)])

    def units(text):
        """Words, then escaped words: contexts and bits of each, and what no predictor tells."""
        found = [*tokens(text), None]
        symbols = [end if w is None else rank.get(w, escape) for w in found]
        named = [x + 100 if x < context_mixing.COMMON else int(math.log2(x + 1)) for x in symbols]
        rest, before, last = 0.0, None, None
        plain, bytewise = [], []
        for w, symbol, name in zip(found, symbols, named):
            path = words[symbol]
            plain.append([((0, node), (0, last, node), (0, before, node), bit, k) for k, (node, bit) in enumerate(path[: s.depth])])
            if len(path) > s.depth:
                rest += math.log2(weight[path[s.depth][0]] / weight[symbol])
            if symbol == escape:
                body, bits = w.encode() + b" ", []
                for k, b in enumerate(body):
                    back = [tuple(body[max(0, k - m) : k]) for m in (1, 2, 3)]
                    bits += [(*((m, c, node) for m, c in enumerate(back, 1)), bit, j) for j, (node, bit) in enumerate(spelled[b])]
                bytewise.append(bits)
            before = name
            last = name if symbol < context_mixing.FREQUENT else last
        return plain, bytewise, rest

    table = defaultdict(lambda: [0, 0])
    for i, text, *_ in rows:
        if not held(i):
            for stream in units(text)[:2]:
                for unit in stream:
                    for *contexts, bit, _ in unit:
                        for k, c in enumerate(contexts):
                            table[k, c][bit] += 1
    place = [0, 1, 2, 2, 3, 3, 3, 3] + [4] * 248
    n = sum(counts.values()) + len(learned)
    kinds = len(counts) + (len(learned) > 0)
    out = []
    for i, text, *_ in rows:
        found = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in found) + math.log10((len(learned) + 1) / (n + kinds + 1))
        *streams, spent = units(text)
        for stream in streams:
            weights = defaultdict(lambda: list(s.weights))
            for at in range(0, len(stream), s.block):
                gain, curve = defaultdict(lambda: [0.0] * 3), defaultdict(float)
                for unit in stream[at : at + s.block]:
                    for *contexts, bit, k in unit:
                        st = []
                        for order, c in enumerate(contexts):
                            zeros, ones = table.get((order, c), (0, 0))
                            st.append(math.log(ones + s.start) - math.log(zeros + s.start))
                        seen = 2 if st[2] else 1 if st[1] else 0
                        gate = place[k], seen
                        z = max(-12, min(12, sum(w * x for w, x in zip(weights[gate], st))))
                        right = 1 / (1 + math.exp(-z if bit else z))
                        spent -= math.log2(right)
                        for m in range(3):
                            gain[gate][m] += (1 - right) * (1 if bit else -1) * st[m]
                        curve[gate] += right * (1 - right) * sum(x * x for x in st)
                for gate in gain:
                    for m in range(3):
                        weights[gate][m] += gain[gate][m] / (curve[gate] + s.steady)
        known = sum(counts[w] > 0 for w in found) + (len(learned) > 0)
        out.append((i, held(i), len(found) + 1, known, n, round(base, 6), -spent * math.log10(2)))
    return sorted(out, key=str)


def test_scores_equal_brute_force(corpus, odd):
    rows = some_rows() + [(1000 + k, t, None, None) for k, (_, t) in enumerate(odd) if len(t or "") < 6000]
    s = context_mixing.Settings(steps=0, depth=5, block=7, lanes=5, slot_bits=22)
    frame = context_mixing.score(corpus(rows), held_out(), s)
    got = [(*r[:5], round(r[5], 6), r[6]) for r in frame.collect()]
    expected = plain_scores(rows, s)
    got = sorted(got, key=str)
    assert [r[:6] for r in got] == [r[:6] for r in expected]
    # Contexts share a slot now and then; the plain version has none that do.
    far = [r for r, e in zip(got, expected) if r[6] != pytest.approx(e[6], rel=2e-3, abs=0.02)]
    assert len(far) <= 2


def test_training_helps_and_texts_do_not_depend_on_their_partition(corpus):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    follow = {w: rng.sample(words, 3) for w in words}

    def text():
        w, out = rng.choice(words), []
        for _ in range(rng.randint(20, 80)):
            out.append(w)
            w = rng.choice(follow[w])
        return " ".join(out)

    rows = [(i, text(), "en", "s") for i in range(600)]
    frames = [context_mixing.score(corpus(rows, parts=p), held_out()).collect() for p in (1, 4)]
    one, other = ({r["doc_id"]: r["score"] for r in f} for f in frames)
    assert one == pytest.approx(other, rel=1e-4)
    unseen = [r for r in frames[0] if r["held_out"]]
    # Three words can follow a word: the model must find that, word counts cannot.
    assert sum(r["score"] for r in unseen) > 0.6 * sum(r["base_score"] for r in unseen)


def test_code_is_a_full_tree():
    parent, side, weight = context_mixing.huffman([5, 1, 1, 7, 3])
    paths = context_mixing.paths(parent, side, weight, 99)
    lengths = [int(b - a) for a, b in zip(paths.starts[:-1], paths.starts[1:])]
    assert sum(2.0**-n for n in lengths) == 1 and lengths[3] == min(lengths)


def test_starting_weights_learn_from_all_training_documents(corpus, monkeypatch):
    rows = [(i, "ab cd", "en", "s") for i in range(6000)]
    told, fitted = [], context_mixing.fitted
    monkeypatch.setattr(context_mixing, "fitted", lambda cells, counts, s: told.append(counts.sum()) or fitted(cells, counts, s))
    context_mixing.score(corpus(rows), held_out())
    # Both words, the end and the escape: four paths of two bits, three of them taken in each document.
    assert told == [6 * sum(not held(r[0]) for r in rows)]


def test_bits_of_units_that_are_alike_are_told_once(monkeypatch):
    monkeypatch.setattr(context_mixing.shards, "numbers", lambda: iter(range(9)))
    texts = ["ab cd ab cd new", "cd other new"] * 100
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(200), pa.int64()), "held": [False] * 200, "text": texts})
    rows = list(context_mixing._local(iter([batch])))
    model = context_mixing.coder([("cd", 300), ("ab", 200)], 200, 300, context_mixing.Settings())
    told, run = [], {}
    for kind in (context_mixing.WordBits, context_mixing.ByteBits):
        run[kind] = kind.__call__
        monkeypatch.setattr(kind, "__call__", lambda self, units, kind=kind: told.append((kind, len(units))) or run[kind](self, units))
    parts = list(context_mixing.tallied(type("Held", (), {"value": model}))(iter(rows)))
    # Pairs of a symbol and the one before: five in the first text, two more in the other one. Two words are spelled.
    assert told == [(context_mixing.WordBits, 7), (context_mixing.ByteBits, 2)]
    tokens = model.word_paths.starts[1:] - model.word_paths.starts[:-1]
    letters = model.byte_paths.starts[1:] - model.byte_paths.starts[:-1]
    bits = sum(n * int(tokens[k]) for n, k in ((300, 0), (200, 1), (200, 2), (300, 3)))
    bits += sum(int(letters[b]) for t in texts for w in t.split() if w not in ("ab", "cd") for b in (w + " ").encode())
    counted = [(k, n.sum()) for part in parts for k, _, n in context_mixing._counts(part)]
    assert [sum(n for k, n in counted if k == order) for order in range(context_mixing.ORDERS)] == [bits] * 3


def test_newton_steps_find_the_weights_that_tell_the_cells_best():
    rng = np.random.default_rng(5)
    size = context_mixing.LEVELS**context_mixing.ORDERS
    cells = np.unique(rng.integers(0, size, 400)) + 4 * size
    counts = rng.integers(1, 900, len(cells))
    s = context_mixing.Settings(steps=30, ridge=0.001)
    found = context_mixing.fitted(cells, counts, s)
    assert (np.delete(found, 4, 0) == np.array(s.weights, np.float32)).all()
    levels = np.stack(np.unravel_index(cells - 4 * size, (context_mixing.LEVELS,) * 3), 1)
    x = (levels - context_mixing.REACH) * context_mixing.UNIT
    slope = x.T @ (counts / (1 + np.exp(np.clip(x @ found[4].astype(float), -12, 12))))
    assert (np.abs(slope) < 1e-3 * (np.abs(x).T @ counts)).all()


def test_bits_under_the_same_contexts_are_looked_up_once_a_shard(monkeypatch):
    monkeypatch.setattr(context_mixing.shards, "numbers", lambda: iter(range(9)))
    # Spelled words of two letters; the words after them differ in rank, not in their path's first two steps.
    spelled = ["ab" * k for k in range(1, 60)]
    known = [f"w{k}" for k in range(64)]
    texts = [" ".join(spelled), " ".join(known * 5)] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6), pa.int64()), "held": [False] * 6, "text": texts})
    (local,) = context_mixing._local(iter([batch]))
    s = context_mixing.Settings(depth=2)
    model = context_mixing.coder([(w, 15) for w in known], 6, 900, s)
    held = type("Held", (), {"value": model})
    looked, slot = [], context_mixing._slot
    monkeypatch.setattr(context_mixing, "_slot", lambda c, n, b: looked.append(np.broadcast(c, n).size) or slot(c, n, b))
    parts = list(context_mixing.tallied(held)(iter([local])))
    longest = int(np.diff(model.byte_paths.starts).max())
    # A letter has at most 6 different beginnings of up to 3 letters before it, the blank 4.
    spelled_most = 3 * longest * 16
    words_most = 3 * 2 * 4 * (len(known) + 4)
    assert sum(looked) <= spelled_most + words_most
    bits = [sum(int(n.sum()) for part in parts for k, _, n in context_mixing._counts(part) if k == order) for order in range(3)]
    lengths, letters = np.diff(model.word_paths.starts), np.diff(model.byte_paths.starts)
    told = 3 * (59 * lengths[model.escape] + 5 * sum(lengths[:64]) + 2 * lengths[model.end])
    told += 3 * sum(int(letters[b]) for w in spelled for b in (w + " ").encode())
    assert bits == [told] * 3
    looked.clear()
    logits = np.random.default_rng(3).normal(size=(3, 1 << s.slot_bits)).astype(np.float32)
    weights = np.tile(np.array(s.weights, np.float32), (context_mixing.GATES, 1))
    lengths = context_mixing.code_lengths(model, logits, weights, context_mixing.opened(model, next(context_mixing._rows(local))))
    assert sum(looked) <= spelled_most + words_most
    assert lengths[0] == lengths[2] and lengths[1] == lengths[5]


def test_keys_too_wide_for_one_number_are_ordered_alike():
    keys = np.random.default_rng(4).integers(0, 50, 1000)
    order, starts = context_mixing._ordered(keys)
    far, wide = context_mixing._ordered(keys << 56)
    assert (order == far).all() and (starts == wide).all() and len(starts) == 50
    assert (order == np.argsort(keys, kind="stable")).all()
    first, entry = context_mixing._entries(keys)
    assert (keys[first][entry] == keys).all() and (np.diff(first) > 0).all()
