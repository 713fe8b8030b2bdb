"""Near copies, repeated passages, budgets, quality and languages on small documents."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from govspark.llm import budgets, divergence, jaccard_trees, subword_language, suffix_dedup


def plain_groups(rows, s):
    sets = []
    for _, text in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^ \t-\r]+", folded)
        grams = {tuple(w[k : k + s.words]) for k in range(len(w) - s.words + 1)} if len(w) >= s.words else {tuple(w)}
        sets.append(grams if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= s.percent * (len(sets[a]) + len(sets[b]) - shared):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted([(i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)], key=str)


def near_copies():
    rng = random.Random(5)
    words = ["the", "of", "And", "x", *(f"w{k}" for k in range(60))]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    rows = []
    for i in range(250):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[k] = rng.choice(words)
            elif len(w) > 2:
                w.pop(k)
        rows.append((i, " ".join(w)))
    return rows + [(None, rows[3][1]), (900, "ONE  two"), (901, "one two"), (902, "a"), (902, "b c d e f g")]


@pytest.mark.parametrize("s", [jaccard_trees.Settings(sample=2), jaccard_trees.Settings(sample=1, tile=3, fan=2, bits=64)])
def test_groups_equal_brute_force(frame, odd, s):
    rows = near_copies() + odd
    got = sorted(map(tuple, jaccard_trees.joined(frame(rows), s).collect()), key=str)
    assert got == plain_groups(rows, s)


def test_pairs_that_share_many_tokens_come_from_one_bucket(ready, monkeypatch):
    s = jaccard_trees.Settings()
    tokens = np.arange(1, 61, dtype=np.uint64) * np.uint64(7)
    rows = []
    for key in (5, 6):
        own = np.append(tokens, np.uint64(1000 + key))
        marks = bytearray(jaccard_trees.signature(own, s.bits)), bytearray(jaccard_trees.counted(own))
        rows += [(int(t), key, 61, key, *marks, 2, [int(x) for x in tokens[: jaccard_trees.LEAST]]) for t in tokens]
    members = ready.createDataFrame(rows, "token long, key long, n long, comp long, signature binary, cells binary, count long, least array<long>")
    monkeypatch.setattr(type(members), "distinct", lambda df: df)
    got = [tuple(r) for r in jaccard_trees.bucket_pairs(members.repartition(4), s).collect()]
    assert got == [(5, 6)]


def test_pairs_of_a_bucket_with_its_centre_are_no_work_of_the_trees(frame, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:52])), (3, "other words of a third text"), (4, " ".join(words[:40] + ["x"]))]
    seen, trees = [], jaccard_trees.bucket_pairs
    monkeypatch.setattr(jaccard_trees, "bucket_pairs", lambda members, s: seen.append(members.select("token", "key").collect()) or trees(members, s))
    for some in (rows[:1] + rows[2:], rows):
        got = sorted(map(tuple, jaccard_trees.joined(frame(some)).collect()))
        assert got == plain_groups(some, jaccard_trees.Settings())
    # Two classes meet in the first case, and one of them is the centre of each bucket.
    assert seen[0] == [] and len({key for _, key in seen[1]}) <= 2


def bucket_of(count, shared, s):
    """Sizes, bitmaps, components and cells of sets that have ``shared`` of 600 tokens in common, and the sets."""
    rng = np.random.default_rng(4)
    common, own = rng.integers(1, 1 << 62, 600, np.uint64), rng.integers(1, 1 << 62, (count, 600), np.uint64)
    sets = [np.unique(np.concatenate([common[:n], row[n:]])) for n, row in zip(shared, own)]
    bitmaps = np.stack([jaccard_trees.folded(jaccard_trees.signature(x, s.bits), s.bits // 8) for x in sets])
    cells = np.stack([np.frombuffer(jaccard_trees.counted(x), np.uint8) for x in sets])
    return (np.array([len(x) for x in sets]), bitmaps, np.arange(count) // 2, cells), sets


def test_memory_of_a_tree_does_not_follow_its_pairs():
    s, count = jaccard_trees.Settings(), 1500
    bucket, _ = bucket_of(count, [516] * count, s)
    tracemalloc.start()
    pairs = sum(len(i) for i, _ in jaccard_trees.tree_pairs(*bucket, s))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs > 0.99 * count * (count - 1) / 2 and peak < 100e6


@pytest.mark.parametrize("block", [1, 100, 1 << 17])
def test_blocks_of_a_tree_give_each_pair_once(monkeypatch, block):
    monkeypatch.setattr(jaccard_trees, "BLOCK", block)
    s = jaccard_trees.Settings(fan=4)
    bucket, sets = bucket_of(90, [590 - 5 * k for k in range(90)], s)
    found = [tuple(sorted(p)) for i, j in jaccard_trees.tree_pairs(*bucket, s) for p in zip(i.tolist(), j.tolist())]
    assert len(found) == len(set(found)) and all(a // 2 != b // 2 for a, b in found)
    linked = set()
    for b in range(90):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b]))
            if a // 2 != b // 2 and 100 * both >= s.percent * (len(sets[a]) + len(sets[b]) - both):
                linked.add((a, b))
    assert linked and linked <= set(found) and len(found) < 90 * 89 / 2


def test_a_full_bucket_gives_all_its_pairs(ready):
    s = jaccard_trees.Settings()
    (sizes, bitmaps, _, cells), _ = bucket_of(60, [516] * 60, s)
    rows = [(7, k, int(sizes[k]), k, bytearray(bitmaps[k].tobytes()), bytearray(cells[k].tobytes()), [7] + [jaccard_trees.NONE] * 7, 60) for k in range(60)]
    schema = "token long, key long, n long, comp long, signature binary, cells binary, least array<long>, count long"
    got = [tuple(r) for r in jaccard_trees.bucket_pairs(ready.createDataFrame(rows, schema), s).collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_one_of_each_group_stays(frame):
    rows = near_copies()
    kept = sorted(r["doc_id"] for r in jaccard_trees.one_of_each(frame(rows)).collect())
    groups = plain_groups(rows, jaccard_trees.Settings())
    assert kept == sorted([i for i, _, g in groups if i is not None and i == g])


def test_sets_come_once_by_class(frame):
    s = jaccard_trees.Settings()
    docs = frame([(1, "one two three four five six")] * 5 + [(2, "other words " * 9), (2, "other words " * 9)])
    rows = docs.select(budgets.F.xxhash64("doc_id", "text").alias("row"))
    assert jaccard_trees.whole_sets(docs, rows, s).count() == 2


def test_one_row_of_repeated_and_null_rows_stays(frame):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(150)) for _ in range(4))
    # Twice the same row; an id with two texts, one of them a copy of a smaller id's; null ids.
    rows = [(1, a), (1, a), (2, b), (2, a), (None, c), (None, c + " end"), (None, d), (7, d), (8, ""), (8, "")]
    docs = frame(rows + rows)
    kept = jaccard_trees.one_of_each(docs)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    null = [k for k in got if k[0] is None]
    assert len(null) == 1 and null[0][1] in (c, c + " end")
    assert got == Counter({(1, a): 1, (2, b): 1, (7, d): 1, (8, ""): 4, null[0]: 1})
    left = {r["text"] for r in suffix_dedup.without_repeats(kept).collect()}
    assert {a, b, d} <= left


def plain_removal(rows, length):
    places = Counter()
    for _, text in rows:
        data = (text or "").encode()
        places.update(data[p : p + length] for p in range(len(data) - length + 1))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if places[data[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("together", [20_000, 1])
def test_removal_equals_brute_force(frame, odd, together):
    rng = random.Random(3)
    base = "".join(rng.choice("ab cdé") for _ in range(3000))
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            a, k = rng.randint(0, 2900), rng.random()
            parts.append(base[a : a + rng.randint(5, 120)] if k < 0.5 else "x" * rng.randint(1, 90) if k < 0.6 else base[a : a + 9][::-1])
        rows.append((i, "".join(parts)))
    rows += [(i, t) for i, t in odd if len(t or "") < 6000]
    s = suffix_dedup.Settings(40, 20, 8, together)
    got = sorted(map(tuple, suffix_dedup.removal_digests(frame(rows), s).collect()), key=str)
    assert got == plain_removal(rows, 40)


def test_texts_without_repeats_keep_their_columns(frame):
    docs = frame([(1, "ab" * 300 + "end"), (2, None), (3, "only once")])
    out = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert out[1]["text"] == "end" and out[1]["n_chars"] == 3 and out[1]["n_words"] == "x"
    assert out[2]["text"] is None and out[3]["text"] == "only once"


def test_empty_documents_table(frame):
    docs = frame([(1, "a")]).filter("doc_id < 0")
    assert jaccard_trees.joined(docs).count() == suffix_dedup.removal_digests(docs).count() == 0
    assert budgets.mixed(docs).count() == divergence.judge(docs).count() == 0
    assert subword_language.learn(docs, docs["doc_id"] == 0) is None


def fill(children, budget):
    """Shares of a budget by weight, step by step: whoever is full gives back."""
    out, open_ = {}, dict(children)
    while open_:
        rate = (budget - sum(out.values())) / sum(w for w, _ in open_.values())
        full = {k: room for k, (w, room) in open_.items() if room <= rate * w + 1e-9}
        if not full:
            return out | {k: rate * w for k, (w, _) in open_.items()}
        out |= full
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def test_budgets_fill_siblings_before_ancestors(ready):
    mix = budgets.Mix(share=0.5, epochs=1, weights={"domain": {"web": 1.0, "books": 3.0}})
    rows = [("web", "en", "a", 1, 900), ("web", "de", "b", 1, 100), ("books", "en", "c", 1, 300), ("books", "en", "d", 1, 40), ("rest", "", "", 1, 60)]
    leaves = ready.createDataFrame(rows, "domain string, lang string, source string, docs long, tokens long")
    got = {r["source"]: r["budget"] for r in budgets.leaf_budgets(leaves, mix).collect()}
    top = fill({"web": (1, 1000), "books": (3, 340), "rest": (1, 60)}, 700)
    web = fill({"en": (1, 900), "de": (1, 100)}, top["web"])
    books = fill({"c": (1, 300), "d": (1, 40)}, top["books"])
    want = {"a": web["en"], "b": web["de"], **books, "": top["rest"]}
    assert got == pytest.approx(want)


def test_mixture_takes_seeded_epochs(frame, ready):
    rows = [(i, "w " * (i % 7)) for i in range(200)] + [(None, None), (5, "again and again")]
    docs = frame(rows).withColumn("source", budgets.F.when(budgets.F.col("doc_id") % 3 == 0, None).otherwise("src0"))
    mix = budgets.Mix(share=1.2, epochs=2)
    got = budgets.mixed(docs, mix).collect()
    again = budgets.mixed(docs.repartition(7), mix).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert set(docs.columns) <= set(got[0].asDict())
    tokens = sum(len((r["text"] or "").split()) for r in got)
    whole = sum(len((t or "").split()) for _, t in rows)
    assert 1.15 * whole < tokens <= 1.2 * whole


def test_quality_counts_and_verdict(frame, odd):
    prose = " ".join(f"the house number{k} stands near the river and the trees of the valley" for k in range(6))
    repeated = "spam words come again and again right here " * 20
    junk = " ".join("#" * k + "~" * (k % 7) + "^" for k in range(1, 60))
    lines = "a b\n\nc\na b\n \nc\nc"
    rows = [(100 + k, f"{prose} again{k} " * 3) for k in range(30)] + [(10, repeated), (11, junk), (12, lines)] + odd
    found = divergence.judge(frame(rows)).collect()
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in found}
    assert len(found) == len(rows)
    for i, text in rows:
        words = re.findall(r"[^ \t-\r]+", text or "")
        row = got[i, len(words), sum(map(len, words))]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        count = Counter(windows)
        inside = {j for k, w in enumerate(windows) if count[w] > 1 for j in range(k, k + 8)}
        full = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
        assert row["n_repeat_words"] == len(inside)
        assert row["n_symbols"] == sum((text or "").count(c) for c in divergence.SYMBOLS)
        assert row["n_dup_lines"] == len(full) - len(set(full))
        assert row["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
    strange = next(r for r in found if r["doc_id"] == 11)
    assert not strange["kept"] and not strange["base_failed"]


def test_long_texts_without_common_words_fail(ready, folder):
    rng = random.Random(4)
    made = [(k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(2000))) for k in range(3)]
    made += [(9, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(25)))]
    docs = ready.read.parquet(f"{folder}/documents.parquet").filter("doc_id > 20")
    rows = docs.select("doc_id", "text", "lang").union(ready.createDataFrame([(i, t, "en") for i, t in made], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in divergence.judge(rows).filter("doc_id < 10").collect()}
    for i, _ in made[:3]:
        assert not got[i]["base_failed"] and not got[i]["kept"] and got[i]["word_distance"] > 0.95
    # Too short to tell.
    assert got[9]["kept"]


def test_quality_is_native(frame):
    plan = divergence.judge(frame([(1, "a b c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_languages_on_held_out_documents(ready, folder):
    docs = ready.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = subword_language.remainder(budgets.F.col("doc_id")) == 2
    model = subword_language.learn(docs, held)
    rows = subword_language.predict(docs, model).filter(held).collect()
    right = [r for r in rows if r["lang_pred"] == r["lang"]]
    assert len(right) > 0.98 * len(rows) and sum(r["rejected"] for r in right) <= 2
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_texts_of_no_learned_language_are_rejected(ready, folder):
    rng = random.Random(8)
    docs = ready.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet").filter("lang <> 'de'")
    held = subword_language.remainder(budgets.F.col("doc_id")) == 2
    model = subword_language.learn(docs, held)
    cyrillic = "абвгдежзийклмнопрстуфхцчшщъыьэюя "
    foreign = [(k, "".join(rng.choice(cyrillic) for _ in range(400))) for k in range(20)]
    foreign += [(100 + k, "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(200))) for k in range(20)]
    foreign += [(200 + k, rng.randbytes(300).hex()) for k in range(20)]
    german = docs.sparkSession.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet").filter("lang = 'de' AND n_chars > 200")
    made = ready.createDataFrame(foreign, "doc_id long, text string").union(german.select("doc_id", "text"))
    assert subword_language.accepted(made, model).count() == 0
    own = docs.filter(held)
    assert subword_language.accepted(own, model).count() >= 0.99 * own.count()


def test_language_of_odd_rows(frame, odd):
    docs = frame(odd + [(50, "123 !!"), (51, "the one")]).drop("n_words").withColumn("score", budgets.F.lit("mine"))
    rows = subword_language.predict(docs, None).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and all(r["rejected"] and r["score"] == 0 for r in rows)
    model = subword_language.learn(docs, budgets.F.lit(False))
    got = {r["text"]: r["lang_pred"] for r in subword_language.predict(docs, model).collect()}
    assert got["123 !!"] == got[None] == got[""] == "und" and got["the one"] == "en"
    assert subword_language.accepted(docs, model).columns == docs.columns
