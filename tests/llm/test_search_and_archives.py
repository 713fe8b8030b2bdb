"""Top-k search against brute force; archives against their rows and the standard library."""

import hashlib
import io
import random
import zipfile

import pytest

from govspark.llm import block_topk, warc_zip
from govspark.llm.common import materialise


def test_top_k_equals_brute_force(ready, monkeypatch):
    rng = random.Random(2)
    for name, size in (("BLOCK", 7), ("SHARD_BLOCKS", 3), ("BATCH", 5)):
        monkeypatch.setattr(block_topk, name, size)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(150)]
    rows += [(20, rows[20][1]), (200, [0.5]), (220, []), (300, None), (320, [None, 1.0]), (340, [float("nan")]), (360, [float("inf")]), (None, [1.0])]
    df = ready.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(map(tuple, block_topk.top_k(df, block_topk.F.col("vec_id") % 20 == 0, 6).collect()))
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:6]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert block_topk.top_k(df.filter("vec_id < 0"), block_topk.F.lit(True)).count() == 0


def test_batches_go_only_to_shards_they_reach(ready, monkeypatch):
    rng = random.Random(7)
    for name, size in (("BLOCK", 10), ("SHARD_BLOCKS", 2), ("BATCH", 10), ("PAGE", 3), ("GROUP", 2)):
        monkeypatch.setattr(block_topk, name, size)
    # Clusters of 40 ids around one axis each, and a clashing column.
    axis = lambda i: [rng.uniform(0.9, 1) if d == i // 40 % 8 else rng.uniform(-0.05, 0.05) for d in range(8)]
    rows = [(i, axis(i), 1) for i in range(320)]
    df = ready.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    sent, plain = [], block_topk._round

    def counted(batches, shards, k):
        sent.append((batches.count(), batches.select("batch").distinct().count(), shards.select("place").distinct().count()))
        return plain(batches, shards, k)

    monkeypatch.setattr(block_topk, "_round", counted)
    got = sorted(map(tuple, block_topk.top_k(df, block_topk.F.lit(True), 5).collect()))
    ok = [(i, [int(64 * x // 1) for x in v]) for i, v, _ in rows]
    want = []
    for q, v in ok:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    (one, batches, shards), (rest, _, _) = sent
    assert one == batches and shards >= 16
    # A cluster of 40 ids lies in two to four shards.
    assert batches * 1 <= one + rest <= batches * 6 < batches * shards


def test_huge_components_are_ranked_exactly(ready):
    rows = [(0, [1.0, 0.0]), (1, [-1e300, 1.0]), (2, [-4096.0, 0.0]), (3, [3e15, -2.0]), (4, [2e15, 5.0]), (20, [1e300, 1e300])]
    got = map(tuple, block_topk.top_k(ready.createDataFrame(rows, "vec_id long, embedding array<double>"), block_topk.F.col("vec_id") % 20 == 0).collect())
    low, high = -(2**63), 2**63 - 1
    ends = lambda x, a, b: max(a, min(b, x))
    whole = [(i, [ends(int(64 * x // 1) if abs(x) < 1e300 else int(x), low, high) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-ends(sum(a * b for a, b in zip(v, w)), low + 2, high - 1), i) for i, w in whole if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("wide", [False, True])
def test_packages_round_trip(ready, tmp_path, wide):
    big, small = "<p>" + "é" * 100, "<p>"
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", small), (4, "u", small), (None, "u", big), (5, "u", None), (6, "u", ""), (1, "u", big), (7, "u", "z" * 300_000)]
    pages = ready.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", block_topk.F.lit(1))
    place = "file://" + str(tmp_path / "zips")
    packages = materialise(warc_zip.write_packages(warc_zip.decide(pages).repartition(2), place, 1 << 20, wide), "zips")
    assert packages.count() == 2
    got = sorted(map(tuple, warc_zip.read_packages(packages, place, payload=True).collect()), key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == big and i != 1
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None, None if again else bytearray(body)))
    assert got == sorted(want, key=str)
    for row in packages.collect():
        with zipfile.ZipFile(row["path"]) as z:  # the standard reader agrees
            assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]


def test_reader_takes_packages_of_the_standard_writer():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/x", b"123")
        z.writestr("b/y", b"4567")
        z.comment = b"a comment"
    reader = warc_zip.PackageReader(sink, len(sink.getvalue()))
    assert reader.range(*reader.member("b/y")) == b"4567"


def test_empty_pages(ready, tmp_path):
    pages = ready.createDataFrame([], "page_id long, url string, html string")
    place = "file://" + str(tmp_path)
    assert warc_zip.read_packages(materialise(warc_zip.write_packages(warc_zip.decide(pages), place), "none"), place).count() == 0
