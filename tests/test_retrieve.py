"""Exact top-k, role routing and context assembly."""

import numpy as np
import pytest

from govspark import rules, schemas
from govspark.operators import retrieve


def vectors(spark, n, dim, seed, parts=5):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts), data


def brute_force(queries, corpus, k):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    c = corpus / np.linalg.norm(corpus, axis=1, keepdims=True)
    scores = np.round(q.astype(np.float64) @ c.astype(np.float64).T, retrieve.RANK_DIGITS)
    return {
        (qi, rank): int(ci)
        for qi in range(len(q))
        for rank, ci in enumerate(np.lexsort((np.arange(len(c)), -scores[qi]))[:k], start=1)
    }


def test_close_similarities_are_told_apart(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.001]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert retrieve.top_k(queries, corpus, k=1).first()["vec_id"] == 2


def clustered(spark, n, dim, seed, spread=0.05):
    """Vectors around a few directions; some of zeros, a third of them copies of one."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(12, dim))
    data = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * spread
    data[:: 3] = centres[0]
    data[7::50] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), data


def unit(data):
    norms = np.linalg.norm(data, axis=1, keepdims=True)
    return np.divide(data, norms, out=np.zeros_like(data), where=norms > 0)


@pytest.mark.parametrize("make", [vectors, clustered])
@pytest.mark.parametrize("k", [1, 6, 1000])
def test_more_queries_than_the_limit_equal_brute_force(spark, monkeypatch, make, k):
    monkeypatch.setattr(retrieve, "MAX_QUERY_BYTES", 400)
    monkeypatch.setattr(retrieve, "PIVOTS", 16)
    monkeypatch.setattr(retrieve, "BLOCK_ITEMS", 20)
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", 7)
    corpus, data = make(spark, 300, 6, 1)
    queries, asked = make(spark, 40, 6, 2)
    empty = spark.createDataFrame([(1000, None)], "vec_id long, embedding array<double>")
    got = retrieve.top_k(
        queries.selectExpr("concat('q', vec_id) AS query_id", "embedding"), corpus.unionByName(empty, True), k=k
    ).collect()
    scores = np.rint(unit(asked.astype(float)) @ unit(data.astype(float)).T * 1e12)
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in got}
    assert len(got) == len(found) == 40 * min(k, 300)
    for q in range(40):
        order = np.lexsort((np.arange(300), -scores[q]))[:k]
        ours = [found[f"q{q}", r] for r in range(1, len(order) + 1)]
        # Products of blocks and of the whole may differ in the last digit that ranks.
        assert all(a == b or abs(scores[q, a] - scores[q, b]) <= 2 for a, b in zip(ours, order))


def test_blocked_search_agrees_with_the_broadcast_one(spark, monkeypatch):
    corpus, _ = clustered(spark, 400, 6, 5)
    queries, _ = clustered(spark, 50, 6, 6)
    queries = queries.withColumnRenamed("vec_id", "query_id")
    plain = sorted(map(tuple, retrieve.top_k(queries, corpus, k=8).collect()))
    monkeypatch.setattr(retrieve, "MAX_QUERY_BYTES", 400)
    assert sorted(map(tuple, retrieve.top_k(queries, corpus, k=8).collect())) == plain
    assert retrieve.top_k(queries, corpus.limit(0), k=8).count() == 0


def test_queries_do_not_see_parts_that_cannot_hold_their_best(spark):
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(16, 24)))
    queries = centres[rng.integers(0, 16, 200)] + rng.normal(size=(200, 24)) * 0.01
    radius = np.append(-1.0, np.full(16, 0.05))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(200)), "v": pa.array(queries.tolist()), "least": pa.array([0.99] * 200)})
    sent = next(retrieve._sent(centres, radius, False)(iter([batch])))
    assert sent.num_rows == 200  # each query only its own part, none of the 15 others


@pytest.mark.parametrize("cells", [4_000_000, 50])
def test_top_k_equals_brute_force(spark, monkeypatch, cells):
    """Also with a tiny limit, so that scoring goes in many steps."""
    monkeypatch.setattr(retrieve, "SCORE_CELLS", cells)
    corpus, data = vectors(spark, 300, 8, 1)
    queries, asked = vectors(spark, 7, 8, 2)
    queries = queries.withColumnRenamed("vec_id", "query_id")
    rows = retrieve.top_k(queries, corpus, k=6).collect()
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in rows} == brute_force(
        asked.astype(np.float64), data.astype(np.float64), 6
    )


def test_ties_zero_vectors_and_short_corpora(spark):
    corpus = spark.createDataFrame(
        [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, 0.0]), (1, None)], "vec_id long, embedding array<float>"
    )
    queries = spark.createDataFrame([("q", [3.0, 0.0])], "query_id string, embedding array<double>")
    rows = retrieve.top_k(queries, corpus, k=10).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["similarity"]) for r in rows] == [("q", 3, 1.0), ("q", 5, 1.0), ("q", 9, 0.0)]
    assert retrieve.top_k(queries.filter("false"), corpus).count() == 0


def test_many_ties_go_to_the_smaller_ids(spark):
    """A third of the corpus are copies of one vector; more copies than fit into the top k."""
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [1.0, float(i % 7)]) for i in range(900, 0, -1)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 0.0])], "query_id int, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieve.top_k(queries, corpus, k=20).collect()}
    data = {i: np.array(v) for i, v in rows}
    for q, v in [(1, np.array([1.0, 1.0])), (2, np.array([1.0, 0.0]))]:
        scores = {i: round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 5) for i, w in data.items()}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert [got[q, r] for r in range(1, 21)] == best


def test_wrong_vector_length_is_an_error(spark):
    corpus = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="must have 2 entries"):
        retrieve.top_k(queries, corpus).collect()


def test_no_pair_of_query_and_item_is_shuffled(spark):
    corpus, _ = vectors(spark, 1000, 4, 3, parts=4)
    queries, _ = vectors(spark, 3, 4, 4)
    top = retrieve.top_k(queries.withColumnRenamed("vec_id", "query_id"), corpus, k=5)
    plan = top._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_routing_by_role(spark):
    raw = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    masked = spark.createDataFrame([(10, [1.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame(
        [(1, "permissive", [1.0, 0.0]), (2, "restricted", [1.0, 0.0]), (3, None, [0.0, 1.0])],
        "query_id long, role string, embedding array<float>",
    )
    rows = retrieve.routed_top_k(queries, {"raw": raw, "masked": masked}, k=1).collect()
    assert {(r["query_id"], r["corpus"], r["vec_id"]) for r in rows} == {(1, "raw", 1), (2, "masked", 10), (3, "masked", 10)}


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "g int, embedding array<float>")
    assert {r["g"]: r["embedding"] for r in retrieve.centroids(df, "g").collect()} == {1: [2.0, 3.0], 2: [5.0, 5.0]}


def hits(spark, contents):
    rows = [(1, i, c) for i, c in enumerate(contents, start=1)]
    schema = f"query_id int, rank int, content {schemas.RETRIEVAL_CONTENT.simpleString()}"
    return spark.createDataFrame(rows, schema)


def test_context_of_texts(spark):
    df = hits(spark, [(None, "first"), (None, "second"), (None, ""), (None, "third")])
    assert retrieve.retrieve_context(df).first()["context"] == "first\n\nsecond\n\nthird"
    assert retrieve.invoke_context(df).first()["context"] == "first\nsecond\nthird"


def test_row_and_text_priority(spark):
    cells = [("a", "1"), (None, "2"), ("b", None), ("c", "3")]
    df = hits(spark, [(cells, "text"), ([], "lost"), (cells, None)])
    assert retrieve.invoke_context(df).first()["context"] == "a: 1, c: 3\na: 1, c: 3"
    assert retrieve.retrieve_context(df).first()["context"] == "text\n\nlost\n\na: 1, c: 3"


def test_context_is_ordered_and_cut(spark):
    df = hits(spark, [(None, f"{i:02d}" + "é" * 2000) for i in range(10)])
    row = retrieve.invoke_context(df.repartition(4)).first()
    whole = "\n".join(f"{i:02d}" + "é" * 2000 for i in range(10))
    assert row["context"] == whole[: rules.MAX_CONTEXT_CHARS] and row["parts"] == 10
    assert retrieve.retrieve_context(df).first()["context"] == whole.replace("\n", "\n\n")


def test_missing_context_is_flagged(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    contexts = spark.createDataFrame([(1, "data"), (2, "")], "query_id int, context string")
    rows = {r["query_id"]: (r["context_status"], r["fallback_reply"]) for r in retrieve.with_context_status(queries, contexts).collect()}
    assert rows == {1: ("ok", None), 2: ("no_context", rules.NO_CONTEXT_REPLY), 3: ("no_context", rules.NO_CONTEXT_REPLY)}


def test_masked_corpus_text(spark):
    df = spark.createDataFrame([("raw", "a@b.com"), ("masked", "a@b.com"), ("masked", None)], "corpus string, text string")
    out = [r["visible_text"] for r in retrieve.visible_text(df, "text").collect()]
    assert out == ["a@b.com", "[EMAIL]", None]
