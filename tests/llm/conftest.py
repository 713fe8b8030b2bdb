import random

import pytest


@pytest.fixture(scope="module")
def ready(spark):
    from govspark.llm.common import prepare

    return prepare(spark)


@pytest.fixture
def frame(ready):
    """Documents (doc_id, text) with a clashing extra column, over a few partitions."""

    def make(rows, parts=3):
        rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in rows]
        return ready.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string"
        ).repartition(parts)

    return make


@pytest.fixture
def odd():
    """Nulls, empty and white texts, repeated rows, equal ids, a very long text and special strings."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["the", "of", "Ünder", "a1b2", "don't", "漢字", "x" * 40]) for _ in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (4, "other words, 12!"), (None, "no id"),
        (None, None), (5, long), (6, "a<|endoftext|>b <|ENDOFTEXT|> <|endoftext|>"), (7, "x" * 5000), (8, "don't we'll 's ''s\n's  \n"),
    ]
