"""The pipeline against a plain version of its stages, each on what its predecessor kept."""

import corpus_pipeline
import public_tokenizers
from test_documents import plain_groups, plain_removal  # noqa: F401
from tokenizers import Tokenizer

from govspark.llm import jaccard_trees
from govspark.llm.common import materialise


def test_stages(ready, folder):
    docs = ready.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = materialise(stage(ready, docs, folder), "test-pipeline")
        kept[name] = before, [r.asDict() for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = kept["language ID"]
    assert len(after) >= 0.99 * len(before)
    before, after = kept["n-gram Jaccard join"]
    groups = plain_groups([(r["doc_id"], r["text"]) for r in before], jaccard_trees.Settings())
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, g in groups if i == g)
    before, after = kept["suffix-array dedup"]
    left = {i: n - gone for i, n, gone, _, _ in plain_removal([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.PASSAGE.length)}
    assert len(before) == len(after) and all(len(r["text"].encode()) <= left[r["doc_id"]] < len(r["text"].encode()) + 8 for r in after)
    before, after = kept["mixing sources to target weights"]
    tokens = [sum(len(r["text"].split()) for r in x) for x in (before, after)]
    assert 0.6 * tokens[0] < tokens[1] <= 0.9 * tokens[0] + 1 and len({r["doc_id"] for r in after}) == len(after)
    before, after = kept["BPE encoding and decoding"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in before}
    assert {r["doc_id"]: r["ids"] for r in after} == ids and all(r["exact"] for r in after)
