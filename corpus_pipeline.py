"""From raw documents to encoded ones: language, near copies, repeated passages, mixture, tokens.

``STAGES`` lists (name, function) pairs. A function takes (spark, docs, folder of the tables) and
gives the documents that stay, with their columns; the last one adds the token ids and decoded
text in place of the raw text. Each result is written and read again before the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm import budgets, byte_bpe, jaccard_trees, subword_language, suffix_dedup
from govspark.llm.common import materialise, prepare, table

#: A passage is over 50 words; in 250 bytes there are 50 words of four letters and a blank.
PASSAGE = suffix_dedup.Settings(length=250, window=150)
#: Nearly all tokens stay: the mixture cuts what the weights leave over.
MIX = budgets.Mix(share=0.9, epochs=1)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Learned from their own labelled rows."""
    prepare(spark)
    model = subword_language.learn(docs, F.lit(False))
    return subword_language.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    prepare(spark)
    return jaccard_trees.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    prepare(spark)
    return suffix_dedup.without_repeats(docs, PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of domains, languages and sources hold."""
    prepare(spark)
    return budgets.mixed(docs, MIX).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a check that they decode to its text."""
    prepare(spark)
    coded = byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("exact"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

# Neither the trained model nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
