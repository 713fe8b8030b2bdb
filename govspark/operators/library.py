"""The prompt library: fixed presets, look-ups against a prompt log, quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark import rules
from govspark.functions import text
from govspark.schemas import PRESET
from govspark.sources.files import fixed_rows

MAX_LABEL_LENGTH = 30


def prompt_library(spark: SparkSession) -> DataFrame:
    """All presets: the attacks, then the analytics questions. Ten rows, fixed."""
    return fixed_rows(spark, list(rules.PROMPT_LIBRARY), PRESET)


def attack_prompts(spark: SparkSession) -> DataFrame:
    return prompt_library(spark).filter(~F.col("is_analytics"))


def analytics_prompts(spark: SparkSession) -> DataFrame:
    return prompt_library(spark).filter("is_analytics")


def prompt_by_id(spark: SparkSession, preset_id: str) -> DataFrame:
    return prompt_library(spark).filter(F.col("id") == preset_id)


def join_library(log: DataFrame, library: DataFrame, preset_id: str = "preset_id") -> DataFrame:
    """A prompt log with the library entry each prompt came from; other prompts stay.

    The library is a fixed list of ten rows, which Spark broadcasts by its known size.
    """
    return log.join(library.withColumnRenamed("id", preset_id), preset_id, "left")


def match_library(log: DataFrame, library: DataFrame, prompt: str = "text") -> DataFrame:
    """A prompt log with the library entry that has the same text, as ``preset_id`` and its columns.

    Texts are the same when they agree after trimming and in lower case. Free prompts stay, with
    nulls. Where several entries share a text, the one with the smallest id counts, so no prompt
    is doubled. Columns of the entry replace columns of the log with the same names. The library
    is a fixed list of ten rows, which Spark broadcasts by its known size.
    """
    facts = [c for c in library.columns if c not in ("id", "prompt_text")]
    entry = F.struct(F.col("id").alias("preset_id"), *[F.col(c) for c in facts])
    entries = library.groupBy(F.lower(text.strip(F.col("prompt_text"))).alias("_text")).agg(F.min(entry).alias("_entry"))
    same = F.lower(text.strip(F.col(prompt))) == F.col("_text")
    own = [c for c in log.columns if c not in ("preset_id", *facts)]
    return log.join(entries, same, "left").select(*own, "_entry.*")


def quality_checks(library: DataFrame) -> DataFrame:
    """Rows and violations of a prompt library of any size, as one row.

    Duplicate ids are found by counting per id first, which combines map side.
    """
    per_id = library.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.length("label") > MAX_LABEL_LENGTH).alias("long_labels"),
        F.count_if(text.strip(F.coalesce("prompt_text", F.lit(""))) == "").alias("empty_prompts"),
    )
    return per_id.agg(
        F.sum("n").alias("prompts"),
        F.count(F.lit(1)).alias("ids"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_id_rows"),
        F.sum("long_labels").alias("long_labels"),
        F.sum("empty_prompts").alias("empty_prompts"),
    )
