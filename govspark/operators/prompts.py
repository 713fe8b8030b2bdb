"""Validation, sanitising and guard columns over a prompt log, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import rules
from govspark.functions import chart, guard, text
from govspark.rules import GuardRules


def validate(df: DataFrame, column: str = "text") -> DataFrame:
    """Add ``is_valid``, ``error_message`` and ``sanitized_text`` (empty when invalid)."""
    return (
        df.withColumn("_trimmed", text.strip(F.coalesce(column, F.lit(""))))
        .withColumn("error_message", text.validation_error(F.col("_trimmed")))
        .withColumns(
            {
                "is_valid": F.col("error_message").isNull(),
                "sanitized_text": F.when(F.col("error_message").isNull(), F.col("_trimmed")).otherwise(""),
            }
        )
        .drop("_trimmed")
    )


def sanitize_for_engine(df: DataFrame, column: str, out: str = "engine_text") -> DataFrame:
    """Add the stripped text, or null with ``engine_error`` where the input is too long."""
    return df.withColumn("engine_error", text.engine_error(F.col(column))).withColumn(
        out, F.when(F.col("engine_error").isNull(), text.sanitize(F.col(column)))
    )


def prepare(df: DataFrame, column: str = "text") -> DataFrame:
    """Validate, then sanitise. ``route`` says whether the prompt reaches an engine.

    Invalid prompts keep a null ``engine_text``, so no later step can read them.
    """
    checked = validate(df, column)
    cleaned = sanitize_for_engine(checked, "sanitized_text")
    reaches = F.col("is_valid") & F.col("engine_error").isNull()
    return cleaned.withColumns(
        {
            "route": F.when(reaches, F.lit("valid")).otherwise(F.lit("quarantine")),
            "engine_text": F.when(reaches, F.col("engine_text")),
        }
    )


def split_by_validity(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid prompts and quarantined prompts. Write with ``partitionBy('route')`` to split in one pass."""
    return df.filter("route = 'valid'"), df.filter("route = 'quarantine'")


def match_keywords(
    df: DataFrame,
    column: str = "engine_text",
    guard_rules: GuardRules = rules.REFERENCE_GUARD,
    whole_words: bool = False,
) -> DataFrame:
    """Add ``jailbreak_keyword`` and ``pii_keyword``: the first hit in list order, or null."""
    if whole_words:
        source = F.col(column)
        return df.withColumns(
            {
                "jailbreak_keyword": text.first_word_match(source, guard_rules.jailbreak),
                "pii_keyword": text.first_word_match(source, guard_rules.pii),
            }
        )
    return (
        df.withColumn("_lowered", F.lower(column))
        .withColumns(
            {
                "jailbreak_keyword": text.first_keyword(F.col("_lowered"), guard_rules.jailbreak),
                "pii_keyword": text.first_keyword(F.col("_lowered"), guard_rules.pii),
            }
        )
        .drop("_lowered")
    )


def governed_verdict(df: DataFrame) -> DataFrame:
    """Add the governed path's verdict, from the matched keywords."""
    jailbreak, pii = F.col("jailbreak_keyword"), F.col("pii_keyword")
    kind = guard.block_kind(jailbreak, pii)
    return df.withColumns(
        {
            "input_action": guard.input_action(jailbreak),
            "output_action": F.lit("PASS"),
            "verdict": F.when(kind.isNotNull(), F.lit("BLOCKED")).otherwise(F.lit("PASS")),
            "block_kind": kind,
            "block_reason": guard.block_reason(jailbreak, pii),
        }
    ).withColumn("needs_attention", guard.needs_attention(F.col("input_action"), F.col("output_action")))


def guard_prompts(df: DataFrame, column: str = "text", guard_rules: GuardRules = rules.REFERENCE_GUARD) -> DataFrame:
    """The whole per-prompt chain: prepare, match, judge. Stateless, so it also runs on streams."""
    return df.transform(prepare, column).transform(match_keywords, "engine_text", guard_rules).transform(
        governed_verdict
    )


def with_annotations(df: DataFrame, live: bool = False) -> DataFrame:
    """Add the labels and final action of the governed result."""
    at_guard = F.col("input_action") == "BLOCKED"
    later = F.col("verdict") == "BLOCKED"
    return df.withColumns(
        {
            "annotations": guard.annotations(at_guard, later, F.col("output_action"), live),
            "is_blocked": later,
            "guardrail_action": F.when(later, F.lit("BLOCKED"))
            .when(F.col("output_action") == "MODIFIED", F.lit("MODIFIED"))
            .otherwise(F.lit("PASS")),
        }
    )


def with_intent(df: DataFrame, column: str = "text") -> DataFrame:
    """Add chart type, data kind, chart title and the analytics flag."""
    return (
        df.withColumn("_lowered", F.lower(column))
        .withColumns(
            {
                "is_analytics": chart.is_analytics(F.col("_lowered")),
                "chart_type": chart.chart_type(F.col("_lowered")),
                "dataset_kind": chart.dataset_kind(F.col("_lowered")),
                "title": chart.chart_title(F.col(column)),
            }
        )
        .drop("_lowered")
    )
