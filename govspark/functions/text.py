"""Text trimming, validation and sanitising expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from govspark import rules


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not just the space character."""
    return F.trim(text, F.lit(rules.SPACE_CHARS))


def validation_error(trimmed: Column) -> Column:
    """Error message for a trimmed prompt, or null when it is valid."""
    size = F.length(trimmed)
    too_long = F.concat(
        F.lit(f"Prompt exceeds maximum length of {rules.MAX_PROMPT_LENGTH} characters (got "),
        size.cast("string"),
        F.lit(" after trimming)."),
    )
    return F.when(size == 0, F.lit("Prompt cannot be empty or whitespace-only.")).when(
        size > rules.MAX_PROMPT_LENGTH, too_long
    )


def engine_error(text: Column) -> Column:
    """Error message for a text too long for an engine, or null."""
    return F.when(
        F.length(text) > rules.MAX_ENGINE_LENGTH,
        F.concat(
            F.lit(f"Input exceeds maximum engine length of {rules.MAX_ENGINE_LENGTH} characters (got "),
            F.length(text).cast("string"),
            F.lit(")."),
        ),
    )


def strip_script_tags(text: Column) -> Column:
    # The regex can only match after a "<"; most prompts have none.
    return F.when(
        text.contains("<"), F.regexp_replace(text, rules.SCRIPT_TAG, "")
    ).otherwise(text)


def strip_shell_metacharacters(text: Column) -> Column:
    return F.translate(text, rules.SHELL_METACHARACTERS, "")


def strip_sql_keywords(text: Column) -> Column:
    return F.regexp_replace(text, rules.SQL_KEYWORD, "")


def sanitize(text: Column) -> Column:
    """Script tags, then metacharacters, then SQL keywords. The order matters."""
    return strip_sql_keywords(strip_shell_metacharacters(strip_script_tags(text)))


def contains_any(lowered: Column, words: tuple[str, ...]) -> Column:
    """Whether lower-cased text holds any of the words as a substring."""
    return lowered.rlike("|".join(_quoted(w.lower()) for w in words))


def first_keyword(lowered: Column, words: tuple[str, ...]) -> Column:
    """The first word, in list order, that the lower-cased text holds; null when none."""
    return F.coalesce(*[F.when(lowered.contains(w.lower()), F.lit(w)) for w in words])


def first_word_match(text: Column, words: tuple[str, ...]) -> Column:
    """As ``first_keyword`` but on whole words, so ``dan`` does not match ``dance``."""
    return F.coalesce(
        *[F.when(text.rlike(rf"(?iU)\b{_quoted(w)}\b"), F.lit(w)) for w in words]
    )


def _quoted(word: str) -> str:
    return rf"\Q{word}\E"
