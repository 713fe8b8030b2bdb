"""Sensitive-text detection, extraction, redaction, tokenising and masking expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import rules
from govspark.rules import Detector


def may_match(text: Column, detector: Detector) -> Column | None:
    """The cheap literal test of a detector, or None where it has none."""
    source = F.upper(text) if detector.fold else text
    tests = [source.contains(n) for n in detector.needles]
    return reduce(lambda a, b: a | b, tests) if tests else None


def match_sql(text: str, detector: Detector) -> str:
    """Whether the text holds a match, as SQL text: per pattern the literal, then the regex."""
    source = f"upper({text})" if detector.fold else text
    patterns = [detector.search] if detector.search else detector.patterns
    tests = [f"{text} RLIKE r'{p}'" for p in patterns]
    if detector.needles:
        tests = [f"(contains({source}, '{n}') AND {t})" for n, t in zip(detector.needles, tests, strict=True)]
    return f"({' OR '.join(tests)})"


def matches(text: Column, detector: Detector) -> Column:
    """``match_sql`` as a Column."""
    source = F.upper(text) if detector.fold else text
    patterns = [detector.search] if detector.search else detector.patterns
    tests = [text.rlike(p) for p in patterns]
    if detector.needles:
        tests = [source.contains(n) & t for n, t in zip(detector.needles, tests, strict=True)]
    return reduce(lambda a, b: a | b, tests)


def detected_types(text: Column, detectors: Iterable[Detector] = rules.REFERENCE_DETECTORS) -> Column:
    """Names of the detectors that match, in detector order, each at most once."""
    safe = F.coalesce(text, F.lit(""))
    flags = [F.when(matches(safe, d), F.lit(d.name)).otherwise(F.lit("")) for d in detectors]
    return F.array_remove(F.array(*flags), "")


def found_values(text: Column, detector: Detector) -> Column:
    """All matched substrings of one detector, in text order."""
    values = F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(0))
    possible = may_match(text, detector)
    return values if possible is None else F.when(possible, values)


def match_count(text: Column, detector: Detector) -> Column:
    """Number of matches of one detector; 0 for a missing text."""
    count = F.regexp_count(text, F.lit(detector.pattern))
    possible = may_match(text, detector)
    return F.coalesce(count if possible is None else F.when(possible, count), F.lit(0))


def findings(text: Column, detectors: Iterable[Detector]) -> Column:
    """Array of (category, value) for every match of every detector."""
    per_detector = []
    for d in detectors:
        values = F.coalesce(found_values(text, d), F.array().cast("array<string>"))
        per_detector.append(F.transform(values, _as_finding(d.name)))
    return F.concat(*per_detector)


def _as_finding(category: str):
    return lambda value: F.struct(F.lit(category).alias("category"), value.alias("value"))


def redact(
    df: DataFrame, text: str, out: str, detectors: Iterable[Detector] = rules.EXTENDED_DETECTORS
) -> DataFrame:
    """Add ``out``: the text with each match replaced by its ``[CATEGORY]`` placeholder.

    One detector after the other, each as its own projection, so a text that cannot match a
    detector goes on to the next one untouched.
    """
    df = df.withColumn(out, F.col(text))
    for d in detectors:
        replaced = F.regexp_replace(out, d.pattern, d.placeholder)
        possible = may_match(F.col(out), d)
        df = df.withColumn(out, replaced if possible is None else F.when(possible, replaced).otherwise(F.col(out)))
    return df


def tokenise(value: Column, salt: str) -> Column:
    """A stable token: equal values give equal tokens, so joins survive. Null stays null."""
    return F.sha2(F.concat(F.lit(salt), value), 256)


def mask_digits(value: Column) -> Column:
    """Keep the shape, hide every digit."""
    return F.translate(value, "0123456789", "##########")


def mask_keep_last(value: Column, keep: int = 4) -> Column:
    """Hide all digits but those in the last ``keep`` characters."""
    size = F.length(value)
    head = F.substring(value, F.lit(1), F.greatest(size - keep, F.lit(0)))
    return F.concat(mask_digits(head), F.right(value, F.lit(keep)))


def mask_email(value: Column) -> Column:
    """Keep the first character and the domain."""
    return F.concat(F.left(value, F.lit(1)), F.lit("***@"), F.substring_index(value, "@", -1))
