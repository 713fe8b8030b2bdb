"""Chart type, title and intent expressions over prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from govspark import rules
from govspark.functions.text import contains_any, strip


def chart_type(lowered: Column) -> Column:
    """Pie words win over line words; everything else is a bar chart."""
    return (
        F.when(contains_any(lowered, rules.PIE_KEYWORDS), F.lit("pie"))
        .when(contains_any(lowered, rules.LINE_KEYWORDS), F.lit("line"))
        .otherwise(F.lit("bar"))
    )


def dataset_kind(lowered: Column) -> Column:
    """Which analytics data answers a prompt. Here line words win over pie words."""
    return (
        F.when(contains_any(lowered, rules.LINE_KEYWORDS), F.lit("line"))
        .when(contains_any(lowered, rules.PIE_KEYWORDS), F.lit("pie"))
        .otherwise(F.lit("bar"))
    )


def chart_title(query: Column) -> Column:
    """Trim, drop trailing question marks, trim again."""
    bare = strip(F.rtrim(strip(query), F.lit("?")))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("Analytics Chart"))


def is_analytics(lowered: Column) -> Column:
    return contains_any(lowered, rules.ANALYTICS_KEYWORDS)


def whole_number(x: Column) -> Column:
    """A double as a whole number, halves to even."""
    return F.format_string("%.0f", F.bround(x, 0))
