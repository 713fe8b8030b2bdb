"""Personal-data findings: extraction, counts, column profile and scan status."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark import rules
from govspark.functions import detect
from govspark.operators.joins import lookup_join
from govspark.rules import Detector
from govspark.sources.gold import GoldStar


def with_detected_types(
    df: DataFrame, text: str, detectors: Iterable[Detector] = rules.REFERENCE_DETECTORS
) -> DataFrame:
    """Add ``types``, ``sensitive_detected`` and ``leak_label``."""
    typed = df.withColumn("types", detect.detected_types(F.col(text), detectors))
    return typed.withColumns(
        {
            "sensitive_detected": F.size("types") > 0,
            "leak_label": F.when(F.size("types") > 0, F.lit(rules.LEAK_LABEL)),
        }
    )


def extract_findings(
    df: DataFrame, keys: list[str], text: str, detectors: Iterable[Detector] = rules.EXTENDED_DETECTORS
) -> DataFrame:
    """One row per match: the keys, the category and the value."""
    return df.select(*keys, F.inline(detect.findings(F.col(text), detectors)))


def count_findings(findings: DataFrame) -> DataFrame:
    """Findings and distinct values per category, with a total row.

    Distinct values are counted by first grouping on (category, value), which splits a large
    category over many tasks. The total adds up the category rows, so nothing is read twice.
    """
    per_value = findings.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))
    per_category = per_value.groupBy("category").agg(
        F.sum("n").alias("findings"), F.count(F.lit(1)).alias("distinct_values")
    )
    return (
        per_category.rollup("category")
        .agg(F.sum("findings").alias("findings"), F.sum("distinct_values").alias("distinct_values"))
        .withColumn("category", F.coalesce("category", F.lit("TOTAL")))
    )


def count_per_key(
    df: DataFrame, keys: list[str], text: str, detectors: Iterable[Detector] = rules.EXTENDED_DETECTORS
) -> DataFrame:
    """Number of findings per row of ``df``, without a shuffle."""
    counts = [detect.match_count(F.col(text), d) for d in detectors]
    return df.select(*keys, sum(counts[1:], counts[0]).alias("findings_count"))


def count_matches(df: DataFrame, detectors: tuple[Detector, ...] = rules.COLUMN_RULES, weight: str | None = None) -> DataFrame:
    """(column_name, category, rows_matched, n_values) of the string columns.

    All columns and rules are counted in one aggregate over one scan. Each value is first
    turned into a bit mask of the rules it matches, which keeps the regexes in a projection
    and leaves the aggregate with integer tests. A row counts as often as ``weight`` says.
    """
    text_columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    masks = df.selectExpr(
        *[
            " + ".join(f"CAST({detect.match_sql(f'`{c}`', d)} AS BIGINT) * {1 << i}L" for i, d in enumerate(detectors))
            + f" AS `{c}`"
            for c in text_columns
        ],
        f"`{weight}` AS _rows" if weight else "1L AS _rows",
    )
    entries = [
        f"named_struct('column_name', '{c}', 'category', '{d.name}', "
        f"'rows_matched', coalesce(sum(if(`{c}` & {1 << i}L != 0, _rows, 0L)), 0L), "
        f"'n_values', coalesce(sum(if(`{c}` IS NOT NULL, _rows, 0L)), 0L))"
        for c in text_columns
        for i, d in enumerate(detectors)
    ]
    if not entries:
        return df.sparkSession.createDataFrame([], "column_name string, category string, rows_matched long, n_values long")
    return masks.agg(F.expr(f"array({', '.join(entries)})").alias("entries")).select(F.inline("entries"))


def held_columns(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of which at least ``threshold`` of the column's values match."""
    return counts.filter((F.col("n_values") > 0) & (F.col("rows_matched") >= threshold * F.col("n_values")))


def profile_columns(
    df: DataFrame,
    detectors: tuple[Detector, ...] = rules.COLUMN_RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """Which string columns hold which category: (column_name, category, rows_matched, n_values)."""
    return held_columns(count_matches(df, detectors), threshold)


def profile_star(
    star: GoldStar, detectors: tuple[Detector, ...] = rules.COLUMN_RULES, threshold: float = 0.5
) -> DataFrame:
    """``profile_columns`` of Gold from its pieces, without building it.

    Lines are counted per key first; each row of a look-up table then counts as often as lines
    carry it, so a rule sees each order, customer and part once.
    """
    counts = [count_matches(piece, detectors, "lines") for piece in star.weighted().values()]
    return held_columns(reduce(DataFrame.unionByName, counts), threshold)


def findings_by_category(profile: DataFrame) -> DataFrame:
    """Findings per category, one finding per column that holds it."""
    return profile.groupBy("category").agg(F.count(F.lit(1)).alias("findings"))


def findings_record(by_category: DataFrame) -> DataFrame:
    """One row: the number of findings and a map from category to findings.

    The list has one entry per category of the ruleset, so collecting it is bounded.
    """
    entries = F.array_sort(F.collect_list(F.struct("category", "findings")))
    return by_category.agg(
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings_count"),
        F.map_from_entries(entries).alias("categories"),
    )


def scan_status(findings_count: Column) -> Column:
    return (
        F.when(findings_count.isNull(), F.lit("unavailable"))
        .when(findings_count == 0, F.lit("clean"))
        .otherwise(F.lit("detected"))
    )


def scan_summary(findings_count: Column, categories: Column | None = None, scanner: str = "PII scan") -> Column:
    """Report text of a scan; ``categories`` is an array of (category, findings) in line order."""
    headline = F.concat(
        F.lit(f"{scanner}: "), findings_count.cast("string"), F.lit(" PII findings detected in source data")
    )
    if categories is not None:
        lines = F.transform(
            categories,
            lambda c: F.concat(F.lit("  • "), c["category"], F.lit(": "), c["findings"].cast("string")),
        )
        headline = F.concat_ws("\n", headline, lines)
    return (
        F.when(findings_count.isNull(), F.lit(f"{scanner}: Results unavailable"))
        .when(findings_count == 0, F.lit(f"{scanner}: No PII detected in source data — data is clean"))
        .otherwise(headline)
    )


def scan_report(
    df: DataFrame,
    group: list[str],
    text: str,
    detectors: tuple[Detector, ...] = rules.EXTENDED_DETECTORS,
) -> DataFrame:
    """Scan status and report text per group of rows, from one partial aggregation.

    A group whose every text is missing could not be scanned and is reported as unavailable.
    """
    scanned = df.select(
        *group,
        F.col(text).isNotNull().alias("scanned"),
        *[detect.match_count(F.col(text), d).alias(d.name) for d in detectors],
    )
    totals = scanned.groupBy(*group).agg(
        F.max("scanned").alias("scanned"), *[F.sum(d.name).alias(d.name) for d in detectors]
    )
    total = sum((F.col(d.name) for d in detectors[1:]), F.col(detectors[0].name))
    lines = F.filter(
        F.array(
            *[F.struct(F.lit(d.name).alias("category"), F.col(d.name).alias("findings")) for d in detectors]
        ),
        lambda c: c["findings"] > 0,
    )
    return totals.withColumn("findings_count", F.when(F.col("scanned"), total)).select(
        *group,
        "findings_count",
        scan_status(F.col("findings_count")).alias("status"),
        (F.coalesce("findings_count", F.lit(0)) > 0).alias("expanded"),
        scan_summary(F.col("findings_count"), lines).alias("summary"),
    )


def attach_scan(prompts: DataFrame, scans: DataFrame, key: str) -> DataFrame:
    """Scan results onto prompts. A missing scan never blocks, it only reads unavailable."""
    joined = lookup_join(prompts, scans.select(key, "findings_count"), key)
    return joined.select(
        *prompts.columns,
        "findings_count",
        scan_status(F.col("findings_count")).alias("scan_status"),
        F.lit(True).alias("passed"),
        F.lit(False).alias("blocked"),
    )
