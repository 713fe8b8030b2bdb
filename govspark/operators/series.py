"""Chart series: building, insights and status, for many series at once.

A series frame holds (series_id, pos, label, value). ``pos`` is any orderable value that is
unique within a series. ``value`` may have any type; it is read as a number and printed as
given. Insights use only aggregates that combine map side (no window, no collected list), so
one very long series is no problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions.chart import whole_number


def build_series(df: DataFrame, series_id: Column, pos: Column, label: Column, value: Column) -> DataFrame:
    """Rows as series points: a missing label reads as empty, a missing value as 0."""
    return df.select(
        series_id.cast("string").alias("series_id"),
        pos.alias("pos"),
        F.coalesce(label.cast("string"), F.lit("")).alias("label"),
        F.coalesce(value.cast("string"), F.lit("0")).alias("value"),
    )


def summarise(series: DataFrame) -> DataFrame:
    """The facts insights are made of, one row per series."""
    number = F.expr("try_cast(value AS double)")
    points = series.withColumn("number", number)
    point = F.struct("label", "value", "number")
    return points.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("number").alias("n_numeric"),
        F.sum("number").alias("total"),
        # Largest number first, earliest position among equals.
        F.min_by(point, F.struct(-F.col("number"), F.col("pos"))).alias("leader"),
        F.min_by(point, F.col("pos")).alias("first"),
        F.max_by(point, F.col("pos")).alias("last"),
    )


def leader_label() -> Column:
    """The label of the largest value; a point without one is called Unknown."""
    return F.coalesce(F.nullif(F.col("leader.label"), F.lit("")), F.lit("Unknown"))


def bar_insight(value_column: Column) -> Column:
    return F.concat(leader_label(), F.lit(" leads with "), F.col("leader.value"), F.lit(" in "), value_column, F.lit("."))


def pie_insight(value_column: Column) -> Column:
    percent = F.col("leader.number") / F.col("total") * 100
    share = F.concat(
        leader_label(), F.lit(" leads with "), whole_number(percent), F.lit("% of total "), value_column, F.lit(".")
    )
    return F.when(F.col("total") > 0, share).otherwise(
        F.concat(leader_label(), F.lit(" has the highest "), value_column, F.lit("."))
    )


def line_insight() -> Column:
    first, last = F.col("first.number"), F.col("last.number")
    change = (last - first) / first * 100
    trend = F.concat(
        F.lit("Trend shows "), whole_number(F.abs(change)), F.lit("% "),
        F.when(change > 0, F.lit("growth")).otherwise(F.lit("decline")),
        F.lit(" from "), F.col("first.label"), F.lit(" to "), F.col("last.label"), F.lit("."),
    )
    return F.when(first > 0, trend).otherwise(
        F.concat(F.lit("Trend data spans "), F.col("n").cast("string"), F.lit(" periods."))
    )


def insights(series: DataFrame, chart_type: Column, x_column: Column, y_column: Column) -> DataFrame:
    """One key-insight sentence per series. The Columns may read the summary's own columns."""
    return summarise(series).select("*", _summary_text(chart_type, x_column, y_column).alias("summary_text"))


def _summary_text(chart_type: Column, x_column: Column, y_column: Column) -> Column:
    entries = F.concat(
        F.lit("Data contains "), F.col("n").cast("string"), F.lit(" entries across "), x_column, F.lit(".")
    )
    return (
        F.when(F.col("n_numeric") < F.col("n"), entries)
        .when(chart_type == "pie", pie_insight(y_column))
        .when(chart_type == "line", line_insight())
        .otherwise(bar_insight(y_column))
    )


def chart_results(requests: DataFrame, series: DataFrame) -> DataFrame:
    """A result per chart request, also for series that cannot be drawn.

    ``requests`` holds (series_id, chart_type, n_columns, x_column, y_column), one row per
    series. Both sides have one row per series when they are joined.
    """
    empty, narrow = F.col("n").isNull(), F.col("n_columns") < 2
    text = _summary_text(F.col("chart_type"), F.col("x_column"), F.col("y_column"))
    return requests.join(summarise(series), "series_id", "left").select(
        "series_id",
        F.when(empty | narrow, F.lit("bar")).otherwise(F.col("chart_type")).alias("chart_type"),
        F.coalesce("n", F.lit(0)).alias("entries"),
        F.when(empty, F.lit("no_data"))
        .when(narrow, F.lit("insufficient_columns"))
        .when(F.col("n_numeric") < F.col("n"), F.lit("not_numeric"))
        .otherwise(F.lit("ok"))
        .alias("status"),
        F.when(empty, F.lit("No data available for visualization."))
        .when(narrow, F.lit("Insufficient columns for chart generation."))
        .otherwise(text)
        .alias("summary_text"),
    )
