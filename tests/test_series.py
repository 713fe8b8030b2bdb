"""Chart insights and series status."""

import pytest
from pyspark.sql import functions as F

from govspark.operators import series


def insight(spark, rows, chart, x="label", y="value"):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "sid string, pos int, l string, v string")
    points = series.build_series(df, F.col("sid"), F.col("pos"), F.col("l"), F.col("v"))
    return series.insights(points, F.lit(chart), F.lit(x), F.lit(y)).first()["summary_text"]


REGIONS = [("APAC", "1200000"), ("EU", "420000"), ("NA", "890000")]
MONTHS = [("Jan", "100"), ("Feb", "120"), ("Mar", "150"), ("Apr", "180")]
PRODUCTS = [("Widget Pro", "45"), ("DataSync", "30"), ("CloudBase", "25")]


@pytest.mark.parametrize(
    ("rows", "chart", "names", "want"),
    [
        (REGIONS, "bar", ("region", "revenue"), "APAC leads with 1200000 in revenue."),
        (MONTHS, "line", ("month", "value"), "Trend shows 80% growth from Jan to Apr."),
        (PRODUCTS, "pie", ("product", "share"), "Widget Pro leads with 45% of total share."),
        ([("Jan", "100"), ("Dec", "200")], "line", ("m", "v"), "Trend shows 100% growth from Jan to Dec."),
        ([("Jan", "200"), ("Dec", "100")], "line", ("m", "v"), "Trend shows 50% decline from Jan to Dec."),
        ([("Jan", "5"), ("Dec", "5")], "line", ("m", "v"), "Trend shows 0% decline from Jan to Dec."),
        ([("Jan", "0"), ("Dec", "5")], "line", ("m", "v"), "Trend data spans 2 periods."),
        ([("a", "3"), ("b", "3")], "bar", ("x", "y"), "a leads with 3 in y."),
        ([("a", "0"), ("b", "0")], "pie", ("x", "y"), "a has the highest y."),
        ([("a", "1"), ("b", "n/a")], "bar", ("x", "y"), "Data contains 2 entries across x."),
        ([(None, None), ("b", "-1")], "bar", ("x", "y"), "Unknown leads with 0 in y."),
        # Halves go to the even neighbour: 1/40 is 2.5 %.
        ([("a", "40"), ("b", "41")], "line", ("x", "y"), "Trend shows 2% growth from a to b."),
    ],
)
def test_insights(spark, rows, chart, names, want):
    assert insight(spark, rows, chart, *names) == want


def test_many_series_at_once_with_text_positions(spark):
    df = spark.createDataFrame(
        [("p", "2024-02", "7"), ("p", "2024-01", "4"), ("q", "2024-01", "10"), ("q", "2024-03", "5")],
        "sid string, m string, v string",
    )
    points = series.build_series(df, F.col("sid"), F.col("m"), F.col("m"), F.col("v"))
    out = {r["series_id"]: r["summary_text"] for r in series.insights(points, F.lit("line"), F.lit("m"), F.lit("v")).collect()}
    assert out == {
        "p": "Trend shows 75% growth from 2024-01 to 2024-02.",
        "q": "Trend shows 50% decline from 2024-01 to 2024-03.",
    }


def test_status_of_requests(spark):
    requests = spark.createDataFrame(
        [("ok", "line", 2), ("empty", "pie", 2), ("narrow", "pie", 1), ("words", "bar", 3)],
        "series_id string, chart_type string, n_columns int",
    ).withColumns({"x_column": F.lit("x"), "y_column": F.lit("y")})
    df = spark.createDataFrame(
        [("ok", 1, "a", "1"), ("ok", 2, "b", "3"), ("narrow", 1, "a", "1"), ("words", 1, "a", "many")],
        "sid string, pos int, l string, v string",
    )
    points = series.build_series(df, F.col("sid"), F.col("pos"), F.col("l"), F.col("v"))
    out = {r["series_id"]: (r["status"], r["chart_type"], r["entries"], r["summary_text"]) for r in series.chart_results(requests, points).collect()}
    assert out == {
        "ok": ("ok", "line", 2, "Trend shows 200% growth from a to b."),
        "empty": ("no_data", "bar", 0, "No data available for visualization."),
        "narrow": ("insufficient_columns", "bar", 1, "Insufficient columns for chart generation."),
        "words": ("not_numeric", "bar", 1, "Data contains 1 entries across x."),
    }
