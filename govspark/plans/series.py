"""K and L1: chart types, series, insights and intent."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark import rules
from govspark.operators import analytics, prompts, series
from govspark.plans.base import SQL_PROMPT_LOG, Tables, prompt_log, query, sql_list


def _any(words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains(lower(text), w))) > 0"


@query(
    "k1_chart_type",
    f"""WITH {SQL_PROMPT_LOG}
SELECT conv_id, turn, CASE WHEN {_any(rules.PIE_KEYWORDS)} THEN 'pie' WHEN {_any(rules.LINE_KEYWORDS)} THEN 'line'
  ELSE 'bar' END AS chart_type FROM prompt_log""",
)
def chart_type(t: Tables):
    return prompts.with_intent(prompt_log(t)).select("conv_id", "turn", "chart_type")


@query(
    "k2_dataset_kind",
    f"""WITH {SQL_PROMPT_LOG}, joined AS (SELECT conv_id, turn, text || ' monthly share' AS text FROM prompt_log
  UNION ALL SELECT conv_id, turn, text FROM prompt_log)
SELECT conv_id, turn, CASE WHEN {_any(rules.LINE_KEYWORDS)} THEN 'line' WHEN {_any(rules.PIE_KEYWORDS)} THEN 'pie'
  ELSE 'bar' END AS dataset_kind FROM joined""",
)
def dataset_kind(t: Tables):
    log = prompt_log(t)
    both_kinds = log.withColumn("text", F.concat("text", F.lit(" monthly share")))
    return prompts.with_intent(log.unionByName(both_kinds)).select("conv_id", "turn", "dataset_kind")


_MONTHLY = """monthly AS (SELECT c_nationkey, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS revenue
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _monthly(t: Tables):
    orders = t("orders").select("o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    return (
        analytics.orders_with_nation(orders, t("customer"))
        .groupBy("c_nationkey", analytics.month_of(F.col("o_orderdate")).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("revenue"))
    )


def _monthly_series(t: Tables, value: str):
    # A month text is unique in its series and sorts in time order.
    return series.build_series(_monthly(t), F.col("c_nationkey"), F.col("month"), F.col("month"), F.col(value))


@query(
    "k3_series",
    f"""WITH {_MONTHLY}
SELECT CAST(c_nationkey AS VARCHAR) AS series_id, m AS pos, m AS label, CAST(revenue AS VARCHAR) AS value FROM monthly""",
)
def series_points(t: Tables):
    return _monthly_series(t, "revenue")


_BY_PRIORITY = """points AS (SELECT CAST(c_nationkey AS VARCHAR) AS series_id, o_orderpriority AS label, count(*) AS v
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
leaders AS (SELECT series_id, label, v, sum(v) OVER (PARTITION BY series_id) AS total,
  row_number() OVER (PARTITION BY series_id ORDER BY v DESC, label) AS rn FROM points)"""


def _priority_series(t: Tables):
    counts = (
        analytics.orders_with_nation(t("orders").select("o_custkey", "o_orderpriority"), t("customer"))
        .groupBy("c_nationkey", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    label = F.col("o_orderpriority")
    return series.build_series(counts, F.col("c_nationkey"), label, label, F.col("n"))


def _insight(points, chart: str, x: str, y: str):
    return series.insights(points, F.lit(chart), F.lit(x), F.lit(y)).select("series_id", "summary_text")


@query(
    "k4_bar_insight",
    f"""WITH {_BY_PRIORITY}
SELECT series_id, label || ' leads with ' || v || ' in order_count.' AS summary_text FROM leaders WHERE rn = 1""",
)
def bar_insight(t: Tables):
    return _insight(_priority_series(t), "bar", "priority", "order_count")


@query(
    "k5_pie_insight",
    f"""WITH {_BY_PRIORITY}
SELECT series_id, label || ' leads with ' || printf('%.0f', CAST(v AS DOUBLE) / CAST(total AS DOUBLE) * 100) || '% of total order_count.' AS summary_text
FROM leaders WHERE rn = 1""",
)
def pie_insight(t: Tables):
    return _insight(_priority_series(t), "pie", "priority", "order_count")


_CHANGE = "((CAST(last_n AS DOUBLE) - CAST(first_n AS DOUBLE)) / CAST(first_n AS DOUBLE) * 100)"


@query(
    "k6_line_insight",
    f"""WITH {_MONTHLY}, ends AS (SELECT CAST(c_nationkey AS VARCHAR) AS series_id, arg_min(n, m) AS first_n, arg_max(n, m) AS last_n,
  min(m) AS first_m, max(m) AS last_m FROM monthly GROUP BY 1)
SELECT series_id, 'Trend shows ' || printf('%.0f', abs({_CHANGE})) || '% ' || CASE WHEN {_CHANGE} > 0 THEN 'growth' ELSE 'decline' END
  || ' from ' || first_m || ' to ' || last_m || '.' AS summary_text FROM ends""",
)
def line_insight(t: Tables):
    return _insight(_monthly_series(t, "n"), "line", "order_month", "order_count")


@query(
    "k7_series_status",
    """WITH points AS (SELECT o_custkey, o_orderkey, c_mktsegment = 'BUILDING' AS textual, o_orderpriority AS p,
    CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS v, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS shown
  FROM orders JOIN customer ON o_custkey = c_custkey),
facts AS (SELECT o_custkey, count(*) AS n, arg_min(shown, (-v, o_orderkey)) AS top_shown, arg_min(o_orderkey, (-v, o_orderkey)) AS top_label,
  bool_or(textual) AS textual FROM points GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS series_id, 'bar' AS chart_type, coalesce(n, 0) AS entries,
  CASE WHEN n IS NULL THEN 'no_data' WHEN c_mktsegment = 'MACHINERY' THEN 'insufficient_columns'
       WHEN textual THEN 'not_numeric' ELSE 'ok' END AS status,
  CASE WHEN n IS NULL THEN 'No data available for visualization.'
       WHEN c_mktsegment = 'MACHINERY' THEN 'Insufficient columns for chart generation.'
       WHEN textual THEN 'Data contains ' || n || ' entries across order_id.'
       ELSE top_label || ' leads with ' || top_shown || ' in total.' END AS summary_text
FROM customer LEFT JOIN facts ON c_custkey = o_custkey""",
)
def series_status(t: Tables):
    """One chart request per customer over the customer's orders. Some customers have no
    order, one segment asks for a single column, one has text where a number belongs."""
    customer = t("customer")
    requests = customer.select(
        F.col("c_custkey").cast("string").alias("series_id"),
        F.lit("bar").alias("chart_type"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(1)).otherwise(F.lit(2)).alias("n_columns"),
        F.lit("order_id").alias("x_column"),
        F.lit("total").alias("y_column"),
    )
    segments = customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = analytics.lookup_join(t("orders"), segments, "o_custkey")
    value = F.when(F.col("c_mktsegment") == "BUILDING", F.col("o_orderpriority")).otherwise(
        F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    )
    key = F.col("o_orderkey")
    points = series.build_series(orders, F.col("o_custkey"), key, key, value)
    return series.chart_results(requests, points)


@query(
    "k8_chart_title",
    """WITH asked AS (SELECT conv_id, turn, '  ' || text || ' ??' AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_replace(text, '^\\s+|\\s*\\?*\\s*$', '', 'g') = '' THEN 'Analytics Chart'
  ELSE regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\?+$', ''), '^\\s+|\\s+$', '', 'g') END AS title FROM asked""",
)
def chart_title(t: Tables):
    asked = F.concat(F.lit("  "), F.col("text"), F.lit(" ??"))
    return prompts.with_intent(t("conversations").withColumn("text", asked)).select("conv_id", "turn", "title")


@query(
    "l1_analytics_intent",
    f"""WITH {SQL_PROMPT_LOG}
SELECT preset_id, {_any(rules.ANALYTICS_KEYWORDS)} AS is_analytics, count(*) AS prompts FROM prompt_log GROUP BY 1, 2""",
)
def analytics_intent(t: Tables):
    return (
        prompts.with_intent(prompt_log(t)).groupBy("preset_id", "is_analytics").agg(F.count(F.lit(1)).alias("prompts"))
    )
