"""J: the business questions, on Gold and on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.operators import access, analytics
from govspark.plans.base import SQL_GOLD, Tables, plain, query


@query(
    "j1_sales_by_category",
    f"WITH {SQL_GOLD}\nSELECT category, CAST(sum(total_amount) AS DOUBLE) AS total_amount FROM gold GROUP BY 1",
)
def sales_by_category(t: Tables):
    return plain(analytics.sales_by(t.gold(("category", "total_amount")), "category"))


@query(
    "j2_monthly_order_count",
    "SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS order_count FROM orders GROUP BY 1",
)
def monthly_order_count(t: Tables):
    return analytics.monthly_count(t("orders").select("o_orderdate"), "o_orderdate")


@query(
    "j3_distribution_by_product",
    f"""WITH {SQL_GOLD}, counts AS (SELECT product_name, count(*) AS order_count FROM gold GROUP BY 1)
SELECT product_name, order_count, CAST(order_count AS DOUBLE) / sum(order_count) OVER () AS share FROM counts""",
)
def distribution_by_product(t: Tables):
    return analytics.distribution(t.gold(("product_name",)), "product_name")


@query(
    "j3_distribution_by_category",
    f"""WITH {SQL_GOLD}, counts AS (SELECT category, count(*) AS order_count FROM gold GROUP BY 1)
SELECT category, order_count, CAST(order_count AS DOUBLE) / sum(order_count) OVER () AS share FROM counts""",
)
def distribution_by_category(t: Tables):
    return analytics.distribution(t.gold(("category",)), "category")


@query(
    "j4_top_products",
    f"""WITH {SQL_GOLD}
SELECT product_name, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM gold GROUP BY 1
ORDER BY sum(total_amount) DESC, product_name LIMIT 5""",
)
def top_products(t: Tables):
    return plain(analytics.top_products(t.gold(("product_name", "total_amount"))))


@query(
    "j5_revenue_by_region",
    """SELECT r_name AS region, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def revenue_by_region(t: Tables):
    lines = t("lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("decimal(12,2)").alias("amount")
    )
    return plain(
        analytics.revenue_by_region(lines, t("orders"), t("customer"), t("nation"), t("region"))
    )


@query(
    "j6_monthly_revenue",
    """WITH edge AS (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 5 MONTH AS first_month FROM orders)
SELECT strftime(o_orderdate, '%Y-%m') AS order_month, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM orders, edge WHERE o_orderdate >= first_month GROUP BY 1""",
)
def monthly_revenue(t: Tables):
    orders = t("orders").select("o_orderdate", F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    return plain(analytics.monthly_revenue(orders, "o_orderdate", "amount"))


@query(
    "j7_restricted_analytics",
    f"""WITH {SQL_GOLD}
SELECT category, order_status, count(*) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS total_amount,
  CAST(sum(quantity) AS BIGINT) AS units FROM gold GROUP BY 1, 2""",
)
def restricted_analytics(t: Tables):
    view = access.role_view(
        t.gold(("category", "order_status", "total_amount", "quantity", "transaction_id")), access.RESTRICTED
    )
    return plain(
        view.groupBy("category", "order_status").agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("total_amount").alias("total_amount"),
            F.sum("quantity").alias("units"),
        )
    )


def governed_sales_by_category(t: Tables):
    """The flagship query: sales by category through the restricted role's view of Gold."""
    columns = access.role_columns(("category", "total_amount"), access.RESTRICTED, access.ColumnPolicy())
    view = access.role_view(t.gold(columns), access.RESTRICTED)
    return plain(analytics.sales_by(view, "category").orderBy("category"))
