"""Business questions over the Gold table and its star schema.

All aggregates combine map side, so a category, product or month that holds a large part of
the rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import rules
from govspark.operators.joins import lookup_join


def month_of(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def sales_by(df: DataFrame, by: str, amount: str = "total_amount", out: str = "total_amount") -> DataFrame:
    """Sum of an exact decimal amount per group."""
    return df.groupBy(by).agg(F.sum(amount).alias(out))


def _by_month(df: DataFrame, moment: str, total: Column) -> DataFrame:
    """Group by the month as a date, and write it as text only once per month."""
    return (
        df.groupBy(F.trunc(moment, "month").alias("_month"))
        .agg(total)
        .withColumn("order_month", month_of(F.col("_month")))
        .orderBy("_month")
        .drop("_month")
    )


def monthly_count(df: DataFrame, moment: str, out: str = "order_count") -> DataFrame:
    """Rows per month, in time order."""
    return _by_month(df, moment, F.count(F.lit(1)).alias(out)).select("order_month", out)


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Rows and share of all rows per group.

    The total comes from a scalar subquery over the grouped counts. A window without
    partitions would pull every group into one task.
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("order_count"))
    total = counts.agg(F.sum("order_count")).scalar()
    return counts.withColumn("share", F.col("order_count").cast("double") / total)


def top_products(
    df: DataFrame, by: str = "product_name", amount: str = "total_amount", n: int = rules.TOP_PRODUCTS
) -> DataFrame:
    """Best sellers by revenue; ties go by name. Planned as a top-n per task."""
    return sales_by(df, by, amount, "revenue").orderBy(F.desc("revenue"), by).limit(n)


def revenue_by_region(
    lines: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Revenue per region.

    ``lines`` holds (o_orderkey, amount). Amounts are summed per order and then per customer
    before each join, so both sides of every large join have one row per key and no key can
    be hot. Nation and region are tiny, and by then so is the left side.
    """
    per_order = lines.groupBy("o_orderkey").agg(F.sum("amount").alias("amount"))
    per_customer = (
        per_order.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey", "left")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum("amount").alias("amount"))
    )
    per_nation = (
        per_customer.join(customer.select("c_custkey", "c_nationkey"), "c_custkey", "left")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.sum("amount").alias("amount"))
    )
    return (
        per_nation.join(nation.select("n_nationkey", "n_regionkey"), "n_nationkey", "left")
        .join(region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
        .groupBy(F.col("r_name").alias("region"))
        .agg(F.sum("amount").alias("revenue"))
    )


def monthly_revenue(df: DataFrame, moment: str, amount: str, months: int = 6) -> DataFrame:
    """Revenue per month over the last months of the table, in time order.

    The first month is a scalar subquery on the maximum date, so the range condition reaches
    the scan as a pushed filter.
    """
    first = df.agg(F.add_months(F.trunc(F.max(moment), "month"), 1 - months).cast("timestamp_ntz")).scalar()
    recent = df.filter(F.col(moment) >= first)
    return _by_month(recent, moment, F.sum(amount).alias("revenue")).select("order_month", "revenue")


def orders_with_nation(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders with the nation of their customer."""
    nations = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return lookup_join(orders, nations, "o_custkey")
