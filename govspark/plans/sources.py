"""A and B1: generators, files, catalog names, prompt arrivals and the Gold build."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark import rules, schemas
from govspark.functions.hashing import mix
from govspark.operators import access, analytics
from govspark.plans.base import (
    SQL_GOLD, Tables, plain, query, sql_between, sql_mix, sql_payment, sql_pick, sql_plain, sql_profile,
)
from govspark.session import scratch_dir
from govspark.sources import files, gold, prompts, synthetic
from govspark.streaming import jobs

_PROFILE = ",\n  ".join(f"{v} AS {k}" for k, v in sql_profile("c_custkey").items())


@query("a1_customer_profiles", f"SELECT {_PROFILE}\nFROM customer")
def customer_profiles(t: Tables):
    return synthetic.customer_profiles(t("customer").select("c_custkey"), "c_custkey")


def _ledger_sql() -> str:
    k = "o_orderkey"
    pay = sql_payment(k)
    products = " ".join(
        f"WHEN '{name.replace(chr(39), chr(39) * 2)}' THEN {sql_pick(k, 32, items)}"
        for name, items in rules.PRODUCTS.items()
    )
    return f"""WITH chosen AS (
  SELECT *, {sql_pick(k, 31, tuple(rules.PRODUCTS))} AS category,
    {sql_between(k, 34, 1250, 85000)} AS cents, {sql_between(k, 35, 1, 4)} AS qty
  FROM orders),
named AS (SELECT *, CASE category {products} END AS product_name FROM chosen)
SELECT 'ORD-' || (o_orderkey + 100000) AS order_id, 'TXN-' || (o_orderkey + 200000) AS transaction_id,
  'CUST-' || (o_custkey + 10000) AS customer_id,
  strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds({sql_between(k, 33, 0, 10368000)}), '%Y-%m-%d %H:%M:%S') AS order_date,
  upper(left(category, 3)) || '-' || {sql_between(k, 36, 100, 999)} || '-' || replace(upper(left(product_name, 3)), ' ', '') AS product_sku,
  product_name, category, CAST(qty AS INTEGER) AS quantity,
  cents / 100.0 AS price_per_unit, cents * qty / 100.0 AS total_amount,
  {pay['payment_method']} AS payment_method, {pay['credit_card_number']} AS credit_card_number,
  {pay['device_ip_address']} AS device_ip_address, {sql_pick(k, 37, rules.ORDER_STATUSES)} AS order_status
FROM named"""


@query("a2_order_ledger", _ledger_sql())
def order_ledger(t: Tables):
    keys = t("orders").select("o_orderkey", "o_custkey")
    return plain(synthetic.order_ledger(keys, "o_orderkey", "o_custkey"))


@query(
    "a3_parquet_scan",
    """SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
FROM lineitem GROUP BY 1, 2""",
)
def parquet_scan(t: Tables):
    lines = files.read_parquet(t.spark, t.path("lineitem"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity"),
    )


@query(
    "a4_parquet_roundtrip",
    f"""WITH {SQL_GOLD}
SELECT strftime(order_date, '%Y-%m') AS order_month, count(*) AS lines, CAST(sum(total_amount) AS DOUBLE) AS total_amount
FROM gold GROUP BY 1""",
)
def parquet_roundtrip(t: Tables):
    columns = ("order_id", "order_date", "category", "quantity", "total_amount")
    out = scratch_dir(t.spark, "gold-parquet")
    written = t.gold(columns).withColumn("order_month", analytics.month_of(F.col("order_date")))
    files.write_parquet(written, out, partition_by="order_month")
    stored = files.read_parquet(t.spark, out, written.schema)
    return stored.groupBy("order_month").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("total_amount").cast("double").alias("total_amount")
    )


@query("a5_csv_roundtrip", f"SELECT {_PROFILE}\nFROM customer")
def csv_roundtrip(t: Tables):
    out = scratch_dir(t.spark, "customers-csv")
    files.write_csv(customer_profiles(t), out)
    return files.read_csv(t.spark, out, schemas.CUSTOMER_PROFILE)


@query(
    "a6_catalog_lookup",
    f"""WITH {SQL_GOLD}
SELECT payment_method, count(*) AS lines, CAST(sum(total_amount) AS DOUBLE) AS total_amount FROM gold GROUP BY 1""",
)
def catalog_lookup(t: Tables):
    view = access.role_view(t.gold(("payment_method", "total_amount")), access.RESTRICTED)
    view.createOrReplaceGlobalTempView("gold_payments")
    named = files.catalog_table(t.spark, "global_temp", "gold_payments")
    return named.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("total_amount").cast("double").alias("total_amount")
    )


@query("a7_prompt_stream", "SELECT conv_id, turn, role, sha256(text) AS text_hash FROM conversations")
def prompt_stream(t: Tables):
    out = scratch_dir(t.spark, "prompts")
    arriving = prompts.prompt_stream(t.spark, t.path("conversations"))
    jobs.finish(jobs.append_to(arriving, f"{out}/data", f"{out}/checkpoint"))
    stored = files.read_parquet(t.spark, f"{out}/data", schemas.PROMPT_LOG)
    return stored.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))


@query("b1_gold_build", f"WITH {SQL_GOLD}\nSELECT {sql_plain(gold.GOLD)} FROM gold")
def gold_build(t: Tables):
    return plain(t.gold())


# Generated orders point at a generated customer as well, so the join of the generators is
# also checked with customers that have no order and orders whose customer is missing.
_MISSING = f"""WITH ledger AS (
  SELECT 'ORD-' || (o_orderkey + 100000) AS order_id,
    'CUST-' || ({sql_mix('o_orderkey', 38)} % 2000 + 10000) AS customer_id FROM orders),
profiles AS (SELECT {sql_profile('c_custkey')['customer_id']} AS customer_id, {sql_profile('c_custkey')['email']} AS email FROM customer)
SELECT l.order_id, l.customer_id, p.email FROM ledger l LEFT JOIN profiles p ON l.customer_id = p.customer_id"""


@query("b1_gold_unmatched", _MISSING)
def gold_unmatched(t: Tables):
    orders = t("orders").selectExpr(
        "concat('ORD-', o_orderkey + 100000L) AS order_id",
        f"{synthetic.customer_id('(' + mix('o_orderkey', 38) + ' % 2000L)')} AS customer_id",
    )
    profiles = customer_profiles(t).select("customer_id", "email")
    return gold.build_gold(orders, profiles)
