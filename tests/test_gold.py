"""Generators, the Gold build, skewed joins, files, column access and analytics."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from govspark import rules, schemas
from govspark.operators import access, analytics
from govspark.operators.audit import leak_audit
from govspark.operators.joins import lookup_join
from govspark.plans.base import Tables
from govspark.session import scratch_dir
from govspark.sources import files
from govspark.sources.gold import GOLD, build_gold
from govspark.sources.synthetic import synthetic_customers, synthetic_orders


def plan_of(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


def scanned_columns(df):
    return set(re.findall(r"([a-z]+_[a-z]+):", " ".join(re.findall(r"ReadSchema: (.*)", plan_of(df)))))


def test_generated_customers(spark):
    rows = synthetic_customers(spark).collect()
    assert len(rows) == 250 and list(rows[0].asDict()) == schemas.CUSTOMER_PROFILE.fieldNames()
    shapes = {
        "customer_id": r"CUST-1\d{4}", "email": r"[a-z]+\.[a-z]+\d\d@\w+\.com", "phone_number": r"\+1-\d{3}-\d{3}-\d{4}",
        "national_id": r"\d{3}-\d\d-\d{4}", "date_of_birth": r"(19|20)\d\d-\d\d-\d\d",
        "shipping_address": r"\d+ [\w ]+, [\w ]+, [A-Z]{2} \d{5}",
    }
    for r in rows:
        assert all(re.fullmatch(p, r[c]) for c, p in shapes.items())
        assert r["first_name"] in rules.FIRST_NAMES and r["last_name"] in rules.LAST_NAMES
        assert r["email"].startswith(f"{r['first_name']}.{r['last_name']}".lower())
        assert r["shipping_address"] == r["billing_address"]
    # Every pool is used, and names are not tied to each other.
    assert {r["first_name"] for r in rows} == set(rules.FIRST_NAMES)
    assert len({(r["first_name"], r["last_name"]) for r in rows}) > 80


def test_generated_orders(spark):
    rows = synthetic_orders(spark).collect()
    assert len(rows) == 2500 and list(rows[0].asDict()) == schemas.ORDER_LEDGER.fieldNames()
    known = {r["customer_id"] for r in synthetic_customers(spark).collect()}
    for r in rows:
        assert r["customer_id"] in known
        assert r["product_name"] in rules.PRODUCTS[r["category"]]
        assert r["total_amount"] == r["price_per_unit"] * r["quantity"] and 1 <= r["quantity"] <= 4
        assert 12.5 <= r["price_per_unit"] <= 850
        assert "2026-01-01 00:00:00" <= r["order_date"] <= "2026-05-01 00:00:00"
        assert re.fullmatch(r"4\d{3}(-\d{4}){3}", r["credit_card_number"])
        assert re.fullmatch(r"\d+(\.\d+){3}", r["device_ip_address"])
        sku_tail = r["product_name"][:3].upper().replace(" ", "")
        assert re.fullmatch(rf"{r['category'][:3].upper()}-\d{{3}}-{sku_tail}", r["product_sku"])
    status = Counter(r["order_status"] for r in rows)
    assert 0.35 < status["Completed"] / 2500 < 0.45
    assert {r["category"] for r in rows} == set(rules.PRODUCTS)


def test_generators_repeat(spark):
    assert synthetic_orders(spark, 100).collect() == synthetic_orders(spark, 100).collect()


def test_gold_keeps_orders_without_customer(spark):
    customers = synthetic_customers(spark, 2)
    orders = synthetic_orders(spark, 50, customers=4)
    gold = build_gold(orders, customers)
    assert tuple(gold.columns) == GOLD and gold.count() == 50
    missing = gold.filter("email IS NULL")
    assert missing.count() == orders.filter("customer_id NOT IN ('CUST-10000', 'CUST-10001')").count() > 0


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key, many have none, some keys have no match."""
    left = spark.range(9000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, F.lit(7))
        .when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise(F.col("id") % 500)
        .cast("long")
        .alias("k"),
    )
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return left, right


def test_join_splits_the_hot_key(skewed, spark):
    left, right = skewed
    plain = Counter(map(tuple, lookup_join(left, right, "k").select("row", "k", "v").collect()))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        joined = lookup_join(left.repartition(8), right, "k").select("row", "k", "v")
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert Counter(map(tuple, rows)) == plain and "skew=true" in plan


def test_join_on_two_keys(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", None, 12), (None, 1, 13)], "x string, y long, r long")
    right = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q")], "x string, y long, v string")
    joined = lookup_join(left, right, ["x", "y"])
    assert {(r["r"], r["v"]) for r in joined.collect()} == {(10, "p"), (11, None), (12, None), (13, None)}


def test_gold_without_broadcast_is_the_same(spark, folder):
    from govspark.sources.gold import gold_from_star

    t = Tables(spark, folder)
    columns = ["order_id", "customer_id", "product_name", "email", "total_amount"]
    plain = Counter(map(tuple, gold_from_star(t, columns).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.execution.reuseSubquery", "false")
    try:
        assert Counter(map(tuple, gold_from_star(t, columns).collect())) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.execution.reuseSubquery", "true")


def test_csv_keeps_line_breaks_and_empty_texts(spark, tmp_path):
    rows = [("a", "line1\nline2"), ("b", ""), ("c", None), ("d", "\\n\\\\e"), ("e", ' "x", y\r '), ("f", "\\e"), ("g", "\n\\")]
    df = spark.createDataFrame(rows, "k string, v string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/csv", df.schema).collect())) == sorted(rows)


def test_small_right_side_is_broadcast(spark, folder):
    plan = plan_of(Tables(spark, folder).gold(["category", "total_amount"]))
    assert "BroadcastHashJoin" in plan and "approx_top_k" not in plan


def test_gold_reads_only_what_is_asked(spark, folder):
    t = Tables(spark, folder)
    assert scanned_columns(t.gold(["category", "total_amount"])) == {"l_partkey", "l_extendedprice", "p_partkey", "p_type"}
    assert scanned_columns(t.gold(["order_id", "payment_method"])) == {"l_orderkey"}


def test_filters_reach_the_scan(spark, folder):
    t = Tables(spark, folder)
    plan = plan_of(t.gold(["order_status", "total_amount"]).filter("order_status = 'F'"))
    assert "EqualTo(o_orderstatus,F)" in plan
    recent = t("orders").filter("o_orderdate >= TIMESTAMP_NTZ'1999-01-01 00:00:00'").select("o_totalprice")
    assert "GreaterThanOrEqual(o_orderdate,1999-01-01T00:00)" in plan_of(recent)
    assert scanned_columns(recent) == {"o_orderdate", "o_totalprice"}


def test_restricted_view_never_mentions_denied_columns(spark, folder):
    t = Tables(spark, folder)
    t.gold().write.mode("overwrite").parquet(path := scratch_dir(spark, "gold"))
    stored = spark.read.parquet(path)
    view = access.role_view(stored, access.RESTRICTED)
    assert sorted(view.columns) == sorted(rules.ALLOWED_COLUMNS)
    plan = plan_of(view.groupBy("category").agg(F.sum("total_amount")))
    assert not [c for c in (*rules.DENIED_COLUMNS, "transaction_id") if c in plan]
    for c in (*rules.DENIED_COLUMNS, "transaction_id"):
        with pytest.raises(AnalysisException):
            view.select(c).schema  # noqa: B018


def test_access_check_fails_closed():
    for role, policy in [("guest", access.ColumnPolicy()), (None, access.ColumnPolicy()), (access.RESTRICTED, None)]:
        with pytest.raises(access.AccessDenied):
            access.role_columns(GOLD, role, policy)
    both = access.ColumnPolicy(allowed=("a", "b"), denied=("b",))
    assert access.role_columns(["a", "b", "c"], access.RESTRICTED, both) == ["a"]


def test_classes_partition_the_schema(spark, folder):
    exposure = access.column_exposure(Tables(spark, folder).gold())
    audit = {r["column_name"]: r["access"] for r in access.access_audit(exposure).collect()}
    assert Counter(audit.values()) == {"ALLOWED": 11, "DENIED": 10, "UNCLASSIFIED": 1}
    assert audit["transaction_id"] == "UNCLASSIFIED" and set(audit) == set(GOLD)
    assert [r["column_name"] for r in access.unclassified_columns(exposure).collect()] == ["transaction_id"]


def test_access_report_order(spark, folder):
    exposure = access.column_exposure(Tables(spark, folder).gold(["email", "order_id"]))
    report = access.access_report(exposure).orderBy("line_no").collect()
    assert len(report) == 24
    assert report[0]["line"] == "✅ ALLOWED: customer_id" and report[11]["line"] == "🚫 DENIED: first_name"
    assert report[-1]["line"] == "Summary: 10 columns denied and excluded from response context"
    assert {r["line"]: r["n_values"] for r in report}["🚫 DENIED: email"] == 6000
    summary = access.access_summary(access.access_audit(exposure)).first()
    assert summary["has_denied"] and summary["denied_values"] == 6000


def test_role_views_and_sample(spark, folder):
    gold = Tables(spark, folder).gold()
    access.register_role_views(gold, "gold")
    assert files.catalog_table(spark, None, "gold_permissive").columns == list(GOLD)
    assert "email" not in files.catalog_table(spark, None, "gold_restricted").columns
    sample = access.raw_sample(gold, access.RESTRICTED, ["order_id", "product_sku"])
    assert sample.count() == 10 and "TakeOrderedAndProject" in plan_of(sample)


def test_only_the_ungoverned_path_leaks(spark, folder):
    rows = {r["path"]: r for r in leak_audit(Tables(spark, folder).gold()).collect()}
    assert rows["governed"]["leaked_rows"] == 0
    assert rows["ungoverned"]["leaked_rows"] == rows["ungoverned"]["n_rows"] == 6000
    assert rows["ungoverned"]["phone_rows"] == rows["ungoverned"]["email_rows"] == 6000


def test_csv_and_parquet_round_trip(spark, tmp_path):
    customers = synthetic_customers(spark, 30).withColumn(
        "last_name", F.when(F.col("customer_id") == "CUST-10003", F.lit('O"Neil, the 3rd')).otherwise(F.col("last_name"))
    )
    files.write_csv(customers, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c", schemas.CUSTOMER_PROFILE)
    assert sorted(back.collect()) == sorted(customers.collect())
    orders = synthetic_orders(spark, 200).withColumn("order_month", F.left("order_date", F.lit(7)))
    files.write_parquet(orders, f"{tmp_path}/p", partition_by="order_month")
    stored = files.read_parquet(spark, f"{tmp_path}/p", orders.schema)
    assert sorted(stored.select(orders.columns).collect()) == sorted(orders.collect())
    assert "PartitionFilters: [isnotnull(order_month" in plan_of(stored.filter("order_month = '2026-02'"))


def test_fixed_rows(spark):
    df = files.fixed_rows(spark, [("a'\"\\", 1, None), ("é", 2, True)], "s string, n int, b boolean")
    assert sorted(map(tuple, df.collect())) == [("a'\"\\", 1, None), ("é", 2, True)]


def test_distribution_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    rows = {r["c"]: (r["order_count"], r["share"]) for r in analytics.distribution(df, "c").collect()}
    assert rows == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}


def test_top_products_break_ties_by_name(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "product_name string, total_amount long")
    top = analytics.top_products(df, n=3)
    assert [r["product_name"] for r in top.collect()] == ["c", "a", "b"]
    assert "TakeOrderedAndProject" in plan_of(top)


def test_monthly_revenue_takes_last_months_only(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-31 10:00:00' AS d, 5 AS a UNION ALL SELECT TIMESTAMP_NTZ'2024-05-30 00:00:00', 7 "
        "UNION ALL SELECT TIMESTAMP_NTZ'2024-06-01 00:00:00', 1 UNION ALL SELECT TIMESTAMP_NTZ'2023-12-31 23:59:59', 9"
    )
    rows = analytics.monthly_revenue(df, "d", "a").collect()
    assert [tuple(r) for r in rows] == [("2024-01", 5), ("2024-05", 7), ("2024-06", 1)]


def test_region_revenue_without_skewed_joins(spark, folder):
    t = Tables(spark, folder)
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("decimal(12,2)").alias("amount"))
    got = analytics.revenue_by_region(lines, t("orders"), t("customer"), t("nation"), t("region")).collect()
    total = t("lineitem").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)"))).first()[0]
    assert sum(r["revenue"] for r in got) == total
