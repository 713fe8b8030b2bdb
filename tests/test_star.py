"""Gold by pieces: results equal those of the wide table, and expensive work stands below the joins."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from govspark.operators import access, audit, findings, medallion
from govspark.plans.base import Tables
from govspark.plans.guard import leak_audit as leak_audit_query
from govspark.plans.access import raw_sample as raw_sample_query
from govspark.sources.gold import GOLD, bucket_star, first_lines, gold_from_star, gold_star


def bag(df, columns=None):
    return Counter(map(tuple, df.select(*(columns or df.columns)).collect()))


def nodes(plan):
    """(depth, text) of the lines of a plan's tree."""
    return [(len(re.match(r"[ :+\-!*()\d]*", line).group()), line) for line in plan.splitlines() if line.strip()]


def below(plan, of, wanted):
    """How many nodes that hold ``of`` have one with ``wanted`` below."""
    lines, found = nodes(plan), 0
    for i, (depth, text) in enumerate(lines):
        if of in text:
            under = []
            for d, t in lines[i + 1 :]:
                if d <= depth:
                    break
                under.append(t)
            found += any(wanted in t for t in under)
    return found


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def star(spark, folder):
    """The test tables with a hot order, lines without a known order or part, and orders without a customer."""
    t = Tables(spark, folder)
    n = F.col("l_linenumber") + F.col("l_orderkey")
    key = F.when(n % 3 == 0, F.lit(7)).when(n % 17 == 1, F.lit(None)).when(n % 19 == 1, F.lit(-5)).otherwise(F.col("l_orderkey"))
    part = F.when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, F.lit(10**9)).otherwise(F.col("l_partkey"))
    buyer = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 1, F.lit(-1)).otherwise(F.col("o_custkey"))
    made = {
        "lineitem": t("lineitem").withColumns({"l_orderkey": key.cast("long"), "l_partkey": part.cast("long")}),
        "orders": t("orders").withColumn("o_custkey", buyer.cast("long")),
        "customer": t("customer"),
        "part": t("part"),
    }
    return made.__getitem__


def without_lines(star):
    return lambda name: star(name).limit(0) if name == "lineitem" else star(name)


def test_pieces_join_to_gold(star):
    assert bag(gold_star(star).joined(), GOLD) == bag(gold_from_star(star))
    some = ["order_id", "email", "category", "credit_card_number"]
    assert bag(gold_star(star, some).joined(), some) == bag(gold_from_star(star, some), some)


def test_pieces_are_shuffled_once_for_each_join(star, spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(gold_star(star, ["order_id", "email"]).joined())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The count of keys; keys, orders and lines by order; lines and customers by customer.
    assert plan.count("hashpartitioning(") == 6 and "hashpartitioning(l_partkey" not in plan


def test_parts_listed_twice_double_their_lines(star, spark):
    twice = lambda name: star(name).union(star(name)) if name == "part" else star(name)
    for columns in (["total_amount", "order_id"], ["total_amount", "category"]):
        lines = star("lineitem").join(twice("part"), F.col("l_partkey") == F.col("p_partkey"), "left").count()
        assert gold_star(twice, columns).joined().count() == lines > star("lineitem").count()


def test_weights_count_the_gold_rows(star):
    gold = gold_from_star(star, ["email", "category", "order_status"])
    pieces = gold_star(star, ["email", "category", "order_status"]).weighted()
    for name, c in (("customers", "email"), ("part", "category"), ("orders", "order_status")):
        got = {r[c]: r["n"] for r in pieces[name].groupBy(c).agg(F.sum("lines").alias("n")).collect()}
        assert got == {r[c]: r["count"] for r in gold.filter(F.col(c).isNotNull()).groupBy(c).count().collect()}


@pytest.mark.parametrize("empty", [False, True])
def test_leak_audit_of_pieces_equals_that_of_rows(star, empty):
    star = without_lines(star) if empty else star
    assert bag(audit.leak_audit_of_star(gold_star(star))) == bag(audit.leak_audit(gold_from_star(star)))


def test_masks_equal_the_serialised_form(star, spark, tmp_path):
    """A row's mask is that of its columns one by one: no detector reaches over the separator."""
    gold_from_star(star).withColumn("n", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/gold")
    gold = spark.read.parquet(f"{tmp_path}/gold")
    parts = [audit.leak_masks(gold.select("n", c), ["n"]) for c in GOLD]
    merged = parts[0]
    for df in parts[1:]:
        merged = merged.unionByName(df)
    merged = merged.groupBy("n").agg(F.bit_or("ungoverned").alias("ungoverned"), F.bit_or("governed").alias("governed"))
    assert bag(merged) == bag(audit.leak_masks(gold, ["n"]))


@pytest.mark.parametrize("empty", [False, True])
def test_profile_of_pieces_equals_that_of_rows(star, empty):
    star = without_lines(star) if empty else star
    names = ["column_name", "category", "rows_matched", "n_values"]
    for threshold in (0.0, 0.5):
        assert bag(findings.profile_star(gold_star(star), threshold=threshold), names) == bag(
            findings.profile_columns(gold_from_star(star), threshold=threshold), names
        )


def test_promotion_of_pieces_equals_that_of_rows(star, tmp_path):
    got = medallion.promote_star(gold_star(star), f"{tmp_path}/silver", f"{tmp_path}/gold", "salt")
    expected = medallion.to_gold(medallion.to_silver(gold_from_star(star), "salt"))
    assert sorted(got.columns) == sorted(expected.columns)
    assert bag(got, expected.columns) == bag(expected)


def test_silver_pieces_hold_no_raw_identifier(star, spark, tmp_path):
    medallion.promote_star(gold_star(star), f"{tmp_path}/silver", f"{tmp_path}/gold", "salt")
    raw = {v for r in gold_from_star(star, ["email", "national_id"]).collect() for v in r if v}
    for name in ("customers", "keys"):
        assert not raw & {str(v) for r in spark.read.parquet(f"{tmp_path}/silver/{name}").collect() for v in r}


def test_patterns_and_hashes_stand_below_the_joins(spark, folder):
    plan = optimized(leak_audit_query(Tables(spark, folder)))
    assert "RLIKE" in plan and "Join" in plan and below(plan, "RLIKE", "Join") == 0
    tokens = medallion.to_silver(gold_star(Tables(spark, folder)).by_order().select("l_orderkey", "email"), "salt")
    assert below(optimized(tokens), "sha2", "Join") == 1  # what the pieces avoid
    pieces = gold_star(Tables(spark, folder)).map(lambda df: medallion.to_silver(df, "salt")).joined()
    assert "sha2" in optimized(pieces) and below(optimized(pieces), "sha2", "Join") == 0


def test_profile_builds_no_wide_rows(spark, folder):
    plan = optimized(findings.profile_star(gold_star(Tables(spark, folder))))
    # Joins only bring numbers of lines to a look-up table.
    assert below(plan, "Join LeftOuter", "Relation") == 0


def test_sample_takes_the_lowest_ids_before_it_joins(spark, folder, star):
    plan = optimized(raw_sample_query(Tables(spark, folder)))
    assert below(plan, "Join LeftOuter", "GlobalLimit 10") > 0
    order = ["order_id", "product_sku", "quantity", "total_amount"]
    for rows in (1, 10, 500):
        late = access.raw_sample(gold_from_star(first_lines(star, rows)), access.RESTRICTED, order, rows)
        wide = access.raw_sample(gold_from_star(star), access.RESTRICTED, order, rows)
        assert bag(late, order) == bag(wide, order)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_lines_are_shuffled_once_at_most(star, no_broadcast):
    plain = gold_from_star(star)
    stored = bucket_star(star, "star_test", 8)
    gold = gold_from_star(stored)
    assert below(physical(gold), "Exchange", "l_extendedprice") <= 1
    assert below(physical(plain), "Exchange", "l_extendedprice") == 2
    # The buyers' side never waits for lines.
    without_part = gold_from_star(stored, [c for c in GOLD if c not in ("product_sku", "product_name", "category")])
    assert below(physical(without_part), "Exchange", "l_extendedprice") == 0
    assert bag(gold) == bag(plain)
