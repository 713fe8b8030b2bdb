"""The Gold table: orders left-joined to customers, 22 columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import rules
from govspark.operators.joins import lookup_join
from govspark.sources.synthetic import customer_id, payment_rules, profile_rules

GOLD = tuple(rules.GOLD_COLUMNS)

# Which look-up table of the star schema a Gold column comes from. Columns not listed are
# computed from the line item itself and need no join.
FROM_ORDERS = ("customer_id", "order_date", "order_status")
FROM_PART = ("product_sku", "product_name", "category")
FROM_CUSTOMERS = (
    "first_name", "last_name", "email", "phone_number", "national_id", "date_of_birth",
    "shipping_address", "billing_address",
)


def build_gold(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """``orders`` LEFT JOIN ``customers`` on ``customer_id``; orders without a customer stay."""
    joined = lookup_join(orders, customers, "customer_id")
    return joined.select(*[c for c in GOLD if c in joined.columns])


def gold_from_star(table: Callable[[str], DataFrame], columns: Iterable[str] = GOLD) -> DataFrame:
    """Gold over a star schema of ``lineitem``, ``orders``, ``part`` and ``customer``.

    One row per line item. Every look-up table is unique on its key and every join is a left
    join, so a join whose columns nobody asked for cannot change the rows. Those are left out
    here, because the optimizer does not know the keys are unique.

    Orders meet customers before they meet lines, so no line is shuffled for a customer, and what
    an order's key decides is made once per order; only a line without its order makes it itself.
    """
    wanted = set(columns)
    columns = [c for c in GOLD if c in wanted]
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    by_key = {c: rule for c, rule in payment_rules("l_orderkey").items() if c in wanted}
    made = {c: rule for c, rule in {**_LINE_RULES, **_KEY_RULES, **_PART_RULES}.items() if c in wanted}
    made |= {c: c for c in columns if c in FROM_ORDERS or c in FROM_CUSTOMERS}
    if any(c in FROM_ORDERS or c in FROM_CUSTOMERS for c in columns):
        orders = _orders(table, wanted, list(by_key.items()))
        if any(c in FROM_CUSTOMERS for c in columns):
            orders = lookup_join(orders, _customers(table, wanted), "o_custkey")
        lines = lookup_join(lines, orders, "l_orderkey")
        made |= {c: f"coalesce({c}, {rule})" for c, rule in by_key.items()}
    else:
        made |= by_key
    if any(c in FROM_PART for c in columns):
        lines = lookup_join(lines, table("part").selectExpr("p_partkey AS l_partkey", "p_name", "p_type"), "l_partkey")
    return lines.selectExpr(*[f"{made[c]} AS {c}" for c in columns])


_TOTAL = "CAST(l_extendedprice AS DECIMAL(12,2))"
_LINE_RULES = {
    "transaction_id": "concat('TXN-', l_orderkey * 10L + l_linenumber + 200000L)",
    "quantity": "CAST(l_quantity AS INT)",
    "price_per_unit": f"CAST({_TOTAL} / CAST(l_quantity AS DECIMAL(12,2)) AS DECIMAL(12,2))",
    "total_amount": _TOTAL,
}
_KEY_RULES = {"order_id": "concat('ORD-', l_orderkey + 100000L)"}
_ORDER_RULES = {"customer_id": customer_id("o_custkey"), "order_date": "o_orderdate", "order_status": "o_orderstatus"}
_PART_RULES = {
    "product_sku": "concat(upper(left(p_type, 3)), '-', l_partkey)", "product_name": "p_name", "category": "p_type",
}


def _orders(table: Callable[[str], DataFrame], wanted: set[str], more: list[tuple[str, str]] = ()) -> DataFrame:
    rules_ = [(c, r) for c, r in _ORDER_RULES.items() if c in wanted] + list(more)
    keyed = table("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return keyed.selectExpr("l_orderkey", "o_custkey", *[f"{r} AS {c}" for c, r in rules_])


def _customers(table: Callable[[str], DataFrame], wanted: set[str]) -> DataFrame:
    made = profile_rules("o_custkey")
    keys = table("customer").selectExpr("c_custkey AS o_custkey")
    return keys.selectExpr("o_custkey", *[f"{made[c]} AS {c}" for c in FROM_CUSTOMERS if c in wanted])


@dataclass(frozen=True)
class GoldStar:
    """The columns of Gold by the key that decides them, each piece with one row per key.

    ``lines`` has a row per line item; ``keys`` (l_orderkey) what follows from the order's number,
    with the number of its ``lines``; ``orders`` (l_orderkey), ``customers`` (o_custkey) and ``part``
    (l_partkey) what the look-up tables say. What is expensive per value is done on a piece, and
    joined or weighted by lines afterwards.
    """

    lines: DataFrame
    keys: DataFrame
    orders: DataFrame
    customers: DataFrame
    part: DataFrame

    def map(self, f: Callable[[DataFrame], DataFrame]) -> GoldStar:
        return GoldStar(**{name: f(piece) for name, piece in self.pieces().items()})

    def pieces(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def by_order(self) -> DataFrame:
        """One row per order number: keys, orders and customers. Lines of all numbers count, null too."""
        found = lookup_join(self.orders, self.customers, "o_custkey").drop("o_custkey")
        return lookup_join(self.keys, found, "l_orderkey")

    def joined(self) -> DataFrame:
        """Gold rows of all pieces, without the keys.

        Keys, orders and lines meet on one partitioning by the order's number. Customers, whose
        columns are the widest and the same for many lines, come last and are shuffled once each.
        A part piece without columns only matters if a key is in it twice, which is looked up.
        """
        lines = self.lines
        if self.part.columns != ["l_partkey"] or not self.part.groupBy("l_partkey").count().filter("count > 1").isEmpty():
            lines = lookup_join(lines, self.part, "l_partkey")
        keys = self.keys.drop("lines").withColumnRenamed("l_orderkey", "_key")
        # Null safe as below, so that Spark partitions alike; a null number has no order.
        orders = self.orders.withColumnRenamed("l_orderkey", "_order").filter("_order IS NOT NULL")
        orders = keys.join(orders, F.col("_key").eqNullSafe(F.col("_order")), "left")
        lines = lines.join(orders, F.col("l_orderkey").eqNullSafe(F.col("_key")), "left")
        return lookup_join(lines, self.customers, "o_custkey").drop("l_orderkey", "l_partkey", "_key", "_order", "o_custkey")

    def weighted(self) -> dict[str, DataFrame]:
        """Each piece with ``lines``: how many Gold rows carry a row of it. Rows that none carries are left out."""
        orders = self.orders.join(self.keys.select("l_orderkey", "lines"), "l_orderkey")
        buyers = orders.groupBy("o_custkey").agg(F.sum("lines").alias("lines"))
        parts = self.lines.groupBy("l_partkey").agg(F.count("*").alias("lines"))
        return {
            "lines": self.lines.withColumn("lines", F.lit(1).cast("long")),
            "keys": self.keys,
            "orders": orders,
            "customers": self.customers.join(buyers, "o_custkey"),
            "part": self.part.join(parts, "l_partkey"),
        }


def gold_star(table: Callable[[str], DataFrame], columns: Iterable[str] = GOLD) -> GoldStar:
    """The pieces that ``gold_from_star`` would join, with the columns asked for."""
    wanted = set(columns)

    def named(rules_: dict[str, str]) -> list[str]:
        return [f"{rule} AS {c}" for c, rule in rules_.items() if c in wanted]

    lines = table("lineitem")
    keys = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    part = table("part").selectExpr("p_partkey AS l_partkey", "p_name", "p_type")
    return GoldStar(
        lines=lines.selectExpr("l_orderkey", "l_partkey", *named(_LINE_RULES)),
        keys=keys.selectExpr("l_orderkey", "lines", *named({**_KEY_RULES, **payment_rules("l_orderkey")})),
        orders=_orders(table, wanted),
        customers=_customers(table, wanted),
        part=part.selectExpr("l_partkey", *named(_PART_RULES)),
    )


def first_lines(table: Callable[[str], DataFrame], rows: int) -> Callable[[str], DataFrame]:
    """The star schema with only the lines of the lowest order ids that hold the first ``rows`` lines.

    A top-k over Gold that orders by ``order_id`` first needs no other lines, so it can join late.
    At most ``rows`` order keys are broadcast.
    """
    lines = table("lineitem")
    lowest = lines.selectExpr("l_orderkey", f"{_KEY_RULES['order_id']} AS order_id").orderBy("order_id").limit(rows)
    lowest = lowest.select(F.col("l_orderkey").alias("_key")).distinct()
    kept = lines.join(F.broadcast(lowest), F.col("l_orderkey").eqNullSafe(F.col("_key")), "left_semi")
    return lambda name: kept if name == "lineitem" else table(name)


def bucket_star(table: Callable[[str], DataFrame], prefix: str, buckets: int) -> Callable[[str], DataFrame]:
    """Stores ``lineitem`` and ``orders`` as tables bucketed and sorted by the order key.

    Gold built over the result joins the two without a shuffle of the lines.
    """
    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    for name, key in keys.items():
        stored = table(name).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        stored.mode("errorifexists").saveAsTable(f"{prefix}_{name}")
    spark = table("lineitem").sparkSession
    return lambda name: spark.table(f"{prefix}_{name}") if name in keys else table(name)
