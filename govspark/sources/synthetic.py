"""Repeatable customer profiles and order ledgers, generated from integer keys.

Column rules are SQL text over the name of a key column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark import rules
from govspark.functions.hashing import between, literal, mix, pick

BASE_DATE = "2026-01-01 00:00:00"
DAYS = 120


def _joined(separator: str, *parts: str) -> str:
    return f"concat_ws('{separator}', {', '.join(parts)})"


def customer_id(key: str) -> str:
    return f"concat('CUST-', {key} + 10000L)"


def profile_rules(key: str) -> dict[str, str]:
    """The nine columns of the customer with this key."""
    street = _joined(" ", between(key, 11, 100, 9999), pick(key, 12, rules.STREETS))
    state = _joined(" ", pick(key, 14, rules.STATES), between(key, 15, 10_000, 99_999))
    address = _joined(", ", street, pick(key, 13, rules.CITIES), state)
    first, last = pick(key, 1, rules.FIRST_NAMES), pick(key, 2, rules.LAST_NAMES)
    return {
        "customer_id": customer_id(key),
        "first_name": first,
        "last_name": last,
        "email": f"concat(lower({first}), '.', lower({last}), {between(key, 3, 10, 99)}, '@', "
        f"{pick(key, 4, rules.EMAIL_DOMAINS)})",
        "phone_number": _joined(
            "-", "'+1'", between(key, 5, 200, 999), between(key, 6, 200, 999), between(key, 7, 1000, 9999)
        ),
        "national_id": _joined(
            "-", between(key, 8, 100, 899), between(key, 9, 10, 99), between(key, 10, 1000, 9999)
        ),
        "date_of_birth": _joined(
            "-",
            between(key, 16, 1955, 2005),
            f"lpad({between(key, 17, 1, 12)}, 2, '0')",
            f"lpad({between(key, 18, 1, 28)}, 2, '0')",
        ),
        "shipping_address": address,
        "billing_address": address,
    }


def customer_profiles(keys: DataFrame, key: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One profile per key, with all nine columns or only those asked for."""
    made = profile_rules(key)
    return keys.selectExpr(*[f"{made[c]} AS {c}" for c in (columns or made)])


def payment_rules(key: str) -> dict[str, str]:
    """Payment and device columns of the order with this key."""
    return {
        "payment_method": pick(key, 21, rules.PAYMENT_METHODS),
        "credit_card_number": _joined(
            "-", between(key, 22, 4000, 4999), *[between(key, s, 1000, 9999) for s in (23, 24, 25)]
        ),
        "device_ip_address": _joined(
            ".", between(key, 26, 24, 220), between(key, 27, 10, 254), between(key, 28, 0, 254),
            between(key, 29, 1, 254),
        ),
    }


def order_ledger(keys: DataFrame, key: str, customer_key: str) -> DataFrame:
    """One generated order per key, pointing at the customer in ``customer_key``."""
    paid = payment_rules(key)
    products = " ".join(
        f"WHEN {literal(name)} THEN {pick(key, 32, items)}" for name, items in rules.PRODUCTS.items()
    )
    seconds = between(key, 33, 0, DAYS * 24 * 3600)
    chosen = keys.selectExpr(
        key,
        customer_key,
        f"{pick(key, 31, tuple(rules.PRODUCTS))} AS category",
        f"CAST({between(key, 34, 1250, 85_000)} / CAST(100 AS DECIMAL(3,0)) AS DECIMAL(12,2)) AS price_per_unit",
        f"CAST({between(key, 35, 1, 4)} AS INT) AS quantity",
    )
    return chosen.selectExpr("*", f"CASE category {products} END AS product_name").selectExpr(
        f"concat('ORD-', {key} + 100000L) AS order_id",
        f"concat('TXN-', {key} + 200000L) AS transaction_id",
        f"{customer_id(customer_key)} AS customer_id",
        f"date_format(TIMESTAMP_NTZ'{BASE_DATE}' + make_dt_interval(0, 0, 0, {seconds}), 'yyyy-MM-dd HH:mm:ss')"
        " AS order_date",
        f"concat_ws('-', upper(left(category, 3)), {between(key, 36, 100, 999)},"
        " replace(upper(left(product_name, 3)), ' ', '')) AS product_sku",
        "product_name",
        "category",
        "quantity",
        "price_per_unit",
        "CAST(price_per_unit * quantity AS DECIMAL(12,2)) AS total_amount",
        *[f"{rule} AS {name}" for name, rule in paid.items()],
        f"{pick(key, 37, rules.ORDER_STATUSES)} AS order_status",
    )


def synthetic_customers(spark: SparkSession, n: int = 250) -> DataFrame:
    return customer_profiles(spark.range(n), "id")


def synthetic_orders(spark: SparkSession, n: int = 2500, customers: int = 250) -> DataFrame:
    """``n`` orders, each of a customer drawn from the first ``customers`` keys."""
    keys = spark.range(n).select("id", F.expr(f"{mix('id', 38)} % {customers}L").alias("customer_key"))
    return order_ledger(keys, "id", "customer_key")
