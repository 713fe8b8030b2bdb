"""Registration of named queries, table access and shared SQL text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark import rules
from govspark.sources import gold as gold_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(self.path(name))
        return self._opened[name]

    def gold(self, columns: Iterable[str] = gold_source.GOLD) -> DataFrame:
        return gold_source.gold_from_star(self, columns)

    def star(self, columns: Iterable[str] = gold_source.GOLD) -> gold_source.GoldStar:
        return gold_source.gold_star(self, columns)


def query(name: str, sql: str | None = None):
    """Register a query over ``Tables`` under a name, with its SQL equivalent."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text, arrays of text joined by commas."""

    def convert(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(c, ",").alias(field.name)
        return c

    return df.select(*[convert(f) for f in df.schema.fields])


def prompt_log(t: Tables) -> DataFrame:
    """Every logged turn, carrying one of the library's prompts in front of its own text."""
    presets = rules.PROMPT_LIBRARY
    number = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(presets))).cast("int") + 1

    def nth(field: int):
        return F.element_at(F.array(*[F.lit(p[field]) for p in presets]), F.col("preset_no"))

    return (
        t("conversations")
        .withColumn("preset_no", number)
        .select(
            "conv_id", "turn", "role", nth(0).alias("preset_id"), nth(3).alias("category"),
            F.concat(nth(4), F.lit(" "), F.col("text")).alias("text"),
        )
    )


# ---------------------------------------------------------------- SQL text

def sql_list(values: Iterable[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_mix(key: str, stream: int) -> str:
    x = f"((({key}) % 4294967296) * 1103515245 + {(stream * 2654435761) % 2147483648}) % 2147483648"
    return f"(((xor({x}, ({x}) >> 15) * 1103515245 + 12345) % 2147483648) >> 5)"


def sql_between(key: str, stream: int, low: int, high: int) -> str:
    return f"({sql_mix(key, stream)} % {high - low + 1} + {low})"


def sql_pick(key: str, stream: int, values: tuple[str, ...]) -> str:
    return f"{sql_list(values)}[{sql_mix(key, stream)} % {len(values)} + 1]"


def sql_profile(key: str) -> dict[str, str]:
    address = (
        f"{sql_between(key, 11, 100, 9999)} || ' ' || {sql_pick(key, 12, rules.STREETS)} || ', ' || "
        f"{sql_pick(key, 13, rules.CITIES)} || ', ' || {sql_pick(key, 14, rules.STATES)} || ' ' || "
        f"{sql_between(key, 15, 10000, 99999)}"
    )
    first, last = sql_pick(key, 1, rules.FIRST_NAMES), sql_pick(key, 2, rules.LAST_NAMES)
    return {
        "customer_id": f"'CUST-' || ({key} + 10000)",
        "first_name": first,
        "last_name": last,
        "email": f"lower({first}) || '.' || lower({last}) || {sql_between(key, 3, 10, 99)} || '@' || "
        f"{sql_pick(key, 4, rules.EMAIL_DOMAINS)}",
        "phone_number": f"'+1-' || {sql_between(key, 5, 200, 999)} || '-' || {sql_between(key, 6, 200, 999)}"
        f" || '-' || {sql_between(key, 7, 1000, 9999)}",
        "national_id": f"{sql_between(key, 8, 100, 899)} || '-' || {sql_between(key, 9, 10, 99)} || '-' || "
        f"{sql_between(key, 10, 1000, 9999)}",
        "date_of_birth": f"{sql_between(key, 16, 1955, 2005)} || '-' || "
        f"lpad(CAST({sql_between(key, 17, 1, 12)} AS VARCHAR), 2, '0') || '-' || "
        f"lpad(CAST({sql_between(key, 18, 1, 28)} AS VARCHAR), 2, '0')",
        "shipping_address": address,
        "billing_address": address,
    }


def sql_payment(key: str) -> dict[str, str]:
    return {
        "payment_method": sql_pick(key, 21, rules.PAYMENT_METHODS),
        "credit_card_number": f"{sql_between(key, 22, 4000, 4999)} || '-' || {sql_between(key, 23, 1000, 9999)}"
        f" || '-' || {sql_between(key, 24, 1000, 9999)} || '-' || {sql_between(key, 25, 1000, 9999)}",
        "device_ip_address": f"{sql_between(key, 26, 24, 220)} || '.' || {sql_between(key, 27, 10, 254)}"
        f" || '.' || {sql_between(key, 28, 0, 254)} || '.' || {sql_between(key, 29, 1, 254)}",
    }


def _sql_gold() -> str:
    cents = "CAST(round(l_extendedprice * 100) AS BIGINT)"
    quantity = "CAST(l_quantity AS BIGINT)"
    columns = {
        "order_id": "'ORD-' || (l_orderkey + 100000)",
        "transaction_id": "'TXN-' || (200000 + l_orderkey * 10 + l_linenumber)",
        "customer_id": "'CUST-' || (10000 + o_custkey)",
        "order_date": "o_orderdate",
        "product_sku": "upper(left(p_type, 3)) || '-' || p_partkey",
        "product_name": "p_name",
        "category": "p_type",
        "quantity": "CAST(l_quantity AS INTEGER)",
        "price_per_unit": f"CAST((({cents} * 2 + {quantity}) // (2 * {quantity})) / 100.0 AS DECIMAL(12,2))",
        "total_amount": "CAST(l_extendedprice AS DECIMAL(12,2))",
        **sql_payment("l_orderkey"),
        **{k: v for k, v in sql_profile("c_custkey").items() if k != "customer_id"},
        "order_status": "o_orderstatus",
    }
    body = ",\n    ".join(f"{columns[c]} AS {c}" for c in gold_source.GOLD)
    return (
        f"gold AS (\n  SELECT {body}\n  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey\n"
        "  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey)"
    )


SQL_GOLD = _sql_gold()

SQL_PLAIN = {
    "order_date": "strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date",
    "price_per_unit": "CAST(price_per_unit AS DOUBLE) AS price_per_unit",
    "total_amount": "CAST(total_amount AS DOUBLE) AS total_amount",
}


def sql_plain(columns: Iterable[str]) -> str:
    return ", ".join(SQL_PLAIN.get(c, c) for c in columns)


SQL_PROMPT_LOG = f"""prompt_log AS (
  SELECT conv_id, turn, role,
    {sql_list(p[0] for p in rules.PROMPT_LIBRARY)}[(conv_id * 7 + turn) % 10 + 1] AS preset_id,
    {sql_list(p[3] for p in rules.PROMPT_LIBRARY)}[(conv_id * 7 + turn) % 10 + 1] AS category,
    {sql_list(p[4] for p in rules.PROMPT_LIBRARY)}[(conv_id * 7 + turn) % 10 + 1] || ' ' || text AS text
  FROM conversations)"""

# The patterns of govspark/rules.py as the SQL engine's regex dialect writes them.
RE_PHONE_INTL = r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{2,4}[-.\s]?\d{3,4}"
RE_PHONE_US = r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}"
RE_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
RE_NATIONAL_ID = r"\d{1}-\d{4}-\d{5}-\d{2}-\d{1}"
RE_COMPANY_CODE = r"(?i)[A-Z0-9]{2,}-INTERNAL-[A-Z0-9]{2,}-CONFIDENTIAL"
RE_CARD = r"\b(?:\d[ -]?){12,18}\d\b"
RE_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
RE_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
RE_PHONE = f"(?:{RE_PHONE_INTL})|(?:{RE_PHONE_US})"

SQL_REFERENCE = {
    "phone": RE_PHONE,
    "email": RE_EMAIL,
    "national_id": RE_NATIONAL_ID,
    "company_code": RE_COMPANY_CODE,
}
SQL_EXTENDED = {
    "email": RE_EMAIL,
    "card": RE_CARD,
    "national_id": RE_NATIONAL_ID,
    "ssn": RE_SSN,
    "phone": RE_PHONE,
    "ip": RE_IP,
    "company_code": RE_COMPANY_CODE,
}


def sql_types(text: str, detectors: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{n}' END" for n, p in detectors.items())
    return f"concat_ws(',', {cases})"


def sql_redact(text: str) -> str:
    for name, pattern in SQL_EXTENDED.items():
        text = f"regexp_replace({text}, '{pattern}', '[{name.upper()}]', 'g')"
    return text


def sql_findings(source: str, keys: str, text: str) -> str:
    """Findings of a table as UNION ALL of one branch per detector."""
    return " UNION ALL ".join(
        f"SELECT {keys}, '{n}' AS category, unnest(regexp_extract_all({text}, '{p}')) AS value FROM {source}"
        for n, p in SQL_EXTENDED.items()
    )


def sql_finding_count(text: str) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in SQL_EXTENDED.values())


SQL_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SQL_TRIMMED = f"regexp_replace(text, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_strip_script(text: str) -> str:
    pattern = r"<\s*script[^>]*>.*?<\s*/\s*script\s*>|<\s*script[^>]*/\s*>"
    return f"regexp_replace({text}, '{pattern}', '', 'gis')"


def sql_strip_shell(text: str) -> str:
    return f"translate({text}, ';|&$`', '')"


def sql_strip_keywords(text: str) -> str:
    words = "SELECT|INSERT|UPDATE|DELETE|DROP|UNION|ALTER|CREATE|EXEC|EXECUTE|TRUNCATE|MERGE"
    return f"regexp_replace({text}, '\\b({words})\\b', '', 'gi')"


def sql_sanitize(text: str) -> str:
    return sql_strip_keywords(sql_strip_shell(sql_strip_script(text)))


def sql_first(text: str, words: Iterable[str]) -> str:
    cases = " ".join(f"WHEN contains(lower({text}), '{w.lower()}') THEN '{w}'" for w in words)
    return f"CASE {cases} END"


def sql_prepared(source: str) -> str:
    """CTEs ``checked`` and ``guarded``: validation, sanitising and keyword matches of a log."""
    jailbreak = sql_first("engine_text", rules.REFERENCE_GUARD.jailbreak)
    pii = sql_first("engine_text", rules.REFERENCE_GUARD.pii)
    return f"""trimmed AS (SELECT *, {SQL_TRIMMED} AS tt FROM {source}),
checked AS (
  SELECT * EXCLUDE (tt),
    tt <> '' AND length(tt) <= 500 AS is_valid,
    CASE WHEN tt = '' THEN 'Prompt cannot be empty or whitespace-only.'
         WHEN length(tt) > 500 THEN 'Prompt exceeds maximum length of 500 characters (got ' || length(tt) || ' after trimming).'
    END AS error_message,
    CASE WHEN tt <> '' AND length(tt) <= 500 THEN tt ELSE '' END AS sanitized_text
  FROM trimmed),
cleaned AS (
  SELECT *, CASE WHEN is_valid THEN {sql_sanitize('sanitized_text')} END AS engine_text,
    CASE WHEN is_valid THEN 'valid' ELSE 'quarantine' END AS route
  FROM checked),
matched AS (
  SELECT *, {jailbreak} AS jailbreak_keyword, {pii} AS pii_keyword FROM cleaned),
guarded AS (
  SELECT *, CASE WHEN jailbreak_keyword IS NOT NULL THEN 'BLOCKED' ELSE 'PASS' END AS input_action,
    'PASS' AS output_action,
    CASE WHEN jailbreak_keyword IS NOT NULL OR pii_keyword IS NOT NULL THEN 'BLOCKED' ELSE 'PASS' END AS verdict,
    CASE WHEN jailbreak_keyword IS NOT NULL THEN 'jailbreak' WHEN pii_keyword IS NOT NULL THEN 'pii' END AS block_kind,
    CASE WHEN jailbreak_keyword IS NOT NULL THEN 'Detected keyword: ''' || jailbreak_keyword || ''''
         WHEN pii_keyword IS NOT NULL THEN 'Detected PII keyword: ''' || pii_keyword || '''' END AS block_reason
  FROM matched)"""
