"""D and E: detection, findings, redaction, tokens, masks and promotion."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from govspark import rules
from govspark.operators import findings, medallion
from govspark.plans.base import (
    SQL_EXTENDED, SQL_GOLD, SQL_REFERENCE, Tables, plain, query, sql_finding_count, sql_findings, sql_profile,
    sql_redact, sql_types,
)
from govspark.session import scratch_dir
from govspark.sources import synthetic
from govspark.sources.gold import GOLD

_TYPES = sql_types("text", SQL_REFERENCE)
_EXTENDED_TYPES = sql_types("text", SQL_EXTENDED)
_PROFILES = "profiles AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in sql_profile("c_custkey").items()) + " FROM customer)"
_PROFILE_TEXT = "profile_text AS (SELECT customer_id, concat_ws(', ', email, phone_number, national_id, shipping_address) AS text FROM profiles)"


def _profile_text(t: Tables):
    profiles = synthetic.customer_profiles(t("customer").select("c_custkey"), "c_custkey")
    return profiles.select(
        "customer_id",
        F.concat_ws(", ", "email", "phone_number", "national_id", "shipping_address").alias("text"),
    )


@query("d1_detect_types", f"SELECT doc_id, {_TYPES} AS types FROM documents")
def detect_types(t: Tables):
    return plain(findings.with_detected_types(t("documents"), "text").select("doc_id", "types"))


@query("d1_detect_types_extended", f"WITH {_PROFILES}, {_PROFILE_TEXT}\nSELECT customer_id, {_EXTENDED_TYPES} AS types FROM profile_text")
def detect_types_extended(t: Tables):
    typed = findings.with_detected_types(_profile_text(t), "text", rules.EXTENDED_DETECTORS)
    return plain(typed.select("customer_id", "types"))


@query(
    "d2_leak_flag",
    f"""SELECT page_id, {sql_types('html', SQL_REFERENCE)} <> '' AS sensitive_detected,
  CASE WHEN {sql_types('html', SQL_REFERENCE)} <> '' THEN '⚠️ Ungoverned — Data Leaked' END AS leak_label FROM pages""",
)
def leak_flag(t: Tables):
    return findings.with_detected_types(t("pages"), "html").select("page_id", "sensitive_detected", "leak_label")


@query("d3_findings", sql_findings("documents", "doc_id", "text"))
def extract_findings(t: Tables):
    return findings.extract_findings(t("documents"), ["doc_id"], "text")


@query(
    "d4_findings_by_category",
    f"""WITH {_PROFILES}, {_PROFILE_TEXT}, found AS (
  {sql_findings('documents', "'documents' AS origin", 'text')}
  UNION ALL {sql_findings('pages', "'pages' AS origin", 'html')}
  UNION ALL {sql_findings('profile_text', "'customers' AS origin", 'text')}),
per_category AS (SELECT category, count(*) AS findings, count(DISTINCT value) AS distinct_values FROM found GROUP BY 1)
SELECT * FROM per_category UNION ALL
SELECT 'TOTAL', CAST(sum(findings) AS BIGINT), CAST(sum(distinct_values) AS BIGINT) FROM per_category""",
)
def findings_by_category(t: Tables):
    found = (
        findings.extract_findings(t("documents"), [], "text")
        .unionByName(findings.extract_findings(t("pages"), [], "html"))
        .unionByName(findings.extract_findings(_profile_text(t), [], "text"))
    )
    return findings.count_findings(found)


_COLUMN_RULES = {
    "EMAIL_ADDRESS": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "PHONE_NUMBER": r"^\+\d{1,3}-\d{3}-\d{3}-\d{4}$",
    "NATIONAL_ID": r"^\d{3}-\d{2}-\d{4}$",
    "CREDIT_CARD_NUMBER": r"^\d{4}-\d{4}-\d{4}-\d{4}$",
    "DATE_OF_BIRTH": r"^\d{4}-\d{2}-\d{2}$",
    "ADDRESS": r"^\d+ [^,]+, [^,]+, [A-Z]{2} \d{5}$",
}
_TEXT_COLUMNS = [c for c in GOLD if c not in ("order_date", "quantity", "price_per_unit", "total_amount")]
_LONG = (
    f"texts AS (SELECT {', '.join(_TEXT_COLUMNS)} FROM gold),\n"
    "long AS (UNPIVOT texts ON COLUMNS(*) INTO NAME column_name VALUE v)"
)
_PROFILE = " UNION ALL ".join(
    f"SELECT column_name, '{name}' AS category, count(*) FILTER (regexp_matches(v, '{p}')) AS rows_matched, count(*) AS n_values "
    f"FROM long GROUP BY 1 HAVING count(*) FILTER (regexp_matches(v, '{p}')) >= 0.5 * count(*)"
    for name, p in _COLUMN_RULES.items()
)


@query("d5_column_profile", f"WITH {SQL_GOLD}, {_LONG}\n{_PROFILE}")
def column_profile(t: Tables):
    return findings.profile_star(t.star())


@query(
    "d5_categories_of_columns",
    f"WITH {SQL_GOLD}, {_LONG}, profile AS ({_PROFILE})\nSELECT category, count(*) AS findings FROM profile GROUP BY 1",
)
def categories_of_columns(t: Tables):
    return findings.findings_by_category(findings.profile_star(t.star()))


_LINES = " || ".join(
    f"CASE WHEN {n}_n > 0 THEN chr(10) || '  • {n}: ' || {n}_n ELSE '' END" for n in SQL_EXTENDED
)
_SUMS = ", ".join(
    f"CAST(sum(coalesce(len(regexp_extract_all(text, '{p}')), 0)) AS BIGINT) AS {n}_n" for n, p in SQL_EXTENDED.items()
)
_TOTAL = " + ".join(f"{n}_n" for n in SQL_EXTENDED)


@query(
    "d6_scan_status",
    f"""WITH grouped AS (SELECT source, lang, {_SUMS} FROM documents GROUP BY 1, 2),
totals AS (SELECT *, {_TOTAL} AS findings_count FROM grouped)
SELECT source, lang, findings_count, CASE WHEN findings_count = 0 THEN 'clean' ELSE 'detected' END AS status,
  findings_count > 0 AS expanded,
  CASE WHEN findings_count = 0 THEN 'PII scan: No PII detected in source data — data is clean'
    ELSE 'PII scan: ' || findings_count || ' PII findings detected in source data' || {_LINES} END AS summary FROM totals""",
)
def scan_status(t: Tables):
    return findings.scan_report(t("documents"), ["source", "lang"], "text")


@query(
    "d7_informational_gate",
    f"""WITH scans AS (SELECT doc_id, CAST(sum({sql_finding_count('text')}) AS BIGINT) AS n FROM documents GROUP BY 1)
SELECT conv_id, turn, n AS findings_count,
  CASE WHEN n IS NULL THEN 'unavailable' WHEN n = 0 THEN 'clean' ELSE 'detected' END AS scan_status,
  TRUE AS passed, FALSE AS blocked
FROM conversations LEFT JOIN scans ON conv_id = doc_id""",
)
def informational_gate(t: Tables):
    """Each conversation reads the scan of the document of its number."""
    return findings.attach_scan(t("conversations").select("conv_id", "turn"), document_scans(t), "conv_id")


def document_scans(t: Tables):
    # Counting first: only ids and counts are shuffled for the join, never the texts. Summed
    # per document, both sides of the join have one row per id.
    counts = findings.count_per_key(t("documents"), ["doc_id"], "text")
    return counts.groupBy(F.col("doc_id").alias("conv_id")).agg(F.sum("findings_count").alias("findings_count"))


@query("e1_redact_text", f"SELECT doc_id, sha256({sql_redact('text')}) AS redacted_hash FROM documents")
def redact_text(t: Tables):
    redacted = medallion.redact_text(t("documents"), "text")
    return redacted.select("doc_id", F.sha2("redacted_text", 256).alias("redacted_hash"))


# The tables are made up, so their tokens need no secret.
TEST_SALT = "govspark"
_TOKENS = ", ".join(f"sha256('govspark' || {c}) AS {c}_token" for c in ("email", "phone_number", "national_id"))


@query("e2_tokenise", f"WITH {_PROFILES}\nSELECT customer_id, {_TOKENS} FROM profiles")
def tokenise(t: Tables):
    profiles = synthetic.customer_profiles(t("customer").select("c_custkey"), "c_custkey")
    tokens = medallion.tokenise_columns(profiles, TEST_SALT, ("email", "phone_number", "national_id"))
    return tokens.select("customer_id", "email_token", "phone_number_token", "national_id_token")


def _hide(c: str) -> str:
    return f"regexp_replace({c}, '[0-9]', '#', 'g')"


def _keep4(c: str) -> str:
    return f"{_hide(f'left({c}, length({c}) - 4)')} || right({c}, 4)"


_MASKS = {
    "email": "left(email, 1) || '***@' || split_part(email, '@', 2)",
    "phone_number": _keep4("phone_number"),
    "national_id": _keep4("national_id"),
    "credit_card_number": _keep4("credit_card_number"),
    "device_ip_address": _hide("device_ip_address"),
    "date_of_birth": "left(date_of_birth, 4) || '-##-##'",
    "shipping_address": _hide("shipping_address"),
    "billing_address": _hide("billing_address"),
    "first_name": "left(first_name, 1) || '***'",
    "last_name": "left(last_name, 1) || '***'",
}
_SENSITIVE = [c for c in GOLD if c in _MASKS]


@query(
    "e3_mask",
    f"WITH {SQL_GOLD}\nSELECT transaction_id, " + ", ".join(f"{_MASKS[c]} AS {c}" for c in _SENSITIVE) + " FROM gold",
)
def mask(t: Tables):
    return medallion.mask_columns(t.gold(["transaction_id", *_SENSITIVE]))


_PROMOTED = ["order_id", "customer_id", "order_date", "total_amount", *_SENSITIVE]


@query(
    "e4_promotion",
    f"""WITH {SQL_GOLD}
SELECT order_id, customer_id, strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date, CAST(total_amount AS DOUBLE) AS total_amount,
  {', '.join(f'{_MASKS[c]} AS {c}' for c in _SENSITIVE)},
  {', '.join(f"sha256('govspark' || {c}) AS {c}_token" for c in medallion.TOKENISED)} FROM gold""",
)
def promotion(t: Tables):
    star = t.star(_PROMOTED)
    star = replace(star, orders=star.orders.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss")))
    out = scratch_dir(t.spark, "promotion")
    return plain(medallion.promote_star(star, f"{out}/silver", f"{out}/gold", TEST_SALT))


@query(
    "e5_residual_check",
    f"""WITH redacted AS (SELECT doc_id, text, {sql_redact('text')} AS red FROM documents)
SELECT doc_id, CASE WHEN red <> text THEN 'MODIFIED' ELSE 'PASS' END AS redact_action,
  {sql_types('red', SQL_EXTENDED)} AS residual_types FROM redacted""",
)
def residual_check(t: Tables):
    checked = medallion.residual_check(t("documents"), "text")
    return plain(checked.select("doc_id", "redact_action", "residual_types"))
