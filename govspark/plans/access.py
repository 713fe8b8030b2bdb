"""B2 and C: column policy, role views, reports and the fail-closed check."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark import rules
from govspark.operators import access
from govspark.plans.base import SQL_GOLD, Tables, plain, query, sql_list, sql_plain
from govspark.sources.files import fixed_rows
from govspark.sources.gold import GOLD, first_lines, gold_from_star

_ALLOWED, _DENIED = sql_list(rules.ALLOWED_COLUMNS), sql_list(rules.DENIED_COLUMNS)
_VISIBLE = [c for c in GOLD if c in rules.ALLOWED_COLUMNS]

# Every column as one row with its number of values, then the access it has.
_COUNTS = ", ".join(f"count({c}) AS {c}" for c in GOLD)
_EXPOSURE = f"""counts AS (SELECT {_COUNTS} FROM gold),
exposure AS (UNPIVOT counts ON COLUMNS(*) INTO NAME column_name VALUE n_values),
audit AS (SELECT column_name, n_values,
  CASE WHEN list_contains({_DENIED}, column_name) THEN 'DENIED'
       WHEN list_contains({_ALLOWED}, column_name) THEN 'ALLOWED' ELSE 'UNCLASSIFIED' END AS access FROM exposure)"""


@query(
    "b2_policy_schema_join",
    f"WITH {SQL_GOLD}, {_EXPOSURE}\nSELECT column_name, access, n_values, access = 'UNCLASSIFIED' AS unlisted FROM audit",
)
def policy_schema_join(t: Tables):
    exposure = access.column_exposure(t.gold())
    unlisted = access.unclassified_columns(exposure).select("column_name", F.lit(True).alias("unlisted"))
    return (
        access.access_audit(exposure)
        .join(unlisted, "column_name", "left")
        .select("column_name", "access", "n_values", F.coalesce("unlisted", F.lit(False)).alias("unlisted"))
    )


@query("c1_restricted_view", f"WITH {SQL_GOLD}\nSELECT {sql_plain(_VISIBLE)} FROM gold")
def restricted_view(t: Tables):
    visible = access.role_columns(GOLD, access.RESTRICTED, access.ColumnPolicy())
    return plain(access.role_view(t.gold(visible), access.RESTRICTED))


@query("c2_permissive_view", f"WITH {SQL_GOLD}\nSELECT {sql_plain(GOLD)} FROM gold")
def permissive_view(t: Tables):
    return plain(access.role_view(t.gold(), access.PERMISSIVE))


@query(
    "c3_access_report",
    f"""WITH {SQL_GOLD}, {_EXPOSURE},
listed AS (
  SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS line_no, unnest({_ALLOWED}) AS column_name, '✅ ALLOWED: ' AS mark
  UNION ALL SELECT CAST(unnest(range(11, 21)) AS INTEGER), unnest({_DENIED}), '🚫 DENIED: ')
SELECT line_no, mark || column_name AS line, n_values FROM listed JOIN exposure USING (column_name)
UNION ALL SELECT 21, 'Permissive_Role (Engine_A): ALL columns accessible', 0
UNION ALL SELECT 22, 'Restricted_Role (Engine_B): PII columns blocked', 0
UNION ALL SELECT 23, 'Summary: 10 columns denied and excluded from response context', 0""",
)
def access_report(t: Tables):
    return access.access_report(access.column_exposure(t.gold()))


@query(
    "c4_denied_flag",
    f"""WITH {SQL_GOLD}, {_EXPOSURE}
SELECT max(CAST(access = 'DENIED' AS INTEGER)) = 1 AS has_denied, count(*) FILTER (access = 'ALLOWED') AS n_allowed,
  count(*) FILTER (access = 'DENIED') AS n_denied, count(*) FILTER (access = 'UNCLASSIFIED') AS n_unclassified,
  CAST(sum(n_values) FILTER (access = 'DENIED') AS BIGINT) AS denied_values FROM audit""",
)
def denied_flag(t: Tables):
    return access.access_summary(access.access_audit(access.column_exposure(t.gold())))


def role_policies(t: Tables):
    """Columns each logged role may read. The system role has no policy."""
    visible = {
        "user": len(access.role_columns(GOLD, access.RESTRICTED, access.ColumnPolicy())),
        "assistant": len(access.role_columns(GOLD, access.PERMISSIVE, None)),
    }
    return fixed_rows(t.spark, list(visible.items()), "role string, visible_columns int")


SQL_VISIBLE = "CASE role WHEN 'user' THEN 11 WHEN 'assistant' THEN 22 END"


@query(
    "c5_fail_closed",
    f"""SELECT conv_id, turn, role, {SQL_VISIBLE} IS NOT NULL AS passed, {SQL_VISIBLE} IS NULL AS blocked,
  CASE WHEN {SQL_VISIBLE} IS NULL THEN 'column access check failed: no policy for role ''' || coalesce(role, '') || '''' END AS error,
  coalesce({SQL_VISIBLE}, 0) AS visible_columns FROM conversations""",
)
def fail_closed(t: Tables):
    requests = t("conversations").select("conv_id", "turn", "role")
    return access.access_outcome(requests, "role", role_policies(t))


_SAMPLE_ORDER = ["order_id", "product_sku", "quantity", "total_amount"]


@query(
    "c6_raw_sample",
    f"WITH {SQL_GOLD}\nSELECT {sql_plain(_VISIBLE)} FROM (SELECT {', '.join(_VISIBLE)} FROM gold "
    f"ORDER BY {', '.join(_SAMPLE_ORDER)} LIMIT 10)",
)
def raw_sample(t: Tables):
    visible = access.role_columns(GOLD, access.RESTRICTED, access.ColumnPolicy())
    # The order id comes first in the order, so the few lines that can be in it meet the other tables.
    lowest = gold_from_star(first_lines(t, rules.RAW_SAMPLE_ROWS), visible)
    return plain(access.raw_sample(lowest, access.RESTRICTED, _SAMPLE_ORDER))
