"""Column access: policy, role views, access report and audit."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark import rules
from govspark.sources.files import fixed_rows

PERMISSIVE, RESTRICTED = "permissive", "restricted"


class AccessDenied(Exception):
    """The access check could not be completed, so nothing may be read."""


@dataclass(frozen=True)
class ColumnPolicy:
    """Columns the restricted role may and may not read."""

    allowed: tuple[str, ...] = rules.ALLOWED_COLUMNS
    denied: tuple[str, ...] = rules.DENIED_COLUMNS

    def access_of(self, column: str) -> str:
        """ALLOWED, DENIED, or UNCLASSIFIED for a column in neither list. A denial wins."""
        if column in self.denied:
            return "DENIED"
        return "ALLOWED" if column in self.allowed else "UNCLASSIFIED"

    def frame(self, spark: SparkSession) -> DataFrame:
        """The policy as rows; its size is the number of listed columns."""
        rows = [(c, "ALLOWED", i) for i, c in enumerate(self.allowed)]
        rows += [(c, "DENIED", len(rows) + i) for i, c in enumerate(self.denied)]
        return fixed_rows(spark, rows, "column_name string, access string, position int")


def role_columns(columns: Iterable[str], role: str | None, policy: ColumnPolicy | None) -> list[str]:
    """Columns a role may read. An unknown role or a missing policy denies everything."""
    if role == PERMISSIVE:
        return list(columns)
    if role != RESTRICTED or policy is None:
        raise AccessDenied(f"column access check failed: no policy for role {role!r}")
    return [c for c in columns if policy.access_of(c) == "ALLOWED"]


def role_view(df: DataFrame, role: str | None, policy: ColumnPolicy | None = ColumnPolicy()) -> DataFrame:
    """The table as a role sees it. The check runs before any data is read.

    Denied columns are not part of the plan, so the scan does not read them.
    """
    return df.select(*role_columns(df.columns, role, policy))


def register_role_views(df: DataFrame, name: str, policy: ColumnPolicy = ColumnPolicy()) -> None:
    """Temporary views ``<name>_permissive`` and ``<name>_restricted``."""
    for role in (PERMISSIVE, RESTRICTED):
        role_view(df, role, policy).createOrReplaceTempView(f"{name}_{role}")


def raw_sample(df: DataFrame, role: str, order_by: list[str], rows: int = rules.RAW_SAMPLE_ROWS) -> DataFrame:
    """The first rows of a role's view. Planned as a top-k per task, not as a full sort."""
    return role_view(df, role).orderBy(*order_by).limit(rows)


def column_exposure(df: DataFrame) -> DataFrame:
    """(column_name, column_position, n_values): how many values each column holds, one pass."""
    entries = ", ".join(
        f"named_struct('column_name', '{c}', 'column_position', {i}, 'n_values', count(`{c}`))"
        for i, c in enumerate(df.columns)
    )
    return df.agg(F.expr(f"array({entries})").alias("entries")).select(F.inline("entries"))


def access_audit(exposure: DataFrame, policy: ColumnPolicy = ColumnPolicy()) -> DataFrame:
    """Every column of a table with its access; one in no list is UNCLASSIFIED."""
    listed = policy.frame(exposure.sparkSession).select("column_name", "access")
    return exposure.join(listed, "column_name", "left").withColumn(
        "access", F.coalesce("access", F.lit("UNCLASSIFIED"))
    )


def unclassified_columns(exposure: DataFrame, policy: ColumnPolicy = ColumnPolicy()) -> DataFrame:
    """Columns of a table that the policy does not mention."""
    return exposure.join(policy.frame(exposure.sparkSession), "column_name", "left_anti")


def access_line(access: Column, column_name: Column) -> Column:
    mark = F.when(access == "ALLOWED", F.lit("✅ ALLOWED: ")).when(access == "DENIED", F.lit("🚫 DENIED: "))
    return F.concat(F.coalesce(mark, F.lit("❔ UNCLASSIFIED: ")), column_name)


def access_report(exposure: DataFrame, policy: ColumnPolicy = ColumnPolicy()) -> DataFrame:
    """One line per listed column in policy order, then the comparison and summary lines.

    A listed column the table does not have is reported with zero values.
    """
    spark = exposure.sparkSession
    lines = (
        policy.frame(spark)
        .join(exposure, "column_name", "left")
        .select(
            F.col("position").alias("line_no"),
            access_line(F.col("access"), F.col("column_name")).alias("line"),
            F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"),
        )
    )
    last = len(policy.allowed) + len(policy.denied)
    tail = [
        "Permissive_Role (Engine_A): ALL columns accessible",
        "Restricted_Role (Engine_B): PII columns blocked",
        f"Summary: {len(policy.denied)} columns denied and excluded from response context",
    ]
    footer = fixed_rows(
        spark,
        [(last + i, text, 0) for i, text in enumerate(tail)],
        "line_no int, line string, n_values long",
    )
    return lines.unionByName(footer)


def access_summary(audit: DataFrame) -> DataFrame:
    """Columns and values per access class, with a flag for denied columns per table."""
    return audit.agg(
        F.max(F.col("access") == "DENIED").alias("has_denied"),
        *[
            F.count(F.when(F.col("access") == a, 1)).alias(f"n_{a.lower()}")
            for a in ("ALLOWED", "DENIED", "UNCLASSIFIED")
        ],
        F.sum(F.when(F.col("access") == "DENIED", F.col("n_values")).otherwise(0)).alias("denied_values"),
    )


def access_outcome(requests: DataFrame, role: str, policies: DataFrame) -> DataFrame:
    """Fail-closed check over a log of requests: a role without a policy row is blocked.

    ``policies`` holds (role, visible_columns) and is one row per role.
    """
    known = policies.withColumnRenamed("role", role)
    joined = requests.join(known, role, "left")
    unresolved = F.col("visible_columns").isNull()
    return joined.select(
        *requests.columns,
        (~unresolved).alias("passed"),
        unresolved.alias("blocked"),
        F.when(
            unresolved,
            F.concat(
                F.lit("column access check failed: no policy for role '"),
                F.coalesce(F.col(role), F.lit("")),
                F.lit("'"),
            ),
        ).alias("error"),
        F.coalesce("visible_columns", F.lit(0)).alias("visible_columns"),
    )
