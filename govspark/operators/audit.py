"""Comparison of the ungoverned and the governed path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import rules
from govspark.functions import detect, guard
from govspark.operators.access import PERMISSIVE, RESTRICTED, ColumnPolicy, role_columns
from govspark.operators.joins import lookup_join
from govspark.rules import Detector
from govspark.sources.gold import GoldStar


def serialise_columns(columns: list[str]) -> Column:
    """``name: value`` pairs joined by commas; columns without a value are skipped. No column gives an empty text."""
    if not columns:
        return F.lit("")
    pairs = ", ".join(f"concat('{c}: ', CAST(`{c}` AS STRING))" for c in columns)
    return F.expr(f"concat_ws(', ', {pairs})")


def dual_path(df: DataFrame, response: str = "engine_text") -> DataFrame:
    """Both paths' results as columns of one scan, over guarded prompts.

    The ungoverned path never blocks, has no action and only carries the leak label.
    """
    types = detect.detected_types(F.col(response))
    return df.withColumn("a_types", types).withColumns(
        {
            "a_is_blocked": F.lit(False),
            "a_action": F.lit(None).cast("string"),
            "a_sensitive": F.size("a_types") > 0,
            "a_annotation": guard.leak_label(F.col("a_types")),
            "b_is_blocked": F.col("verdict") == "BLOCKED",
            "b_action": F.col("verdict"),
        }
    )


def result_log(
    guarded: DataFrame,
    keys: list[str],
    response: str,
    filtered: str,
    filter_action: str,
    error: str | None = None,
    live: bool = False,
) -> DataFrame:
    """Two result rows per guarded prompt, one for each path.

    The ungoverned path returns ``response`` as it is. The governed path returns the block
    message for a blocked prompt, nothing where a gate failed (``error``) or the output was
    blocked, and else ``filtered``, the response after the output filter, whose
    ``filter_action`` is PASS, MODIFIED or BLOCKED.
    """
    failed = F.col(error).isNotNull() if error else F.lit(False)
    stopped = F.col("verdict") == "BLOCKED"
    out_action = guard.output_action(F.col("output_action"), F.col(filter_action))
    # A response the filter itself blocked is treated like a blocked output.
    out_blocked = (out_action == "BLOCKED") | (F.col(filter_action) == "BLOCKED")
    blocked = ~failed & (stopped | out_blocked)
    labels = guard.annotations(F.col("input_action") == "BLOCKED", blocked, out_action, live)
    types = detect.detected_types(F.col(response))
    no_labels, no_text = F.array().cast("array<string>"), F.lit(None).cast("string")
    ungoverned = F.struct(
        F.lit("ungoverned").alias("path"),
        F.col(response).alias("response_text"),
        F.lit(False).alias("is_blocked"),
        F.when(F.size(types) > 0, F.array(F.lit(rules.LEAK_LABEL))).otherwise(no_labels).alias("annotations"),
        no_text.alias("guardrail_action"),
        (F.size(types) > 0).alias("sensitive_detected"),
        no_text.alias("error"),
    )
    governed = F.struct(
        F.lit("governed").alias("path"),
        F.when(failed | (~stopped & out_blocked), F.lit(""))
        .when(stopped, F.lit(rules.BLOCKED_REPLY))
        .otherwise(F.col(filtered))
        .alias("response_text"),
        blocked.alias("is_blocked"),
        F.when(failed, no_labels).otherwise(labels).alias("annotations"),
        F.when(~failed, F.when(blocked, F.lit("BLOCKED")).otherwise(out_action)).alias("guardrail_action"),
        F.lit(False).alias("sensitive_detected"),
        (F.col(error) if error else no_text).alias("error"),
    )
    return guarded.select(*keys, F.inline(F.array(ungoverned, governed)))


PATHS = {PERMISSIVE: "ungoverned", RESTRICTED: "governed"}


def leak_masks(
    df: DataFrame,
    keep: list[str],
    policy: ColumnPolicy = ColumnPolicy(),
    detectors: tuple[Detector, ...] = rules.REFERENCE_DETECTORS,
) -> DataFrame:
    """``keep`` and, per path, a mask of the detectors that match the row's serialised form.

    ``keep`` is not part of that form. A row without values has no match.
    """
    columns = [c for c in df.columns if c not in keep]
    texts = df.select(*keep, *[serialise_columns(role_columns(columns, role, policy)).alias(p) for role, p in PATHS.items()])
    bits = {p: " + ".join(f"CAST({detect.match_sql(p, d)} AS BIGINT) * {1 << i}L" for i, d in enumerate(detectors)) for p in PATHS.values()}
    return texts.selectExpr(*keep, *[f"{mask} AS {p}" for p, mask in bits.items()])


def count_leaks(masks: DataFrame, detectors: tuple[Detector, ...] = rules.REFERENCE_DETECTORS) -> DataFrame:
    """(path, n_rows, leaked_rows, <category>_rows...) of masks that ``lines`` rows have each."""
    entries = ", ".join(
        f"named_struct('path', '{p}', 'n_rows', coalesce(sum(lines), 0L), 'leaked_rows', coalesce(sum(if({p} != 0, lines, 0L)), 0L), "
        + ", ".join(f"'{d.name}_rows', coalesce(sum(if({p} & {1 << i}L != 0, lines, 0L)), 0L)" for i, d in enumerate(detectors))
        + ")"
        for p in PATHS.values()
    )
    return masks.agg(F.expr(f"array({entries})").alias("entries")).select(F.inline("entries"))


def leak_audit(
    gold: DataFrame,
    policy: ColumnPolicy = ColumnPolicy(),
    detectors: tuple[Detector, ...] = rules.REFERENCE_DETECTORS,
) -> DataFrame:
    """Leaked rows per path and category: (path, n_rows, leaked_rows, <category>_rows...).

    Both serialised forms come from the same row, so the table is read once, and one global
    partial aggregate replaces any grouping on the path.
    """
    one = gold.withColumn("lines", F.lit(1).cast("long"))
    return count_leaks(leak_masks(one, ["lines"], policy, detectors), detectors)


def leak_audit_of_star(
    star: GoldStar,
    policy: ColumnPolicy = ColumnPolicy(),
    detectors: tuple[Detector, ...] = rules.REFERENCE_DETECTORS,
) -> DataFrame:
    """``leak_audit`` of the pieces of Gold: patterns see each order, customer and part once.

    Only masks are joined and OR-ed. They equal those of whole rows for detectors that cannot match
    across ``, name: ``, the separator of two columns; the others need ``leak_audit``.
    """

    def masks(piece: DataFrame, *keep: str) -> DataFrame:
        return leak_masks(piece, list(keep), policy, detectors)

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumnsRenamed({p: f"{prefix}_{p}" for p in PATHS.values()})

    def either(df: DataFrame, *prefixes: str) -> dict[str, Column]:
        nothing = F.lit(0).cast("long")
        return {p: reduce(Column.bitwiseOR, [F.coalesce(f"{x}_{p}", nothing) for x in prefixes]) for p in PATHS.values()}

    found = lookup_join(
        named(masks(star.orders, "l_orderkey", "o_custkey"), "o"), named(masks(star.customers, "o_custkey"), "c"), "o_custkey"
    )
    orders = lookup_join(named(masks(star.keys, "l_orderkey", "lines"), "k").drop("lines"), found, "l_orderkey")
    orders = orders.select(F.col("l_orderkey").alias("_key"), *[c.alias(f"k_{p}") for p, c in either(orders, "k", "o", "c").items()])
    lines = lookup_join(named(masks(star.lines, "l_orderkey", "l_partkey"), "l"), named(masks(star.part, "l_partkey"), "p"), "l_partkey")
    # Lines of an order with equal masks are one row from here on.
    own = either(lines, "l", "p")
    lines = lines.select("l_orderkey", *[c.alias(f"l_{p}") for p, c in own.items()])
    lines = lines.groupBy("l_orderkey", *[f"l_{p}" for p in PATHS.values()]).agg(F.count("*").alias("lines"))
    met = lines.join(orders, F.col("l_orderkey").eqNullSafe(F.col("_key")), "left")
    return count_leaks(met.select("lines", *[c.alias(p) for p, c in either(met, "l", "k").items()]), detectors)


def detection_rate(guarded: DataFrame, category: str = "category") -> DataFrame:
    """Share of prompts each category of the library got blocked, and by which list."""
    return (
        guarded.groupBy(category)
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count_if(F.col("route") == "quarantine").alias("quarantined"),
            F.count_if(F.col("block_kind") == "jailbreak").alias("blocked_jailbreak"),
            F.count_if(F.col("block_kind") == "pii").alias("blocked_pii"),
        )
        .withColumn(
            "detection_rate",
            (F.col("blocked_jailbreak") + F.col("blocked_pii")).cast("double") / F.col("attempts"),
        )
    )


def grounding(log: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Share of a text's numbers that an earlier text of the same group already gave.

    ``order`` is unique within a group; context that comes with a question goes into the log
    before it. Adds ``numbers``, ``supported`` and ``grounded_share`` (null without numbers).

    A number is unsupported only where it occurs first. So it is enough to find the first
    place of each (group, number) and to count the firsts per place. Both steps combine map
    side, and the join has one row per place on both sides, however long a group is.
    """
    numbers = guard.numbers_in(F.col(text))
    firsts = (
        log.select(*keys, order, F.explode(numbers).alias("number"))
        .groupBy(*keys, "number")
        .agg(F.min(order).alias(order))
        .groupBy(*keys, order)
        .agg(F.count(F.lit(1)).alias("introduced"))
    )
    counted = log.select(*keys, order, F.size(numbers).cast("long").alias("numbers"))
    # A null group is a group: nulls meet nulls.
    at = [*keys, order]
    firsts = firsts.select(*[F.col(k).alias(f"_{k}") for k in at], "introduced")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in at]
    joined = counted.join(firsts, same, "left").withColumn(
        "supported", F.col("numbers") - F.coalesce("introduced", F.lit(0))
    )
    share = F.when(F.col("numbers") > 0, F.col("supported").cast("double") / F.col("numbers"))
    return joined.select(*keys, order, "numbers", "supported", share.alias("grounded_share"))
