"""Guard verdict expressions over sanitised prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from govspark import rules


def input_action(jailbreak: Column) -> Column:
    """Only a jailbreak keyword blocks at the guard; personal-data keywords do not."""
    return F.when(jailbreak.isNotNull(), F.lit("BLOCKED")).otherwise(F.lit("PASS"))


def needs_attention(in_action: Column, out_action: Column) -> Column:
    return (in_action != "PASS") | (out_action != "PASS")


def block_kind(jailbreak: Column, pii: Column) -> Column:
    """Which keyword list blocks the prompt on the governed path: jailbreak goes first."""
    return F.when(jailbreak.isNotNull(), F.lit("jailbreak")).when(pii.isNotNull(), F.lit("pii"))


def block_reason(jailbreak: Column, pii: Column) -> Column:
    return F.when(
        jailbreak.isNotNull(), F.concat(F.lit("Detected keyword: '"), jailbreak, F.lit("'"))
    ).when(pii.isNotNull(), F.concat(F.lit("Detected PII keyword: '"), pii, F.lit("'")))


def output_action(gate_action: Column, response_action: Column) -> Column:
    """The gate's action if it blocks or modifies, else MODIFIED if the response says so."""
    return (
        F.when(gate_action.isin("BLOCKED", "MODIFIED"), gate_action)
        .when(response_action == "MODIFIED", F.lit("MODIFIED"))
        .otherwise(F.lit("PASS"))
    )


def annotations(
    at_guard: Column, blocked_later: Column, out_action: Column, live: bool = False
) -> Column:
    """Labels of a governed result, as an array of strings."""
    blocked = at_guard | blocked_later
    first, second = rules.BLOCKED_AT_GUARD_LABELS
    slots = [
        F.when(at_guard, F.lit(first)),
        F.when(at_guard, F.lit(second)),
        F.when(~at_guard & blocked_later, F.lit(rules.BLOCKED_LATER_LABEL)),
        F.when(~blocked, F.lit(rules.PROTECTED_LABEL)),
        *[F.when(~blocked, F.lit(label)) for label in (rules.LIVE_LABELS if live else ())],
        F.when(~blocked & (out_action == "MODIFIED"), F.lit(rules.SANITIZED_LABEL)),
    ]
    return F.array_remove(F.array(*[F.coalesce(s, F.lit("")) for s in slots]), "")


def leak_label(types: Column) -> Column:
    return F.when(F.size(types) > 0, F.lit(rules.LEAK_LABEL))


def numbers_in(text: Column) -> Column:
    """Distinct numbers written in a text, thousands separators removed; none for no text."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda n: F.translate(n, ",", "")))
