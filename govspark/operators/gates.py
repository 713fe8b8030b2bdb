"""An ordered chain of gates over prompts, its outcome per row and its funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.operators.findings import scan_status
from govspark.schemas import GATE_RESULT


class Gate:
    """One check. Subclass it and give ``result``; override ``prepare`` to add columns first."""

    def __init__(self, name: str) -> None:
        self.name = name

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    def result(self) -> Column:
        """A struct of passed, blocked, error and details; see ``gate_result``."""
        raise NotImplementedError


def gate_result(
    passed: Column, blocked: Column, error: Column | None = None, **details: Column
) -> Column:
    entries = [part for k, v in details.items() for part in (F.lit(k), v.cast("string"))]
    return F.struct(
        passed.alias("passed"),
        blocked.alias("blocked"),
        (F.lit(None).cast("string") if error is None else error).alias("error"),
        (F.create_map(*entries) if entries else F.create_map()).cast("map<string,string>").alias("details"),
    )


class ScanGate(Gate):
    """Shows the scan result of the source data. Never blocks."""

    def __init__(self, findings_count: str = "findings_count", name: str = "Gate 1: PII scan") -> None:
        super().__init__(name)
        self.findings_count = findings_count

    def result(self) -> Column:
        count = F.col(self.findings_count)
        return gate_result(
            F.lit(True), F.lit(False), findings_count=count, scan_status=scan_status(count)
        )


class ColumnAccessGate(Gate):
    """Fails closed: without a resolved role the row is blocked and carries an error."""

    def __init__(self, visible_columns: str = "visible_columns", name: str = "Gate 2: column access") -> None:
        super().__init__(name)
        self.visible_columns = visible_columns

    def result(self) -> Column:
        visible = F.col(self.visible_columns)
        error = F.when(visible.isNull(), F.lit("column access check failed: role has no policy"))
        return gate_result(visible.isNotNull(), visible.isNull(), error, visible_columns=visible)


class PromptGuardGate(Gate):
    """Blocks on a jailbreak keyword."""

    def __init__(self, keyword: str = "jailbreak_keyword", name: str = "Gate 3: prompt guard") -> None:
        super().__init__(name)
        self.keyword = keyword

    def result(self) -> Column:
        keyword = F.col(self.keyword)
        blocked = keyword.isNotNull()
        action = F.when(blocked, F.lit("BLOCKED")).otherwise(F.lit("PASS"))
        return gate_result(~blocked, blocked, input_action=action, output_action=F.lit("PASS"))


def run_gates(df: DataFrame, gates: list[Gate], enters: Column | None = None) -> DataFrame:
    """Run the gates in order, per row, up to and including the first block or error.

    Adds ``gate_results`` (results of the gates that ran), ``stopped_at`` (1-based, null when
    all passed) and ``executed``. A gate behind the stop is inside an untaken CASE branch and
    is not evaluated for that row. Rows for which ``enters`` does not hold reach no gate and
    have ``stopped_at`` 0.
    """
    base = df.columns
    start = F.lit(None).cast("int") if enters is None else F.when(~F.coalesce(enters, F.lit(False)), F.lit(0))
    df = df.withColumn("stopped_at", start)
    slots = []
    for i, gate in enumerate(gates, start=1):
        df = gate.prepare(df)
        slot = f"_gate_{i}"
        slots.append(slot)
        df = df.withColumn(slot, F.when(F.col("stopped_at").isNull(), gate.result()))
        stops = F.col(f"{slot}.blocked") | F.col(f"{slot}.error").isNotNull()
        df = df.withColumn("stopped_at", F.when(stops, F.lit(i)).otherwise(F.col("stopped_at")))
    named = [
        F.struct(
            F.lit(g.name).alias("gate"), F.col(f"{s}.passed"), F.col(f"{s}.blocked"),
            F.col(f"{s}.error"), F.col(f"{s}.details"),
        )
        for g, s in zip(gates, slots, strict=True)
    ]
    executed = F.coalesce("stopped_at", F.lit(len(gates)))
    results = (
        F.slice(F.array(*named), F.lit(1), executed)
        if gates
        else F.array().cast(f"array<{GATE_RESULT.simpleString()}>")
    )
    return df.select(*base, results.alias("gate_results"), "stopped_at", executed.alias("executed"))


def row_outcome(df: DataFrame) -> DataFrame:
    """Add ``error`` and ``is_blocked``. An error wins over a block of the same gate."""
    last = F.get("gate_results", F.col("stopped_at") - 1)
    stopped = F.col("stopped_at") > 0
    error = F.when(
        stopped & last["error"].isNotNull(),
        F.concat(F.lit("Gate failed: "), last["gate"], F.lit(" — "), last["error"]),
    )
    return df.withColumn("error", error).withColumn(
        "is_blocked", F.coalesce(stopped & F.col("error").isNull() & last["blocked"], F.lit(False))
    )


def funnel(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """Rows that entered, were blocked, failed or passed at each gate: one aggregate, one scan."""
    counted = []
    for i in range(1, len(gates) + 1):
        here = F.col("stopped_at") == i
        counted += [
            F.count_if(F.col("executed") >= i).alias(f"entered_{i}"),
            F.count_if(here & F.col("error").isNull()).alias(f"blocked_{i}"),
            F.count_if(here & F.col("error").isNotNull()).alias(f"errored_{i}"),
        ]
    rows = [
        F.struct(
            F.lit(i).alias("gate_no"),
            F.lit(g.name).alias("gate"),
            F.col(f"entered_{i}").alias("entered"),
            F.col(f"blocked_{i}").alias("blocked"),
            F.col(f"errored_{i}").alias("errored"),
            (F.col(f"entered_{i}") - F.col(f"blocked_{i}") - F.col(f"errored_{i}")).alias("passed"),
        )
        for i, g in enumerate(gates, start=1)
    ]
    return df.agg(*counted).select(F.inline(F.array(*rows)))
