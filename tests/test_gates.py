"""The gate chain: order, stops, errors, funnel, custom gates."""

import itertools

import pytest
from pyspark.sql import functions as F

from govspark.operators import gates


class FlagGate(gates.Gate):
    """Blocks or fails by what a column says."""

    def __init__(self, column):
        super().__init__(f"gate {column}")
        self.column = column

    def result(self):
        c = F.col(self.column)
        return gates.gate_result(c == "pass", c.isin("block", "both"), F.when(c.isin("error", "both"), F.lit("broke")))


OUTCOMES = ["pass", "block", "error", "both"]


@pytest.fixture(scope="module")
def ran(spark):
    rows = list(itertools.product(OUTCOMES, repeat=3))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    chain = [FlagGate(c) for c in "abc"]
    return gates.row_outcome(gates.run_gates(df, chain)).cache(), chain


def test_chain_stops_at_first_block_or_error(ran):
    for row in ran[0].collect():
        states = [row["a"], row["b"], row["c"]]
        stop = next((i for i, s in enumerate(states, 1) if s != "pass"), None)
        assert row["stopped_at"] == stop
        assert len(row["gate_results"]) == row["executed"] == (stop or 3)
        assert [g["gate"] for g in row["gate_results"]] == ["gate a", "gate b", "gate c"][: stop or 3]
        last = row["gate_results"][-1]
        if stop:
            assert last["blocked"] == (states[stop - 1] in ("block", "both"))
            assert last["error"] == ("broke" if states[stop - 1] in ("error", "both") else None)


def test_error_wins_over_block(ran):
    for row in ran[0].collect():
        states = [row["a"], row["b"], row["c"]]
        stop = next((i for i, s in enumerate(states) if s != "pass"), None)
        kind = None if stop is None else states[stop]
        assert row["is_blocked"] == (kind == "block")
        want = f"Gate failed: gate {'abc'[stop]} — broke" if kind in ("error", "both") else None
        assert row["error"] == want


def test_funnel_adds_up(ran):
    df, chain = ran
    rows = gates.funnel(df, chain).orderBy("gate_no").collect()
    assert rows[0]["entered"] == 64 and rows[-1]["passed"] == 1
    for here, following in itertools.pairwise(rows):
        assert here["passed"] == following["entered"]
    assert [r["blocked"] for r in rows] == [16, 4, 1] and [r["errored"] for r in rows] == [32, 8, 2]


def test_empty_chain(spark):
    row = gates.run_gates(spark.createDataFrame([(1,)], "x int"), []).first()
    assert row["gate_results"] == [] and row["executed"] == 0 and row["stopped_at"] is None


def test_standard_gates(spark):
    df = spark.createDataFrame(
        [(None, 11, None), (0, 11, "ignore"), (3, None, "ignore"), (3, 22, None)],
        "findings_count long, visible_columns int, jailbreak_keyword string",
    )
    chain = [gates.ScanGate(), gates.ColumnAccessGate(), gates.PromptGuardGate()]
    rows = gates.row_outcome(gates.run_gates(df, chain)).collect()
    assert [r["stopped_at"] for r in rows] == [None, 3, 2, None]
    assert [r["gate_results"][0]["details"]["scan_status"] for r in rows] == ["unavailable", "clean", "detected", "detected"]
    # A gate that fails closed is blocked and carries an error; the error is what is reported.
    assert rows[2]["gate_results"][1]["blocked"] and not rows[2]["is_blocked"]
    assert rows[2]["error"] == "Gate failed: Gate 2: column access — column access check failed: role has no policy"
    assert rows[1]["gate_results"][2]["details"] == {"input_action": "BLOCKED", "output_action": "PASS"}


def test_gate_with_prepare_and_skipped_evaluation(spark):
    class Divide(gates.Gate):
        def prepare(self, df):
            return df.withColumn("doubled", F.col("x") * 2)

        def result(self):
            # Would fail the job if it ran for the stopped row, where x is 0.
            return gates.gate_result(F.lit(True), F.expr("100 div x") > 1000, ratio=F.col("doubled"))

    class NotZero(gates.Gate):
        def result(self):
            return gates.gate_result(F.col("x") != 0, F.col("x") == 0)

    df = spark.createDataFrame([(0,), (5,)], "x int")
    rows = {r["x"]: r for r in gates.run_gates(df, [NotZero("zero"), Divide("divide")]).collect()}
    assert rows[0]["stopped_at"] == 1 and rows[5]["stopped_at"] is None
    assert rows[5]["gate_results"][1]["details"] == {"ratio": "10"}


def test_rows_that_do_not_enter(spark):
    df = spark.createDataFrame([("pass", True), ("block", True), ("block", False), ("pass", None)], "a string, ok boolean")
    ran = gates.row_outcome(gates.run_gates(df, [FlagGate("a")], enters=F.col("ok")))
    got = [(r["stopped_at"], r["executed"], len(r["gate_results"]), r["is_blocked"], r["error"]) for r in ran.collect()]
    assert got == [(None, 1, 1, False, None), (1, 1, 1, True, None), (0, 0, 0, False, None), (0, 0, 0, False, None)]
    row = gates.funnel(ran, [FlagGate("a")]).first()
    assert (row["entered"], row["blocked"], row["errored"], row["passed"]) == (2, 1, 0, 1)
