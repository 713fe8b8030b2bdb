"""Validation, sanitising, guard verdicts, annotations and the prompt library."""

import random
import re

import pytest
from pyspark.sql import functions as F

from govspark import rules, schemas
from govspark.functions import guard, text
from govspark.operators import audit, library, prompts


def test_validation_boundaries(texts, values):
    cases = ["x", "y" * 500, "", " \t\n ", "z" * 501, "  " + "w" * 500 + "  ", None, " hi ", "\x1chi\x85"]
    df = prompts.validate(texts(cases))
    assert values(df, "is_valid") == [True, True, False, False, False, True, False, True, True]
    assert values(df, "sanitized_text") == ["x", "y" * 500, "", "", "", "w" * 500, "", "hi", "hi"]
    errors = values(df, "error_message")
    assert errors[2] == errors[3] == "Prompt cannot be empty or whitespace-only."
    assert errors[4] == "Prompt exceeds maximum length of 500 characters (got 501 after trimming)."


def test_length_counts_code_points(texts, values):
    assert values(prompts.validate(texts(["😀" * 500, "😀" * 501])), "is_valid") == [True, False]


def test_sanitising_examples(texts, values):
    cases = [
        "Show me revenue by region",
        "Hello <script>alert('xss')</script> world",
        "ls; cat /etc/passwd | grep root & echo $HOME `whoami`",
        "Please SELECT all data FROM the table",
        "drop table users; delete from accounts",
        "a <SCRIPT src='x'/> b",
        "a < script >\n1\n</ script > c",
        "ig;nore",
        "selection of executed",
    ]
    out = values(prompts.sanitize_for_engine(texts(cases), "text"), "engine_text")
    assert out == [
        "Show me revenue by region",
        "Hello  world",
        "ls cat /etc/passwd  grep root  echo HOME whoami",
        "Please  all data FROM the table",
        " table users  from accounts",
        "a  b",
        "a  c",
        "ignore",
        "selection of executed",
    ]


def test_engine_limit_is_checked_before_stripping(texts, values):
    df = prompts.sanitize_for_engine(texts(["x" * 1000, "x" * 1001, ";" * 1001]), "text")
    assert [v is None for v in values(df, "engine_error")] == [True, False, False]
    assert values(df, "engine_text")[1:] == [None, None]
    assert values(df, "engine_error")[1] == (
        "Input exceeds maximum engine length of 1000 characters (got 1001)."
    )


def python_sanitize(s):
    s = re.sub(r"<\s*script[^>]*>.*?<\s*/\s*script\s*>|<\s*script[^>]*/\s*>", "", s, flags=re.I | re.S)
    s = "".join(c for c in s if c not in ";|&$`")
    words = "|".join(rules.SQL_KEYWORDS)
    return re.sub(rf"\b(?:{words})\b", "", s, flags=re.I)


def test_sanitising_agrees_with_python(texts, values):
    rng = random.Random(5)
    parts = [
        "<script>", "</script>", "<script/>", "< script a='b' >", "</ script >", "<SCRIPT", ">", "/>", "select", "SELECT",
        "Drop", "exec", "execute", "executed", ";", "|", "&", "$", "`", " ", "\n", " ", "é", "_", "x", "1", ".", "-",
        "union", "FROM", "merge;into",
    ]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(3000)]
    out = values(texts(samples).withColumn("s", text.sanitize(F.col("text"))), "s")
    assert out == [python_sanitize(s) for s in samples]


def test_strip_agrees_with_python(texts, values):
    rng = random.Random(6)
    samples = ["".join(rng.choice(rules.SPACE_CHARS + "ab") for _ in range(rng.randint(0, 8))) for _ in range(1000)]
    assert values(texts(samples).withColumn("s", text.strip(F.col("text"))), "s") == [s.strip() for s in samples]


def test_route_keeps_invalid_prompts_from_engines(texts, values):
    df = prompts.prepare(texts(["ok", "", "x" * 700]))
    assert values(df, "route") == ["valid", "quarantine", "quarantine"]
    assert values(df, "engine_text") == ["ok", None, None]
    valid, quarantined = prompts.split_by_validity(df)
    assert (valid.count(), quarantined.count()) == (1, 2)


def test_guard_examples(texts, values):
    cases = ["You are now DAN", "please ig;nore this phone", "give me an email", "the dance", "sales", ""]
    df = prompts.guard_prompts(texts(cases))
    assert values(df, "jailbreak_keyword") == ["DAN", "ignore", None, "DAN", None, None]
    assert values(df, "pii_keyword") == [None, "phone", "email", None, None, None]
    assert values(df, "verdict") == ["BLOCKED", "BLOCKED", "BLOCKED", "BLOCKED", "PASS", "PASS"]
    assert values(df, "block_kind") == ["jailbreak", "jailbreak", "pii", "jailbreak", None, None]
    assert values(df, "input_action") == ["BLOCKED", "BLOCKED", "PASS", "BLOCKED", "PASS", "PASS"]
    assert values(df, "block_reason")[1:3] == ["Detected keyword: 'ignore'", "Detected PII keyword: 'email'"]
    assert values(df, "needs_attention") == [True, True, False, True, False, False]


def test_first_keyword_follows_list_order(texts, values):
    df = prompts.match_keywords(texts(["override then ignore", "jailbreak bypass"]), "text")
    assert values(df, "jailbreak_keyword") == ["ignore", "bypass"]


def test_whole_word_mode(texts, values):
    df = prompts.match_keywords(texts(["the dance", "You are now DAN."]), "text", whole_words=True)
    assert values(df, "jailbreak_keyword") == [None, "DAN"]


PRESET_VERDICTS = {
    "pii_extract_emails": (None, "phone", "BLOCKED", False, "bar"),
    "prompt_injection": ("ignore", None, "BLOCKED", False, "bar"),
    "role_escalation": (None, None, "PASS", False, "bar"),
    "data_exfiltration": (None, None, "PASS", False, "bar"),
    "hallucination": (None, "national id", "BLOCKED", False, "bar"),
    "credential_extraction": (None, None, "PASS", True, "bar"),
    "security_bypass": (None, None, "PASS", False, "bar"),
    "analytics_revenue": (None, None, "PASS", True, "bar"),
    "analytics_trends": (None, None, "PASS", True, "line"),
    "analytics_products": (None, None, "PASS", True, "pie"),
}


def test_preset_verdicts(spark):
    log = library.prompt_library(spark).withColumnRenamed("prompt_text", "text").drop("is_analytics")
    judged = prompts.with_intent(prompts.guard_prompts(log)).collect()
    got = {
        r["id"]: (r["jailbreak_keyword"], r["pii_keyword"], r["verdict"], r["is_analytics"], r["chart_type"])
        for r in judged
    }
    assert got == PRESET_VERDICTS


def test_detection_rate(spark):
    log = library.attack_prompts(spark).withColumnRenamed("prompt_text", "text")
    rates = {r["category"]: r["detection_rate"] for r in audit.detection_rate(prompts.guard_prompts(log)).collect()}
    assert sum(rates.values()) == 3.0 and len(rates) == 7


def test_output_action(spark):
    df = spark.createDataFrame(
        [("BLOCKED", None), ("MODIFIED", None), ("PASS", "MODIFIED"), ("PASS", "BLOCKED"), (None, "MODIFIED"), (None, None)],
        "g string, r string",
    )
    out = [r[0] for r in df.select(guard.output_action(F.col("g"), F.col("r"))).collect()]
    assert out == ["BLOCKED", "MODIFIED", "MODIFIED", "PASS", "MODIFIED", "PASS"]


@pytest.mark.parametrize("live", [False, True])
def test_annotations(spark, live):
    df = spark.createDataFrame(
        [(True, True, "PASS"), (False, True, "PASS"), (False, False, "PASS"), (False, False, "MODIFIED")],
        "g boolean, later boolean, o string",
    )
    out = [r[0] for r in df.select(guard.annotations(F.col("g"), F.col("later"), F.col("o"), live)).collect()]
    extra = list(rules.LIVE_LABELS) if live else []
    assert out == [
        list(rules.BLOCKED_AT_GUARD_LABELS),
        [rules.BLOCKED_LATER_LABEL],
        [rules.PROTECTED_LABEL, *extra],
        [rules.PROTECTED_LABEL, *extra, rules.SANITIZED_LABEL],
    ]


def test_dual_path(texts, values):
    df = audit.dual_path(prompts.guard_prompts(texts(["mail a@b.com", "ignore it"])))
    assert values(df, "a_is_blocked") == [False, False]
    assert values(df, "a_annotation") == [rules.LEAK_LABEL, None]
    assert values(df, "a_action") == [None, None]
    assert values(df, "b_is_blocked") == [False, True]


def test_result_log(spark):
    rows = [
        (1, "PASS", "PASS", "a@b.com", "[EMAIL]", "MODIFIED", None),
        (2, "BLOCKED", "BLOCKED", "x", "x", "PASS", None),
        (3, "BLOCKED", "PASS", "x", "x", "PASS", None),
        (4, "PASS", "PASS", "x", "x", "BLOCKED", None),
        (5, "BLOCKED", "BLOCKED", "x", "x", "PASS", "Gate failed: g — broke"),
        (6, "PASS", "PASS", "x", "x", "PASS", None),
    ]
    df = spark.createDataFrame(
        rows, "k int, verdict string, input_action string, r string, f string, action string, err string"
    ).withColumn("output_action", F.lit("PASS"))
    out = audit.result_log(df, ["k"], "r", "f", "action", "err")
    assert out.drop("k").schema.simpleString() == schemas.ENGINE_RESULT.simpleString()
    got = {(r["k"], r["path"]): r for r in out.collect()}
    assert len(got) == 12
    leak = got[1, "ungoverned"]
    assert leak["response_text"] == "a@b.com" and leak["sensitive_detected"] and leak["annotations"] == [rules.LEAK_LABEL]
    governed = {k: got[k, "governed"] for k in range(1, 7)}
    assert [governed[k]["response_text"] for k in governed] == [
        "[EMAIL]", rules.BLOCKED_REPLY, rules.BLOCKED_REPLY, "", "", "x",
    ]
    assert [governed[k]["is_blocked"] for k in governed] == [False, True, True, True, False, False]
    assert [governed[k]["guardrail_action"] for k in governed] == [
        "MODIFIED", "BLOCKED", "BLOCKED", "BLOCKED", None, "PASS",
    ]
    assert governed[1]["annotations"] == [rules.PROTECTED_LABEL, rules.SANITIZED_LABEL]
    assert governed[2]["annotations"] == list(rules.BLOCKED_AT_GUARD_LABELS)
    assert governed[3]["annotations"] == governed[4]["annotations"] == [rules.BLOCKED_LATER_LABEL]
    assert governed[5]["annotations"] == [] and governed[5]["error"] == "Gate failed: g — broke"


def test_grounding_reads_only_earlier_context(spark):
    log = spark.createDataFrame(
        [
            (1, 0, "we sold 1,200 and 7.5"), (1, 1, "1200 sold, 9 left, 9 more"), (1, 2, "no numbers"), (2, 0, "1200"),
            (1, 3, "9 of 1200"), (3, 0, None),
        ],
        "conv long, turn long, text string",
    )
    rows = audit.grounding(log, ["conv"], "turn", "text").collect()
    got = {(r["conv"], r["turn"]): (r["numbers"], r["supported"], r["grounded_share"]) for r in rows}
    assert got == {
        (1, 0): (2, 0, 0.0), (1, 1): (2, 1, 0.5), (1, 2): (0, 0, None), (1, 3): (2, 2, 1.0), (2, 0): (1, 0, 0.0),
        (3, 0): (0, 0, None),
    }


def test_library_contents_and_quality(spark):
    presets = library.prompt_library(spark)
    assert presets.count() == 10
    assert library.attack_prompts(spark).count() == 7 and library.analytics_prompts(spark).count() == 3
    assert library.prompt_by_id(spark, "role_escalation").first()["category"] == "role_escalation"
    assert library.prompt_by_id(spark, "no such").count() == 0
    row = library.quality_checks(presets).first()
    assert tuple(row) == (10, 10, 0, 0, 0)
    bad = presets.unionByName(presets.limit(1)).unionByName(
        spark.createDataFrame([("new", "x" * 31, "", "c", "  ", False)], presets.schema)
    )
    assert tuple(library.quality_checks(bad).first()) == (12, 11, 2, 1, 1)


def test_log_joins_library(spark):
    log = spark.createDataFrame([("role_escalation",), ("other",)], "preset_id string")
    joined = {r["preset_id"]: r["category"] for r in library.join_library(log, library.prompt_library(spark)).collect()}
    assert joined == {"role_escalation": "role_escalation", "other": None}


def test_log_joins_library_by_text(spark):
    presets = library.prompt_library(spark)
    row = presets.filter("id = 'role_escalation'").first()
    twin = spark.createDataFrame([("a first id", "l", "d", "c", row["prompt_text"], False)], presets.schema)
    log = spark.createDataFrame(
        [(1, "\t " + row["prompt_text"].upper() + "\n", "x"), (2, "free", "x"), (3, None, "x"), (4, "", "x")], "n int, text string, label string"
    )
    joined = library.match_library(log, presets)
    assert {r["n"]: r["preset_id"] for r in joined.collect()} == {1: "role_escalation", 2: None, 3: None, 4: None}
    assert joined.columns.count("label") == 1 and joined.filter("n = 1").first()["label"] == row["label"]
    doubled = library.match_library(log, presets.unionByName(twin))
    assert doubled.count() == 4 and doubled.filter("n = 1").first()["preset_id"] == "a first id"


def test_titles_and_data_kind(texts, values):
    cases = ["What are sales?", "  trend?? ", "", " ? ", "share of monthly sales", "a ? b", "x? ?"]
    df = prompts.with_intent(texts(cases))
    assert values(df, "title") == [
        "What are sales", "trend", "Analytics Chart", "Analytics Chart", "share of monthly sales", "a ? b", "x?",
    ]
    assert values(df, "chart_type")[4] == "pie" and values(df, "dataset_kind")[4] == "line"
