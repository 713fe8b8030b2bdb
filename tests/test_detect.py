"""Detection, findings, redaction, tokens and masks."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from govspark import rules
from govspark.functions import detect
from govspark.operators import findings, medallion

# Texts and what must be found in them.
EXAMPLES = [
    ("Contact: +66-81-234-5678", ["phone"]),
    ("Call us at (555) 123-4567", ["phone"]),
    ("Send to somchai@company.co.th for details", ["email"]),
    ("ID: 1-1234-56789-01-2", ["national_id"]),
    ("Code: ACME-INTERNAL-2024-CONFIDENTIAL", ["company_code"]),
    ("code: acme-internal-x9-confidential", ["company_code"]),
    (
        "Email: test@example.com, Phone: +66-81-234-5678, ID: 1-1234-56789-01-2, "
        "Code: XYZ-INTERNAL-ABC-CONFIDENTIAL",
        ["phone", "email", "national_id", "company_code"],
    ),
    ("Revenue by region: APAC 1.2M, EU 420K, NA 890K", []),
    ("", []),
    ("two mails a@b.com c@d.org and +1 555 123 4567 and (555)123-4567", ["phone", "email"]),
    ("SSN 312-45-6789 is not a national id here", []),
]


def test_types_of_examples(texts, values):
    typed = findings.with_detected_types(texts([t for t, _ in EXAMPLES]), "text")
    assert values(typed, "types") == [want for _, want in EXAMPLES]
    assert values(typed, "sensitive_detected") == [bool(want) for _, want in EXAMPLES]
    assert values(typed, "leak_label") == [rules.LEAK_LABEL if want else None for _, want in EXAMPLES]


def test_null_text_has_no_types(texts, values):
    assert values(findings.with_detected_types(texts([None]), "text"), "types") == [[]]


# The patterns as a Python user would write them; used as an independent check below.
PLAIN = {
    "phone": [
        r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{2,4}[-.\s]?\d{3,4}",
        r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}",
    ],
    "email": [r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"],
    "national_id": [r"\d-\d{4}-\d{5}-\d{2}-\d"],
    "company_code": [r"(?i)[A-Z0-9]{2,}-INTERNAL-[A-Z0-9]{2,}-CONFIDENTIAL"],
}


def noisy_texts(seed, n):
    """Texts glued together from near-matches, so that pattern edges are hit often."""
    rng = random.Random(seed)
    parts = [
        "a@b.com", ".x@c.org", "@", "user.name+tag@mail", ".example.co", "1", "22", "333", "4444", "55555", "-", "+",
        "(555)", " ", " ", "\t", ".", "+66", "1-1234-56789-01-2", "AB", "-INTERNAL-", "-internal-", "XY9",
        "-CONFIDENTIAL", "-Confidential", "é", "๑", "word", "_", "%", "K", "ſ", "123-45-6789", "4111-1111-1111-1111",
        "10.0.0.1", "\n",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_types_agree_with_plain_patterns(texts, values):
    samples = noisy_texts(1, 3000)
    want = [[name for name, ps in PLAIN.items() if any(re.search(p, s) for p in ps)] for s in samples]
    assert values(findings.with_detected_types(texts(samples), "text"), "types") == want


@pytest.mark.parametrize("name", ["email", "national_id", "company_code"])
def test_found_values_agree_with_plain_patterns(texts, values, name):
    samples = noisy_texts(2, 3000)
    detector = next(d for d in rules.REFERENCE_DETECTORS if d.name == name)
    found = texts(samples).withColumn("v", detect.found_values(F.col("text"), detector))
    got = [v or [] for v in values(found, "v")]
    assert got == [re.findall(PLAIN[name][0], s) for s in samples]
    counts = texts(samples).withColumn("c", detect.match_count(F.col("text"), detector))
    assert values(counts, "c") == [len(g) for g in got]


def test_redaction_leaves_nothing(texts):
    checked = medallion.residual_check(texts(noisy_texts(3, 3000)), "text")
    assert checked.filter(F.size("residual_types") > 0).count() == 0


def test_redaction_order_and_action(texts, values):
    df = medallion.redact_text(
        texts(["card 4111 1111 1111 1111 tel +1-555-123-4567", "ssn 123-45-6789 at 10.1.2.3", "nothing"]), "text"
    )
    assert values(df, "redacted_text") == ["card [CARD] tel [PHONE]", "ssn [SSN] at [IP]", "nothing"]
    assert values(df, "redact_action") == ["MODIFIED", "MODIFIED", "PASS"]


def test_findings_rows_and_counts(spark, texts):
    df = texts(["a@b.com a@b.com 10.0.0.1", "c@d.org", "none", None])
    found = findings.extract_findings(df, ["n"], "text")
    assert sorted(map(tuple, found.collect())) == [
        (0, "email", "a@b.com"), (0, "email", "a@b.com"), (0, "ip", "10.0.0.1"), (1, "email", "c@d.org"),
    ]
    counts = {r["category"]: (r["findings"], r["distinct_values"]) for r in findings.count_findings(found).collect()}
    assert counts == {"email": (3, 2), "ip": (1, 1), "TOTAL": (4, 3)}


def test_scan_status_texts(spark):
    df = spark.createDataFrame([("x", None), ("y", "clean"), ("z", "a@b.com and 10.0.0.1")], "source string, text string")
    report = {r["source"]: r for r in findings.scan_report(df, ["source"], "text").collect()}
    assert report["x"]["status"] == "unavailable" and report["x"]["summary"] == "PII scan: Results unavailable"
    assert report["y"]["summary"] == "PII scan: No PII detected in source data — data is clean"
    assert report["z"]["summary"] == (
        "PII scan: 2 PII findings detected in source data\n  • email: 1\n  • ip: 1"
    )
    assert [report[k]["expanded"] for k in "xyz"] == [False, False, True]


def test_missing_scan_never_blocks(spark):
    prompts = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    scans = spark.createDataFrame([(1, 0), (2, 5)], "k long, findings_count long")
    rows = {r["k"]: r for r in findings.attach_scan(prompts, scans, "k").collect()}
    assert {k: r["scan_status"] for k, r in rows.items()} == {
        1: "clean", 2: "detected", 3: "unavailable", None: "unavailable",
    }
    assert all(r["passed"] and not r["blocked"] for r in rows.values())


def test_column_profile_counts_address_twice(spark):
    from govspark.plans.base import Tables

    profile = findings.profile_columns(Tables(spark, "/root/testdata/sf0.001").gold())
    found = {(r["column_name"], r["category"]) for r in profile.collect()}
    assert found == {
        ("email", "EMAIL_ADDRESS"), ("phone_number", "PHONE_NUMBER"), ("national_id", "NATIONAL_ID"),
        ("credit_card_number", "CREDIT_CARD_NUMBER"), ("date_of_birth", "DATE_OF_BIRTH"),
        ("shipping_address", "ADDRESS"), ("billing_address", "ADDRESS"),
    }
    by_category = {r["category"]: r["findings"] for r in findings.findings_by_category(profile).collect()}
    assert by_category == {
        "EMAIL_ADDRESS": 1, "PHONE_NUMBER": 1, "NATIONAL_ID": 1, "CREDIT_CARD_NUMBER": 1, "DATE_OF_BIRTH": 1,
        "ADDRESS": 2,
    }
    record = findings.findings_record(findings.findings_by_category(profile)).first()
    assert record["findings_count"] == 7 and record["categories"] == by_category


def test_tokens_are_stable_and_keep_nulls(spark, values):
    df = spark.createDataFrame([(0, "a@b.com"), (1, "a@b.com"), (2, "c@d.org"), (3, None)], "n int, email string")
    tokens = values(medallion.tokenise_columns(df, "one", ("email",)), "email_token")
    assert tokens[0] == tokens[1] != tokens[2] and tokens[3] is None and len(tokens[0]) == 64
    other = values(medallion.tokenise_columns(df, "other", ("email",)), "email_token")
    assert other[0] != tokens[0]


def test_masks(spark):
    df = spark.createDataFrame(
        [("ann@x.org", "+1-555-123-4567", "123-45-6789", "10.0.0.1", None)],
        "email string, phone_number string, national_id string, device_ip_address string, first_name string",
    )
    row = medallion.mask_columns(df).first()
    assert tuple(row) == ("a***@x.org", "+#-###-###-4567", "###-##-6789", "##.#.#.#", None)


def test_promotion_hides_raw_values(spark, tmp_path):
    from govspark.sources.synthetic import synthetic_customers

    bronze = synthetic_customers(spark, 50).withColumn(
        "note", F.concat(F.lit("call "), F.col("phone_number"), F.lit(" or "), F.col("email"))
    )
    gold = medallion.promote(bronze, f"{tmp_path}/silver", f"{tmp_path}/gold", "salt", text_columns=("note",))
    silver = spark.read.parquet(f"{tmp_path}/silver")
    raw = {v for r in bronze.select("email", "phone_number", "national_id").collect() for v in r}
    for layer in (silver, gold):
        assert not raw & {str(v) for r in layer.collect() for v in r}
        assert {r["note"] for r in layer.collect()} == {"call [PHONE] or [EMAIL]"}
    assert gold.count() == 50 and gold.select("email_token").distinct().count() == bronze.select("email").distinct().count()
    assert dict(silver.dtypes)["date_of_birth"] == "date"
    names = {v for r in bronze.select("first_name", "shipping_address", "date_of_birth").collect() for v in r}
    assert not names & {str(v) for r in gold.collect() for v in r}


def test_second_run_of_a_failed_promotion_picks_up_silver(spark, monkeypatch):
    from govspark.session import RunFolder
    from govspark.sources.synthetic import synthetic_customers

    bronze, made = synthetic_customers(spark, 50), []
    to_silver, to_gold = medallion.to_silver, medallion.to_gold
    monkeypatch.setattr(medallion, "to_silver", lambda *a: made.append("silver") or to_silver(*a))
    monkeypatch.setattr(medallion, "to_gold", lambda df: df.withColumn("lost", F.raise_error(F.lit("executor lost"))))
    run = RunFolder(spark, "promotion-test")
    with pytest.raises(Exception, match="executor lost"):
        medallion.promote_run(bronze, run, "salt")
    assert run.done("silver") and not run.done("gold")
    monkeypatch.setattr(medallion, "to_gold", to_gold)
    again = RunFolder(spark, "promotion-test")
    got = sorted(map(tuple, medallion.promote_run(bronze, again, "salt").collect()))
    assert made == ["silver"] and got == sorted(map(tuple, to_gold(to_silver(bronze, "salt")).collect()))
    again.close()
    assert not run.done("silver") and not os.path.exists(run.path)


def test_owned_intermediates_are_removed(spark):
    from govspark.session import owned_scratch, scratch_dir

    with owned_scratch(spark, "owned-test") as run:
        path = scratch_dir(spark, "x")
        spark.range(3).write.parquet(path)
    assert path.startswith(run.path) and not scratch_dir(spark, "x").startswith(run.path)
    assert spark.read.parquet(path).count() == 3
    run.close()
    assert not os.path.exists(run.path)
