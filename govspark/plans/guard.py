"""F, G, H and I: validation, guard verdicts, gate funnel and path audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark import rules
from govspark.functions import guard as guard_functions
from govspark.functions import text as text_functions
from govspark.operators import audit, gates, library, medallion, prompts
from govspark.operators.joins import lookup_join
from govspark.plans.access import SQL_VISIBLE, role_policies
from govspark.plans.base import (
    SQL_GOLD, SQL_PROMPT_LOG, SQL_REFERENCE, Tables, plain, prompt_log, query, sql_first, sql_finding_count,
    sql_list, sql_prepared, sql_profile, sql_redact, sql_sanitize, sql_strip_keywords, sql_strip_script, sql_strip_shell, sql_types,
)
from govspark.plans.detection import document_scans
from govspark.sources.gold import GOLD
from govspark.sources.synthetic import profile_rules

_CONV = sql_prepared("conversations")
_LOG = f"{SQL_PROMPT_LOG}, {sql_prepared('prompt_log')}"


@query("f1_validate_prompt", f"WITH {_CONV}\nSELECT conv_id, turn, is_valid, error_message, sanitized_text FROM checked")
def validate_prompt(t: Tables):
    return prompts.validate(t("conversations")).select(
        "conv_id", "turn", "is_valid", "error_message", "sanitized_text"
    )


@query(
    "f2_valid_quarantine_split",
    f"WITH {_CONV}\nSELECT role, count(*) FILTER (route = 'valid') AS valid, "
    "count(*) FILTER (route = 'quarantine') AS quarantined FROM cleaned GROUP BY 1",
)
def valid_quarantine_split(t: Tables):
    valid, quarantined = prompts.split_by_validity(prompts.prepare(t("conversations")))
    both = valid.select("role", F.lit(1).alias("v"), F.lit(0).alias("q")).unionAll(
        quarantined.select("role", F.lit(0), F.lit(1))
    )
    return both.groupBy("role").agg(F.sum("v").alias("valid"), F.sum("q").alias("quarantined"))


@query("f3_strip_script", f"SELECT page_id, sha256({sql_strip_script('html')}) AS stripped_hash FROM pages")
def strip_script(t: Tables):
    return t("pages").select("page_id", F.sha2(text_functions.strip_script_tags(F.col("html")), 256).alias("stripped_hash"))


@query("f4_strip_shell", f"SELECT page_id, sha256({sql_strip_shell('html')}) AS stripped_hash FROM pages")
def strip_shell(t: Tables):
    stripped = text_functions.strip_shell_metacharacters(F.col("html"))
    return t("pages").select("page_id", F.sha2(stripped, 256).alias("stripped_hash"))


@query(
    "f5_strip_keywords",
    "WITH log AS (SELECT conv_id, turn, 'please Select ' || text || ' drop;FROM' AS text FROM conversations)\n"
    f"SELECT conv_id, turn, sha256({sql_strip_keywords('text')}) AS stripped_hash FROM log",
)
def strip_keywords(t: Tables):
    carried = F.concat(F.lit("please Select "), F.col("text"), F.lit(" drop;FROM"))
    stripped = text_functions.strip_sql_keywords(carried)
    return t("conversations").select("conv_id", "turn", F.sha2(stripped, 256).alias("stripped_hash"))


@query(
    "f6_sanitize_for_engine",
    f"""SELECT conv_id, turn,
  CASE WHEN length(text) > 1000 THEN 'Input exceeds maximum engine length of 1000 characters (got ' || length(text) || ').' END AS engine_error,
  CASE WHEN length(text) <= 1000 THEN sha256({sql_sanitize('text')}) END AS engine_hash FROM conversations""",
)
def sanitize_for_engine(t: Tables):
    cleaned = prompts.sanitize_for_engine(t("conversations"), "text")
    return cleaned.select("conv_id", "turn", "engine_error", F.sha2("engine_text", 256).alias("engine_hash"))


@query("g1_jailbreak_match", f"SELECT doc_id, {sql_first('text', rules.REFERENCE_GUARD.jailbreak)} AS jailbreak_keyword FROM documents")
def jailbreak_match(t: Tables):
    return prompts.match_keywords(t("documents"), "text").select("doc_id", "jailbreak_keyword")


_PROTOTYPE_PII = sql_first("text", rules.PROTOTYPE_GUARD.pii)
_PROTOTYPE_JAILBREAK = sql_first("text", rules.PROTOTYPE_GUARD.jailbreak)


@query(
    "g2_pii_request_match",
    f"""WITH {SQL_PROMPT_LOG}
SELECT conv_id, turn, 'reference' AS ruleset, {sql_first('text', rules.REFERENCE_GUARD.jailbreak)} AS jailbreak_keyword,
  {sql_first('text', rules.REFERENCE_GUARD.pii)} AS pii_keyword FROM prompt_log
UNION ALL SELECT conv_id, turn, 'prototype', {_PROTOTYPE_JAILBREAK}, {_PROTOTYPE_PII} FROM prompt_log""",
)
def pii_request_match(t: Tables):
    columns = ["conv_id", "turn", "ruleset", "jailbreak_keyword", "pii_keyword"]
    log = prompt_log(t)
    out = None
    for name, words in rules.GUARDS.items():
        part = prompts.match_keywords(log, "text", words).withColumn("ruleset", F.lit(name)).select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "g3_input_action",
    f"WITH {_LOG}\nSELECT conv_id, turn, input_action, output_action FROM guarded WHERE route = 'valid'",
)
def input_action(t: Tables):
    guarded = prompts.guard_prompts(prompt_log(t))
    return guarded.filter("route = 'valid'").select("conv_id", "turn", "input_action", "output_action")


@query(
    "g4_governed_verdict",
    f"WITH {_LOG}\nSELECT conv_id, turn, preset_id, route, verdict, block_kind, block_reason FROM guarded",
)
def governed_verdict(t: Tables):
    return prompts.guard_prompts(prompt_log(t)).select(
        "conv_id", "turn", "preset_id", "route", "verdict", "block_kind", "block_reason"
    )


@query(
    "g5_needs_attention",
    f"WITH {_LOG}\nSELECT preset_id, input_action <> 'PASS' OR output_action <> 'PASS' AS needs_attention, count(*) AS prompts "
    "FROM guarded GROUP BY 1, 2",
)
def needs_attention(t: Tables):
    return (
        prompts.guard_prompts(prompt_log(t))
        .groupBy("preset_id", "needs_attention")
        .agg(F.count(F.lit(1)).alias("prompts"))
    )


_REDACTED = "CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'MODIFIED' ELSE 'PASS' END"
_GATE_ACTION = "CASE WHEN contains(lower(text), 'jailbreak') THEN 'BLOCKED' WHEN contains(text, '!') THEN 'MODIFIED' ELSE 'PASS' END"


@query(
    "g6_output_action",
    f"""SELECT doc_id, {_GATE_ACTION} AS gate_action, {_REDACTED} AS response_action,
  CASE WHEN {_GATE_ACTION} IN ('BLOCKED', 'MODIFIED') THEN {_GATE_ACTION}
       WHEN {_REDACTED} = 'MODIFIED' THEN 'MODIFIED' ELSE 'PASS' END AS output_action FROM documents""",
)
def output_action(t: Tables):
    text = F.col("text")
    gate = (
        F.when(F.lower(text).contains("jailbreak"), F.lit("BLOCKED"))
        .when(text.contains("!"), F.lit("MODIFIED"))
        .otherwise(F.lit("PASS"))
    )
    response = F.when(text.rlike("[0-9]{3}"), F.lit("MODIFIED")).otherwise(F.lit("PASS"))
    actions = t("documents").select("doc_id", gate.alias("gate_action"), response.alias("response_action"))
    return actions.withColumn(
        "output_action", guard_functions.output_action(F.col("gate_action"), F.col("response_action"))
    )


_FIRST, _SECOND = (label.replace("'", "''") for label in rules.BLOCKED_AT_GUARD_LABELS)


@query(
    "g7_annotations",
    f"""WITH {_LOG}
SELECT conv_id, turn, verdict = 'BLOCKED' AS is_blocked, CASE WHEN verdict = 'BLOCKED' THEN 'BLOCKED' ELSE 'PASS' END AS guardrail_action,
  CASE WHEN input_action = 'BLOCKED' THEN '{_FIRST},{_SECOND}'
       WHEN verdict = 'BLOCKED' THEN '{rules.BLOCKED_LATER_LABEL}'
       ELSE '{rules.PROTECTED_LABEL}' END AS annotations
FROM guarded WHERE route = 'valid'""",
)
def annotations(t: Tables):
    guarded = prompts.guard_prompts(prompt_log(t)).filter("route = 'valid'")
    return plain(
        prompts.with_annotations(guarded).select("conv_id", "turn", "is_blocked", "guardrail_action", "annotations")
    )


@query(
    "g8_ungoverned_verdict",
    f"""SELECT doc_id, FALSE AS is_blocked, {sql_types('text', SQL_REFERENCE)} <> '' AS sensitive_detected,
  CASE WHEN {sql_types('text', SQL_REFERENCE)} <> '' THEN '⚠️ Ungoverned — Data Leaked' END AS annotation FROM documents""",
)
def ungoverned_verdict(t: Tables):
    answered = t("documents").withColumn("verdict", F.lit("PASS"))
    return audit.dual_path(answered, "text").select(
        "doc_id",
        F.col("a_is_blocked").alias("is_blocked"),
        F.col("a_sensitive").alias("sensitive_detected"),
        F.col("a_annotation").alias("annotation"),
    )


_NUMBERS = r"unnest(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?'), lambda x: replace(x, ',', ''))))"


@query(
    "g9_grounding",
    f"""WITH log AS (SELECT source AS topic, doc_id, text FROM documents),
said AS (SELECT topic, doc_id, {_NUMBERS} AS number FROM log),
first_said AS (SELECT topic, number, min(doc_id) AS seen FROM said GROUP BY 1, 2),
judged AS (SELECT s.topic, s.doc_id, count(*) AS numbers, count(*) FILTER (f.seen < s.doc_id) AS supported
  FROM said s JOIN first_said f ON s.topic IS NOT DISTINCT FROM f.topic AND s.number = f.number GROUP BY 1, 2)
SELECT l.topic, l.doc_id, coalesce(numbers, 0) AS numbers, coalesce(supported, 0) AS supported,
  CAST(supported AS DOUBLE) / numbers AS grounded_share
FROM log l LEFT JOIN judged j ON l.topic IS NOT DISTINCT FROM j.topic AND l.doc_id = j.doc_id""",
)
def grounding(t: Tables):
    """Numbers in each document that an earlier document of the same source already gave."""
    log = t("documents").select(F.col("source").alias("topic"), "doc_id", "text")
    return audit.grounding(log, ["topic"], "doc_id", "text")


class LengthGate(gates.Gate):
    """A gate of our own: very short prompts are blocked before anything else is looked at."""

    def __init__(self, minimum: int, column: str = "engine_text") -> None:
        super().__init__(f"Length gate ({minimum})")
        self.minimum, self.column = minimum, column

    def result(self):
        size = F.length(self.column)
        return gates.gate_result(size >= self.minimum, size < self.minimum, length=size)


STANDARD_GATES = [gates.ScanGate(), gates.ColumnAccessGate(), gates.PromptGuardGate()]


def gate_inputs(t: Tables, scans=None):
    """What the standard gates read, joined onto prompts: the scan result and the role's columns.

    A stream hands in a written scan result, which its batches then read.
    """

    def enrich(df):
        scanned = lookup_join(df, document_scans(t) if scans is None else scans, "conv_id")
        return scanned.join(role_policies(t), "role", "left")

    return enrich


def gated_prompts(t: Tables, chain: list[gates.Gate]):
    """Valid prompts of the log with the inputs of the gates, run through a chain."""
    guarded = prompts.guard_prompts(prompt_log(t)).filter("route = 'valid'")
    return gates.run_gates(guarded.transform(gate_inputs(t)), chain)


_GATED = f"""{_LOG},
scans AS (SELECT doc_id, CAST(sum({sql_finding_count('text')}) AS BIGINT) AS n FROM documents GROUP BY 1),
gated AS (SELECT *, {SQL_VISIBLE} AS visible, CASE WHEN {SQL_VISIBLE} IS NULL THEN 2 WHEN jailbreak_keyword IS NOT NULL THEN 3 END AS stopped_at
  FROM guarded LEFT JOIN scans ON conv_id = doc_id WHERE route = 'valid')"""


@query(
    "h1_gate_sequence",
    f"""WITH {_GATED}
SELECT conv_id, turn, stopped_at, coalesce(stopped_at, 3) AS executed, coalesce(stopped_at, 3) AS n_results,
  CASE WHEN n IS NULL THEN 'unavailable' WHEN n = 0 THEN 'clean' ELSE 'detected' END AS scan_status FROM gated""",
)
def gate_sequence(t: Tables):
    return gated_prompts(t, STANDARD_GATES).select(
        "conv_id", "turn", "stopped_at", "executed", F.size("gate_results").alias("n_results"),
        F.element_at("gate_results", 1)["details"]["scan_status"].alias("scan_status"),
    )


@query(
    "h2_row_outcome",
    f"""WITH {_GATED}
SELECT conv_id, turn,
  CASE WHEN stopped_at = 2 THEN 'Gate failed: Gate 2: column access — column access check failed: role has no policy' END AS error,
  coalesce(stopped_at = 3, FALSE) AS is_blocked FROM gated""",
)
def row_outcome(t: Tables):
    return gates.row_outcome(gated_prompts(t, STANDARD_GATES)).select("conv_id", "turn", "error", "is_blocked")


@query(
    "h3_custom_gate",
    f"""WITH {_GATED},
custom AS (SELECT *, CASE WHEN length(engine_text) < 200 THEN 1 WHEN stopped_at IS NOT NULL THEN stopped_at + 1 END AS stop4 FROM gated)
SELECT conv_id, turn, stop4 AS stopped_at, coalesce(stop4 IN (1, 4), FALSE) AS is_blocked FROM custom""",
)
def custom_gate(t: Tables):
    ran = gated_prompts(t, [LengthGate(200), *STANDARD_GATES])
    return gates.row_outcome(ran).select("conv_id", "turn", "stopped_at", "is_blocked")


@query(
    "h4_funnel",
    f"""WITH {_GATED},
counts AS (SELECT g AS gate_no, count(*) FILTER (coalesce(stopped_at, 3) >= g) AS entered,
  count(*) FILTER (stopped_at = g AND g = 3) AS blocked, count(*) FILTER (stopped_at = g AND g = 2) AS errored
  FROM gated, (SELECT unnest([1, 2, 3]) AS g) GROUP BY 1)
SELECT gate_no, ['Gate 1: PII scan', 'Gate 2: column access', 'Gate 3: prompt guard'][gate_no] AS gate,
  entered, blocked, errored, entered - blocked - errored AS passed FROM counts""",
)
def funnel(t: Tables):
    return gates.funnel(gates.row_outcome(gated_prompts(t, STANDARD_GATES)), STANDARD_GATES)


@query(
    "i1_dual_path",
    f"""WITH {_LOG}
SELECT conv_id, turn, FALSE AS a_is_blocked, {sql_types('engine_text', SQL_REFERENCE)} AS a_types,
  verdict = 'BLOCKED' AS b_is_blocked, verdict AS b_action FROM guarded WHERE route = 'valid'""",
)
def dual_path(t: Tables):
    guarded = prompts.guard_prompts(prompt_log(t)).filter("route = 'valid'")
    return plain(
        audit.dual_path(guarded).select("conv_id", "turn", "a_is_blocked", "a_types", "b_is_blocked", "b_action")
    )


_CONTACT = f"text || ' ' || {sql_profile('conv_id')['email']}"
_REPLY = rules.BLOCKED_REPLY.replace("\n", "' || chr(10) || '")


@query(
    "i1_result_log",
    f"""WITH {_GATED},
answered AS (SELECT * EXCLUDE (text), CASE WHEN turn % 3 = 0 THEN {_CONTACT} ELSE text END AS response FROM gated),
filtered AS (SELECT *, {sql_redact('response')} AS red, stopped_at = 2 AS failed FROM answered)
SELECT conv_id, turn, 'ungoverned' AS path, sha256(response) AS response_hash, FALSE AS is_blocked,
  CASE WHEN {sql_types('response', SQL_REFERENCE)} <> '' THEN '{rules.LEAK_LABEL}' ELSE '' END AS annotations,
  NULL AS guardrail_action, {sql_types('response', SQL_REFERENCE)} <> '' AS sensitive_detected, NULL AS error FROM filtered
UNION ALL SELECT conv_id, turn, 'governed',
  sha256(CASE WHEN failed THEN '' WHEN verdict = 'BLOCKED' THEN '{_REPLY}' ELSE red END),
  NOT coalesce(failed, FALSE) AND verdict = 'BLOCKED',
  CASE WHEN failed THEN '' WHEN input_action = 'BLOCKED' THEN '{_FIRST},{_SECOND}'
    WHEN verdict = 'BLOCKED' THEN '{rules.BLOCKED_LATER_LABEL}'
    WHEN red <> response THEN '{rules.PROTECTED_LABEL},{rules.SANITIZED_LABEL}' ELSE '{rules.PROTECTED_LABEL}' END,
  CASE WHEN failed THEN NULL WHEN verdict = 'BLOCKED' THEN 'BLOCKED' WHEN red <> response THEN 'MODIFIED' ELSE 'PASS' END,
  FALSE, CASE WHEN failed THEN 'Gate failed: Gate 2: column access — column access check failed: role has no policy' END
FROM filtered""",
)
def result_log(t: Tables):
    """Results of both paths. Every third answer names a contact, which the output filter of
    the governed path removes."""
    email = F.expr(profile_rules("conv_id")["email"])
    contact = F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", "text", email)).otherwise(F.col("text"))
    gated = gates.row_outcome(gated_prompts(t, STANDARD_GATES)).withColumn("response", contact)
    filtered = medallion.redact_text(gated, "response")
    log = audit.result_log(filtered, ["conv_id", "turn"], "response", "redacted_text", "redact_action", "error")
    return plain(log.withColumn("response_hash", F.sha2("response_text", 256)).drop("response_text"))


def _row(columns) -> str:
    return "concat_ws(', ', " + ", ".join(f"'{c}: ' || CAST({c} AS VARCHAR)" for c in columns) + ")"


_PATHS = " UNION ALL ".join(
    f"SELECT '{path}' AS path, {_row(cols)} AS text FROM gold"
    for path, cols in {"ungoverned": GOLD, "governed": [c for c in GOLD if c in rules.ALLOWED_COLUMNS]}.items()
)
_HITS = ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}_rows" for n, p in SQL_REFERENCE.items())


@query(
    "i2_leak_audit",
    f"""WITH {SQL_GOLD}, paths AS ({_PATHS})
SELECT path, count(*) AS n_rows, count(*) FILTER ({sql_types('text', SQL_REFERENCE)} <> '') AS leaked_rows, {_HITS}
FROM paths GROUP BY 1""",
)
def leak_audit(t: Tables):
    return audit.leak_audit_of_star(t.star())


@query(
    "i3_preset_evaluation",
    f"""WITH {_LOG}
SELECT category, count(*) AS attempts, count(*) FILTER (route = 'quarantine') AS quarantined,
  count(*) FILTER (block_kind = 'jailbreak') AS blocked_jailbreak, count(*) FILTER (block_kind = 'pii') AS blocked_pii,
  CAST(count(*) FILTER (block_kind IS NOT NULL) AS DOUBLE) / count(*) AS detection_rate FROM guarded GROUP BY 1""",
)
def preset_evaluation(t: Tables):
    return audit.detection_rate(prompts.guard_prompts(prompt_log(t)))


@query(
    "l2_prompt_library",
    f"""WITH {SQL_PROMPT_LOG}, log AS (
  SELECT preset_id, conv_id FROM prompt_log UNION ALL SELECT 'free_text', conv_id FROM conversations),
lib AS (SELECT unnest({[p[0] for p in rules.PROMPT_LIBRARY]}) AS id, unnest({[p[1] for p in rules.PROMPT_LIBRARY]}) AS label,
  unnest({[p[5] for p in rules.PROMPT_LIBRARY]}) AS is_analytics)
SELECT preset_id, label, is_analytics, count(*) AS prompts FROM log LEFT JOIN lib ON preset_id = id GROUP BY 1, 2, 3""",
)
def prompt_library(t: Tables):
    log = prompt_log(t).select("preset_id", "conv_id").unionByName(
        t("conversations").select(F.lit("free_text").alias("preset_id"), "conv_id")
    )
    presets = library.attack_prompts(t.spark).unionByName(library.analytics_prompts(t.spark))
    return (
        library.join_library(log, presets)
        .groupBy("preset_id", "label", "is_analytics")
        .agg(F.count(F.lit(1)).alias("prompts"))
    )


_ASKED = [p[4] for p in rules.PROMPT_LIBRARY]


@query(
    "l2_prompt_by_text",
    f"""WITH log AS (SELECT CASE WHEN (conv_id + turn) % 3 = 0
    THEN '  ' || upper({sql_list(_ASKED)}[(conv_id * 7 + turn) % 10 + 1]) || chr(10) ELSE text END AS text FROM conversations),
lib AS (SELECT unnest({sql_list(p[0] for p in rules.PROMPT_LIBRARY)}) AS id, unnest({sql_list(p[1] for p in rules.PROMPT_LIBRARY)}) AS label,
  unnest({sql_list(_ASKED)}) AS prompt_text, unnest({[p[5] for p in rules.PROMPT_LIBRARY]}) AS is_analytics)
SELECT id AS preset_id, label, is_analytics, count(*) AS prompts
FROM log LEFT JOIN lib ON trim(lower(text), ' ' || chr(10)) = trim(lower(prompt_text)) GROUP BY 1, 2, 3""",
)
def prompt_by_text(t: Tables):
    """Every third turn asks a library prompt in capitals with blanks around; the others are free."""
    number = ((F.col("conv_id") * 7 + F.col("turn")) % 10 + 1).cast("int")
    asked = F.element_at(F.array(*[F.lit(p) for p in _ASKED]), number)
    shouted = F.concat(F.lit("  "), F.upper(asked), F.lit("\n"))
    log = t("conversations").select(
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, shouted).otherwise(F.col("text")).alias("text")
    )
    return (
        library.match_library(log, library.prompt_library(t.spark))
        .groupBy("preset_id", "label", "is_analytics")
        .agg(F.count(F.lit(1)).alias("prompts"))
    )


@query(
    "l3_library_quality",
    f"""WITH entries AS (
  SELECT 'conv-' || conv_id AS id, role || ': ' || text AS label, text AS prompt_text FROM conversations
  UNION ALL SELECT unnest({[p[0] for p in rules.PROMPT_LIBRARY]}), unnest({[p[1] for p in rules.PROMPT_LIBRARY]}),
    unnest({[p[4] for p in rules.PROMPT_LIBRARY]})),
per_id AS (SELECT id, count(*) AS n, count(*) FILTER (length(label) > 30) AS long_labels,
  count(*) FILTER (regexp_replace(coalesce(prompt_text, ''), '\\s+', '', 'g') = '') AS empty_prompts FROM entries GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS prompts, count(*) AS ids, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_id_rows,
  CAST(sum(long_labels) AS BIGINT) AS long_labels, CAST(sum(empty_prompts) AS BIGINT) AS empty_prompts FROM per_id""",
)
def library_quality(t: Tables):
    logged = t("conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("id"),
        F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("label"),
        F.col("text").alias("prompt_text"),
    )
    presets = library.prompt_library(t.spark).select("id", "label", "prompt_text")
    return library.quality_checks(logged.unionByName(presets))
