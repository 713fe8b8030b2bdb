"""S: the streaming jobs, run over the stored tables until everything is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark import schemas
from govspark.operators.medallion import TOKENISED
from govspark.plans.access import SQL_VISIBLE
from govspark.plans.base import Tables, plain, query, sql_findings, sql_prepared
from govspark.plans.detection import _MASKS, _PROFILES, TEST_SALT, document_scans
from govspark.plans.guard import STANDARD_GATES, gate_inputs
from govspark.session import scratch_dir
from govspark.sources import prompts, synthetic
from govspark.streaming import jobs


@query(
    "s1_guard_stream",
    f"""WITH {sql_prepared('conversations')},
gated AS (SELECT *, CASE WHEN route <> 'valid' THEN 0 WHEN {SQL_VISIBLE} IS NULL THEN 2
  WHEN jailbreak_keyword IS NOT NULL THEN 3 END AS stopped_at FROM guarded)
SELECT conv_id, turn, route, error_message, sha256(engine_text) AS engine_hash, verdict, block_reason, stopped_at,
  CASE WHEN stopped_at = 2 THEN 'Gate failed: Gate 2: column access — column access check failed: role has no policy' END AS error,
  coalesce(stopped_at = 3, FALSE) AS is_blocked FROM gated""",
)
def guard_stream(t: Tables):
    out = scratch_dir(t.spark, "guard-stream")
    arriving = prompts.prompt_stream(t.spark, t.path("conversations"))
    # Scanned once: the batches read the result, not the documents.
    document_scans(t).write.parquet(f"{out}/scans")
    scans = t.spark.read.parquet(f"{out}/scans")
    job = jobs.guard_stream(
        arriving, f"{out}/data", f"{out}/checkpoint", chain=STANDARD_GATES, enrich=gate_inputs(t, scans)
    )
    jobs.finish(job)
    return jobs.read_routes(t.spark, f"{out}/data").select(
        "conv_id", "turn", "route", "error_message", F.sha2("engine_text", 256).alias("engine_hash"), "verdict",
        "block_reason", "stopped_at", "error", "is_blocked",
    )


@query("s2_scan_stream", sql_findings("documents", "doc_id", "text"))
def scan_stream(t: Tables):
    out = scratch_dir(t.spark, "scan-stream")
    arriving = prompts.file_stream(t.spark, t.path("documents"), schemas.DOCUMENTS)
    jobs.finish(jobs.scan_stream(arriving, ["doc_id"], "text", f"{out}/data", f"{out}/checkpoint"))
    return t.spark.read.parquet(f"{out}/data").select("doc_id", "category", "value")


_PERSONAL = [c for c in _MASKS if c not in ("credit_card_number", "device_ip_address")]


@query(
    "s3_promotion_stream",
    f"""WITH {_PROFILES}
SELECT customer_id, {', '.join(f'{_MASKS[c]} AS {c}' for c in _PERSONAL)},
  {', '.join(f"sha256('govspark' || {c}) AS {c}_token" for c in TOKENISED if c in _PERSONAL)} FROM profiles""",
)
def promotion_stream(t: Tables):
    out = scratch_dir(t.spark, "promotion-stream")
    customers = prompts.file_stream(t.spark, t.path("customer"), t("customer").schema)
    bronze = synthetic.customer_profiles(customers.select("c_custkey"), "c_custkey")
    jobs.finish(jobs.silver_stream(bronze, TEST_SALT, f"{out}/silver", f"{out}/silver-checkpoint"))
    stored = t.spark.read.parquet(f"{out}/silver").schema
    silver = prompts.file_stream(t.spark, f"{out}/silver", stored)
    jobs.finish(jobs.gold_stream(silver, f"{out}/gold", f"{out}/gold-checkpoint"))
    return plain(t.spark.read.parquet(f"{out}/gold"))
