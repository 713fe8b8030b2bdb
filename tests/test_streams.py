"""Streaming jobs give the rows of their batch form, also across restarts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from govspark import schemas
from govspark.operators.findings import extract_findings
from govspark.operators.prompts import guard_prompts
from govspark.sources import prompts
from govspark.streaming import jobs

KEPT = ["conv_id", "turn", "route", "engine_text", "verdict", "block_kind"]


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_guard_stream_equals_batch_over_restarts(spark, folder, tmp_path):
    log = spark.read.parquet(f"{folder}/conversations.parquet")
    source, sink, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    log.filter("conv_id % 2 = 0").repartition(3).write.parquet(source)
    jobs.finish(jobs.guard_stream(prompts.prompt_stream(spark, source, 1), sink, state))
    first = jobs.read_routes(spark, sink).count()
    log.filter("conv_id % 2 = 1").repartition(2).write.mode("append").parquet(source)
    for _ in range(2):  # The second start finds nothing new and must not repeat rows.
        jobs.finish(jobs.guard_stream(prompts.prompt_stream(spark, source, 1), sink, state))
    stored = jobs.read_routes(spark, sink)
    assert 0 < first < stored.count() == log.count()
    assert bag(stored.select(KEPT)) == bag(guard_prompts(log).select(KEPT))
    counts = {r["route"]: r["prompts"] for r in jobs.route_counts(stored).collect()}
    assert sum(counts.values()) == log.count() and set(counts) <= {"valid", "quarantine"}
    assert jobs.read_sink(spark, sink, "valid").count() == counts["valid"]


@pytest.mark.parametrize("lost", ["valid", "quarantine", "manifest"])
def test_batch_killed_between_sinks_has_each_row_once(spark, folder, tmp_path, monkeypatch, lost):
    log = spark.read.parquet(f"{folder}/conversations.parquet")
    empty = log.limit(20).withColumn("text", F.lit("  "))  # quarantined
    source, sink, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    log.unionByName(empty).repartition(3).write.parquet(source)
    write, left = jobs.write_part, {"runs": 4}

    def dies(rows, path):
        left["runs"] -= f"/{lost}/" in path
        if left["runs"] == 2:  # in the second batch, before this sink is written
            raise RuntimeError("driver lost")
        write(rows, path)

    monkeypatch.setattr(jobs, "write_part", dies)
    with pytest.raises(Exception, match="driver lost"):
        jobs.finish(jobs.guard_stream(prompts.prompt_stream(spark, source, 1), sink, state))
    complete = spark.read.parquet(f"{sink}/manifest").count()
    before = jobs.read_routes(spark, sink).count()
    assert complete == 1 and 0 < before < log.count()
    monkeypatch.setattr(jobs, "write_part", write)
    jobs.finish(jobs.guard_stream(prompts.prompt_stream(spark, source, 1), sink, state))
    assert bag(jobs.read_routes(spark, sink).select(KEPT)) == bag(guard_prompts(log.unionByName(empty)).select(KEPT))
    assert jobs.read_sink(spark, sink, "quarantine").count() >= 20


def test_scan_stream_equals_batch(spark, folder, tmp_path):
    path = f"{folder}/documents.parquet"
    stream = prompts.file_stream(spark, path, schemas.DOCUMENTS)
    jobs.finish(jobs.scan_stream(stream, ["doc_id"], "text", f"{tmp_path}/out", f"{tmp_path}/state"))
    stored = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "category", "value")
    assert bag(stored) == bag(extract_findings(spark.read.parquet(path), ["doc_id"], "text"))


def test_stream_reads_a_single_file_and_a_folder(spark, folder, tmp_path):
    log = spark.read.parquet(f"{folder}/conversations.parquet")
    log.repartition(2).write.parquet(f"{tmp_path}/many")
    for i, path in enumerate([f"{folder}/conversations.parquet", f"{tmp_path}/many"]):
        jobs.finish(jobs.append_to(prompts.prompt_stream(spark, path), f"{tmp_path}/out{i}", f"{tmp_path}/s{i}"))
        assert spark.read.parquet(f"{tmp_path}/out{i}").count() == log.count()


def test_promotion_stream_is_stateless(spark):
    from govspark.operators.medallion import to_gold, to_silver
    from govspark.sources.synthetic import customer_profiles

    rate = spark.readStream.format("rate").load().select(F.col("value").alias("key"))
    promoted = to_gold(to_silver(customer_profiles(rate, "key"), "salt"))
    assert promoted.isStreaming and "email_token" in promoted.columns
