"""Stateless streaming jobs: prompt guard, text scan and promotion.

Each job reads arriving files, applies the same functions as the batch form and appends to
an exactly-once Parquet sink, or to several at once. Offsets and commits live in the job's own
folder, so a lost driver or executor repeats a batch without repeating its rows. ``availableNow`` processes
everything that has arrived and stops; pass another trigger for a job that keeps running.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from govspark import rules
from govspark.operators.findings import extract_findings
from govspark.operators.gates import Gate, row_outcome, run_gates
from govspark.operators.medallion import to_gold, to_silver
from govspark.operators.prompts import guard_prompts
from govspark.rules import Detector

AVAILABLE_NOW = {"availableNow": True}


def append_to(
    stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.start(path)


def append_to_sinks(
    stream: DataFrame, sinks: dict[str, Column], path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Rows of each batch to every sink whose condition they meet, each row once in each of them.

    A batch has a folder of its own in each sink, and an entry in the manifest once all sinks have
    it. A batch that was cut off between two sinks is run again under its number and replaces what
    it had left; until then ``read_sink`` does not show it. A path belongs to one checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for name, condition in sinks.items():
                write_part(rows.filter(condition), f"{path}/{name}/batch_id={number}")
            done = rows.sparkSession.range(1).select(F.lit(",".join(sinks)).alias("sinks"))
            write_part(done, f"{path}/manifest/batch_id={number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or AVAILABLE_NOW)).start()


def write_part(rows: DataFrame, path: str) -> None:
    """One batch's folder of a sink, replaced if it is there."""
    rows.write.mode("overwrite").parquet(path)


def read_sink(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a sink's complete batches."""
    complete = spark.read.parquet(f"{path}/manifest").select("batch_id").distinct()
    return spark.read.parquet(f"{path}/{name}").join(complete, "batch_id", "left_semi").drop("batch_id")


ROUTES = ("valid", "quarantine")


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """The rows of both sinks of ``guard_stream``."""
    valid, quarantine = (read_sink(spark, path, name) for name in ROUTES)
    return valid.unionByName(quarantine)


def guard_stream(
    prompts: DataFrame,
    path: str,
    checkpoint: str,
    chain: list[Gate] | None = None,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> StreamingQuery:
    """Judge arriving prompts and run the valid ones through a chain of gates.

    ``enrich`` adds what the gates read, usually by joins with stored tables. Valid and
    quarantined prompts go to a sink of their own (``valid`` and ``quarantine``), written batch by
    batch, so neither can get ahead of the other.
    """
    judged = guard_prompts(prompts)
    if enrich is not None:
        judged = judged.transform(enrich)
    if chain:
        judged = row_outcome(run_gates(judged, chain, enters=F.col("route") == "valid"))
    return append_to_sinks(judged, {name: F.col("route") == name for name in ROUTES}, path, checkpoint, **options)


def scan_stream(
    records: DataFrame,
    keys: list[str],
    text: str,
    path: str,
    checkpoint: str,
    detectors: tuple[Detector, ...] = rules.EXTENDED_DETECTORS,
    **options,
) -> StreamingQuery:
    """Findings of arriving text."""
    return append_to(extract_findings(records, keys, text, detectors), path, checkpoint, **options)


def silver_stream(bronze: DataFrame, salt: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Arriving raw records, typed and tokenised."""
    return append_to(to_silver(bronze, salt), path, checkpoint, **options)


def gold_stream(silver: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Arriving Silver records, masked."""
    return append_to(to_gold(silver), path, checkpoint, **options)


def finish(query: StreamingQuery) -> DataFrame | None:
    """Wait for an ``availableNow`` job; a failure of the job is raised here."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return None


def route_counts(sink: DataFrame) -> DataFrame:
    return sink.groupBy("route").agg(F.count(F.lit(1)).alias("prompts"))
