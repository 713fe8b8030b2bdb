"""The prompt log as an unbounded source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from govspark.schemas import PROMPT_LOG


def file_or_folder(path: str) -> str:
    """A glob that matches exactly this path.

    A file stream takes a plain path for a folder and refuses a single file. A glob works
    for both, so a table may be one file or a folder of files.
    """
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files as a stream, with an explicit schema."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(file_or_folder(path))


def prompt_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return file_stream(spark, path, PROMPT_LOG, files_per_trigger)


def kafka_prompt_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Prompts from a Kafka topic of JSON records. Needs the Kafka connector on the class path."""
    from pyspark.sql import functions as F

    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    record = F.from_json(F.col("value").cast("string"), PROMPT_LOG)
    return raw.select(record.alias("r")).select("r.*")
