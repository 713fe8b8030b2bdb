"""Parquet, CSV and catalog tables with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def fixed_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A short list of constants as rows inside the plan.

    Catalyst knows the size of such a frame, so a join with it is broadcast.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    records = [dict(zip(schema.fieldNames(), row, strict=True)) for row in rows]
    parsed = F.from_json(F.lit(json.dumps(records)), T.ArrayType(schema))
    return spark.range(1, numPartitions=1).select(F.inline(parsed))


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write Parquet. With ``partition_by``, one directory per value.

    The rebalance step gives each value a few files of good size instead of one small file
    per task, and splits a value that holds a large share of the rows over several tasks.
    """
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("errorifexists").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("errorifexists").parquet(path)


def _escaped(c: Column) -> Column:
    """Text on one line: line breaks and backslashes as two characters, an empty text as a mark."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(c == "", F.lit("\\e")).otherwise(out)


def _unescaped(c: Column) -> Column:
    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

    # Between doubled backslashes every backslash begins a line break.
    parts = F.transform(F.split(c, r"\\\\"), plain)
    return F.when(c == "\\e", F.lit("")).otherwise(F.array_join(parts, "\\"))


CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header line, one line per row, so that files can be split.

    Quotes inside values are doubled, as usual for CSV. Line breaks and backslashes are escaped,
    and empty texts marked, so ``read_csv`` gives back what was written.
    """
    texts = {f.name: _escaped(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    df.withColumns(texts).write.mode("errorifexists").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    df = spark.read.schema(schema).options(**CSV).option("multiLine", False).csv(path)
    return df.withColumns({f.name: _unescaped(F.col(f"`{f.name}`")) for f in schema.fields if isinstance(f.dataType, T.StringType)})


def catalog_table(spark: SparkSession, database: str | None, table: str) -> DataFrame:
    """A table or view by database name and table name."""
    name = f"`{database}`.`{table}`" if database else f"`{table}`"
    return spark.table(name)
