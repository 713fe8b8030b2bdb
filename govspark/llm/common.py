"""Session preparation, written intermediates and access to Arrow text columns."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

import govspark
from govspark.session import scratch_dir, tune

#: Characters that separate words, as a regular expression class and for a word itself.
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]"
#: Rows of an Arrow batch; texts can be long, so fewer than Spark's default.
ARROW_ROWS = "500"
#: Bytes from which an Arrow batch is closed (one row at least), so long texts do not add up.
ARROW_BYTES = str(4 << 20)
#: Bytes of text that one vectorised step works on (one text at least).
SLICE_BYTES = 1 << 18


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that these operators expect to the session (they stay set).

    Python workers get the folder of this package on their path.
    """
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.abspath(govspark.__file__)))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes each, or one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, rows)
        first = last


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; a null is an empty text."""
    return pc.fill_null(column, "").to_pylist()
