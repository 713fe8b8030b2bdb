"""The left look-up join of this library, and what it relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(left: DataFrame, right: DataFrame, keys: str | list[str]) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``keys``, where ``right`` has one row per key.

    A small right side is broadcast by Spark. Otherwise adaptive execution, which the session
    settings of this library turn on, splits the shuffle partitions of ``left`` that a frequent
    or null key makes large, and reads the right rows of such a partition once per part.
    """
    return left.join(right, [keys] if isinstance(keys, str) else keys, "left")
