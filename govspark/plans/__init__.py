"""Named queries over the star schema, each with an equivalent in plain SQL."""

from __future__ import annotations

from govspark.plans.base import ORACLE, QUERIES

from govspark.plans import access, analytics, detection, guard, retrieval, series, sources, streams  # noqa: E402,F401

__all__ = ["ORACLE", "QUERIES"]
