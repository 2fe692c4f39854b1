"""All queries of the library with their oracle SQL, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import audits, boundaries, chapters, clusters, delays, documents, edits, events, files, filters, frames, grids, layouts, lexicon, reports, signals, spectra, timeline, tracks  # noqa: F401  they register their queries
from tidemark.plans.registry import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query functions by name."""
    return {name: entry.build for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    """Oracle SQL by query name, for those that have one."""
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}
