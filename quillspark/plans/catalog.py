"""Registry that feeds ``__spark_entry__``: one entry per query, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import drawings, phrases, quotes, records, stores, texts  # noqa: F401  they register their queries
from quillspark.plans.registry import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}
