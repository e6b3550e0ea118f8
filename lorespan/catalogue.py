"""Every query of the engine's own operators, by key, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespan.adapters import Tables
from lorespan.plans import analytics, graphs, indexing, memory, relational, retrieval, sql_surface  # noqa: F401  (they register)
from lorespan.plans.registry import ENTRIES, runner


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES["capsule_sections"][0](Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(f) for name, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
