"""Queries by key, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespan.adapters import Tables, with_views

ENTRIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None, views: str = "", recursive: bool = False):
    """Registers a function of Tables under its name. ``views`` names the common table expressions sql needs.

    sql may begin with further expressions (``, x AS (...)``) if views are named.
    """

    def put(f: Callable[[Tables], DataFrame]):
        text = None if sql is None else (with_views(views, recursive) + sql if views else sql)
        ENTRIES[f.__name__] = f, text
        return f

    return put


def runner(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))
