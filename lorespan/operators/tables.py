"""Keyed tables: upserts, deletes, lookups and freshness, as whole-set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last writer wins: rows of ``new`` replace those of ``old``; among equals the highest ``order`` stays."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc(), order.desc()))
    return rows.withColumn("_best", best).filter("_best = 1").drop("_best", "_new")


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], weight: str, created: str) -> DataFrame:
    """Weights add up; the first creation time stays."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(weight).alias(weight), F.min(created).alias(created))


def delete_matching(rows: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """rows without those whose key is in ``gone``."""
    condition = [F.col(f"r.{a}") == F.col(f"g.{b}") for a, b in on.items()]
    return rows.alias("r").join(gone.alias("g"), condition, "left_anti")


def valid_edges(edges: DataFrame, nodes: DataFrame, start: str = "from_key", end: str = "to_key", key: str = "key") -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select(F.col(key).alias("_k"))
    return edges.join(ids, edges[start] == ids["_k"], "left_semi").join(ids, edges[end] == ids["_k"], "left_semi")


def stale_files(found: DataFrame, indexed: DataFrame, strict: bool = True) -> DataFrame:
    """Files to index: unknown, or newer than their last indexing and of another content.

    ``strict``: a file indexed in the very second of its change counts as changed.
    """
    f, x = found.alias("f"), indexed.alias("x")
    fresh = F.col("x.last_indexed") > F.col("f.mtime") if strict else F.col("x.last_indexed") >= F.col("f.mtime")
    same = F.col("f.content_hash").eqNullSafe(F.col("x.content_hash"))
    known = F.col("x.file_path").isNotNull()
    return f.join(x, "file_path", "left").filter(~known | (~F.coalesce(fresh, F.lit(False)) & ~same)).select("file_path", "f.content_hash", "f.mtime")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark limits each map task's groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def estimates(calls: DataFrame, files: DataFrame, ends: DataFrame) -> DataFrame:
    """calls (call_id, tool, file_path) with ``tokens``: what would be read without an index.

    A capsule stands for its file and all files next to it (ends: from_file, to_file), a search of documents for all
    documents, reading notes for their file, anything else for nothing. Unknown and null files count as empty. files:
    file_path, file_type, raw_token_estimate.
    """
    c, none = F.col, F.lit(0).cast("long")
    asked = calls.filter("tool = 'get_capsule'").select("file_path").distinct()
    apart = ends.filter("from_file <> to_file")
    ways = [apart.select(c(a).alias("file_path"), c(b).alias("_other")).join(asked, "file_path", "left_semi") for a, b in (("from_file", "to_file"), ("to_file", "from_file"))]
    sizes = files.select("file_path", c("raw_token_estimate").cast("long").alias("_own"))
    near = ways[0].union(ways[1]).distinct().join(sizes.withColumnRenamed("file_path", "_other").withColumnRenamed("_own", "_size"), "_other")
    near = near.groupBy("file_path").agg(F.sum("_size").alias("_near"))
    documents = files.filter("file_type = 'doc'").agg(F.coalesce(F.sum("raw_token_estimate").cast("long"), none).alias("_documents"))  # one row
    own, around = F.coalesce("_own", none), F.coalesce("_near", none)
    tokens = F.when(c("tool") == "get_capsule", own + around).when(c("tool") == "search_docs", c("_documents")).when(c("tool") == "read_annotations", own).otherwise(none)
    out = calls.join(sizes, "file_path", "left").join(near, "file_path", "left").crossJoin(F.broadcast(documents))
    return out.select(*calls.columns, tokens.alias("tokens"))
