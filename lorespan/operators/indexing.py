"""Building and renewing the symbol tables from source files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan.operators import extract, graph, memory, tables
from lorespan.operators.storage import cut

C = F.col


@dataclass
class Index:
    """nodes, raw edges (from_id, to_name), resolved edges, file inventory."""

    nodes: DataFrame
    raw: DataFrame
    edges: DataFrame
    files: DataFrame


def inventory(files: DataFrame) -> DataFrame:
    """files (file_path, content, mtime): file_path, file_type, raw_token_estimate, last_indexed, content_hash."""
    return files.select("file_path", fn.route(C("file_path")).alias("file_type"), fn.token_estimate(C("content")).alias("raw_token_estimate"), C("mtime").alias("last_indexed"), F.md5("content").alias("content_hash"))


def ranked(nodes: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """nodes with their rank as ``centrality``."""
    links = edges.select(C("from_id").alias("src"), C("to_id").alias("dst"))
    rank = graph.pagerank(links, nodes.select(C("id").alias("node")), rounds=rounds)
    return nodes.drop("centrality").join(rank.select(C("node").alias("id"), C("rank").alias("centrality")), "id")


def bulk_index(files: DataFrame, rounds: int = 30) -> Index:
    """The index of files (file_path, content, mtime)."""
    nodes, raw = extract.index(files)
    nodes, raw = cut(nodes), cut(raw)
    edges = cut(extract.resolved(raw, nodes))
    return Index(ranked(nodes, edges, rounds), raw, edges, inventory(files))


@dataclass
class Changes:
    """What files that were seen change of an index: rows that go (by the key named) and rows that come, and the moved notes.

    Edges of a caller come anew wherever a name that it calls was in a changed file or is now.
    """

    paths: DataFrame
    gone_ids: DataFrame
    nodes: DataFrame
    raw: DataFrame
    callers: DataFrame
    edges: DataFrame
    files: DataFrame
    notes: DataFrame


def changes(old: Index, files: DataFrame, notes: DataFrame) -> Changes:
    """What files (file_path, content, mtime) change of an index, none of it bigger than they and their callers.

    Files not newer than their last indexing, or of unchanged content, are left alone. Symbols of changed files
    are replaced; a symbol that is gone is matched to the most similar new one of its file, notes follow, and
    notes on unmatched symbols go stale. Raw edges are the table of record: edges into a changed file from
    others are resolved again, and so come back with their symbol.
    """
    found = files.withColumn("content_hash", F.md5("content"))
    todo = tables.stale_files(found.select("file_path", "mtime", "content_hash"), old.files).select("file_path")
    changed = cut(files.join(todo, "file_path", "left_semi"))
    paths = changed.select("file_path")
    new_nodes, new_raw = extract.index(changed)
    new_nodes, new_raw = cut(new_nodes), cut(new_raw)
    before = cut(old.nodes.join(paths, "file_path", "left_semi"))
    gone_ids = before.select("id")
    orphans = before.join(new_nodes.select("id"), "id", "left_anti")
    fresh = new_nodes.join(gone_ids, "id", "left_anti")

    def side(rows: DataFrame, raw: DataFrame, name: str) -> DataFrame:
        near = raw.groupBy(C("from_id").alias("id")).agg(F.collect_set("to_name").alias("near"))
        rows = rows.join(near, "id", "left")
        return rows.select("file_path", C("id").alias(f"{name}_id"), C("name").alias(f"{name}_name"), C("signature").alias(f"{name}_signature"), C("checksum").alias(f"{name}_checksum"), F.coalesce("near", F.array().cast("array<string>")).alias(f"{name}_neighbours"))

    own_raw = old.raw.join(orphans.select(C("id").alias("from_id")), "from_id", "left_semi")
    matches = graph.matched_symbols(cut(side(orphans, own_raw, "old")), cut(side(fresh, new_raw, "new")), ["file_path"], F.lit(1.0))
    moved = memory.migrate(notes, matches.select("old_id", "new_id"), orphans.select("id"))

    names = before.select("name").unionByName(new_nodes.select("name")).distinct()
    live = old.raw.join(gone_ids.select(C("id").alias("from_id")), "from_id", "left_anti")
    outside = live.join(names.select(C("name").alias("to_name")), "to_name", "left_semi").select("from_id").distinct()
    callers = cut(outside.unionByName(gone_ids.select(C("id").alias("from_id"))).unionByName(new_raw.select("from_id")).distinct())
    touched = live.join(callers, "from_id", "left_semi").unionByName(new_raw.select(*live.columns))
    kept = old.nodes.join(paths, "file_path", "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    meant = kept.join(touched.select(C("to_name").alias("name")).distinct(), "name", "left_semi")
    return Changes(paths, gone_ids, new_nodes, new_raw, callers, cut(extract.resolved(touched, meant)), inventory(changed), moved)


def reindex(old: Index, files: DataFrame, notes: DataFrame, rounds: int = 30) -> tuple[Index, DataFrame]:
    """The whole index after files (file_path, content, mtime) were seen, and the notes moved along; cases as in ``changes``."""
    new = changes(old, files, notes)
    kept = old.nodes.join(new.paths, "file_path", "left_anti").drop("centrality")
    nodes = cut(kept.unionByName(new.nodes, allowMissingColumns=True))
    raw = cut(old.raw.join(new.gone_ids.select(C("id").alias("from_id")), "from_id", "left_anti").unionByName(new.raw))
    edges = cut(old.edges.join(new.callers, "from_id", "left_anti").unionByName(new.edges))
    seen = tables.upsert(old.files, new.files, ["file_path"], C("last_indexed"))
    return Index(ranked(nodes, edges, rounds), raw, edges, seen), new.notes
