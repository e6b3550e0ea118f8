"""Columns of the engine's tables, as Spark DDL; the lists are the contract of every reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 4

TABLES = {
    "nodes": "id string, kind string, name string, file_path string, line_start int, line_end int, signature string, signature_hash string, docstring string, skeleton string, centrality double, checksum binary",
    "edges": "from_id string, to_id string, kind string, weight double, confidence string",
    "raw_edges": "from_id string, to_name string",
    "ranks": "id string, weight double",
    "postings": "term string, block long, n long, most int, least int, docs array<struct<id:string,len:int,f:int,at:array<int>>>",
    "indexed": "id string, block long, len int, blocks int",
    "files": "file_path string, file_type string, raw_token_estimate int, last_indexed long, content_hash string",
    "node_versions": "symbol_hash string, version_num int, file_path string, session_id string, node_kind string, signature string, signature_hash string, edges_json string, body_hash binary, created_at long",
    "annotations": "id string, anchor_type string, anchor_value string, text string, tags string, stale boolean, created_at long, updated_at long, kind string, content_hash string, quality double, retrieval_count long",
    "annotation_edges": "from_id string, to_id string, relation string, weight double, created_at long",
    "behavioral_signals": "kind string, node_id string, file_path string, session_id string, timestamp long, detail string",
    "session_log": "session_id string, event_type string, file_path string, symbol string, timestamp long",
    "doc_chunks": "file_path string, chunk_index int, heading string, start_line int, end_line int, content string, token_estimate int, last_indexed long, content_hash string",
    "daemon_meta": "key string, value string",
    "federated_repos": "path string, added_at long, last_seen long",
    "token_log": "timestamp long, session_id string, branch string, tool_name string, query string, intent string, tokens_actual int, tokens_estimated int, files_touched string",
    "metrics_snapshots": "timestamp long, json_blob string",
    "capsule_log": "capsule_id string, timestamp long, session_id string, file string, symbol string, intent string, tokens_served int, items_included int, sections string, total_us long",
}
#: Tables of one branch, which a new branch begins with.
BRANCH_TABLES = ("nodes", "edges", "raw_edges", "ranks", "postings", "indexed", "files", "node_versions", "annotations", "annotation_edges", "doc_chunks")
#: The vocabularies of the data model.
NODE_KINDS = ("File", "Module", "ExportedVar", "Function", "Class", "Interface", "Type", "Enum", "Method")
EDGE_KINDS = ("Imports", "Calls", "TypeRef", "Extends", "Implements", "Exports", "Contains")
INTENTS = ("debug", "refactor", "understand", "extend", "review")
ANNOTATION_KINDS = ("fact", "strategy", "pitfall", "context")
IMPROVEMENT_SIGNALS = ("THRASHING", "EMPTY_CAPSULE", "FAILED_SEARCH")
INSIGHT_SIGNALS = ("CHURN", "HOTSPOT", "LARGE_BLAST_RADIUS")
#: Defaults of columns that later versions added.
DEFAULTS = {"annotations": {"kind": "fact", "quality": 0.5, "retrieval_count": 0}, "edges": {"weight": 1.0, "confidence": "precise"}, "nodes": {"centrality": 0.0}}


def conform(rows: DataFrame, table: str, version: int = VERSION) -> DataFrame:
    """rows in the table's column order and types; absent columns get their default or null.

    Raises ValueError for rows of a newer schema version.
    """
    if version > VERSION:
        raise ValueError(f"{table} has schema version {version}; this engine knows {VERSION}")
    out, own = [], {c.lower() for c in rows.columns}
    for part in TABLES[table].split(", "):
        name, kind = part.split(" ")
        default = F.lit(DEFAULTS.get(table, {}).get(name))
        value = F.col(name) if name in own else default
        out.append(value.cast(kind).alias(name))
    return rows.select(*out)
