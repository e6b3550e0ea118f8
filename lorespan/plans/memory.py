"""Annotations, versions and signals over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan import streaming
from lorespan.adapters import EPOCH, Tables
from lorespan.operators import memory as m
from lorespan.plans.registry import query

C = F.col
_COLUMNS = ("id", "anchor_type", "anchor_value", "text", "quality", "content_hash")
#: Turns of one conversation with one anchor say the same here, so that repeats occur.
_HASH = "sha256(coalesce(anchor_type, '') || '|' || coalesce(anchor_value, '') || '|' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))"
_NOTES = f" , x AS (SELECT id, anchor_type, anchor_value, 'say  ' || upper(kind) AS text, quality, updated_at FROM notes), h AS (SELECT *, {_HASH} AS content_hash FROM x)"


def _hashed(t: Tables) -> DataFrame:
    said = F.concat(F.lit("say  "), F.upper("kind"))
    return m.with_hash(t.notes.select("id", "anchor_type", "anchor_value", said.alias("text"), "quality", "updated_at"))


@query(_NOTES + """ , old AS (SELECT * FROM h WHERE updated_at % 1200 = 0), new AS (SELECT * FROM h WHERE updated_at % 1200 <> 0), known AS (SELECT content_hash, min(id) AS kid FROM old GROUP BY 1),
n AS (SELECT new.*, kid, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS r FROM new LEFT JOIN known USING (content_hash)), bumps AS (SELECT content_hash, count(*) AS c FROM n WHERE kid IS NOT NULL OR r > 1 GROUP BY 1),
allr AS (SELECT id, quality, content_hash FROM old UNION ALL SELECT id, quality, content_hash FROM n WHERE kid IS NULL AND r = 1)
SELECT id, round(least(1, quality + 0.1 * CASE WHEN kid IS NULL OR kid = id THEN coalesce(c, 0) ELSE 0 END)::DOUBLE, 6) AS quality FROM allr LEFT JOIN known USING (content_hash) LEFT JOIN bumps USING (content_hash)""", "notes")
def note_upsert_dedup(t: Tables) -> DataFrame:
    h = _hashed(t).withColumn("arrived", C("id"))
    out = m.upsert_notes(h.filter("updated_at % 1200 = 0").drop("arrived"), h.filter("updated_at % 1200 <> 0"), "arrived")
    return out.select("id", F.round("quality", 6).alias("quality"))


@query(" SELECT id, round(quality * 0.9, 6) AS quality FROM notes", "notes")
def quality_decay(t: Tables) -> DataFrame:
    return m.decay(t.notes).select("id", F.round("quality", 6).alias("quality"))


@query(""" SELECT id, stale OR (anchor_type = 'node' AND anchor_value IN (SELECT key FROM nodes WHERE seq % 3 = 0)) IS TRUE OR (anchor_type = 'file' AND updated_at < (SELECT max(timestamp) FROM sessions WHERE event_type = 'edit' AND file_path = anchor_value)) IS TRUE AS stale FROM notes""", "nodes sessions notes")
def staleness(t: Tables) -> DataFrame:
    nodes = t.nodes.select("key", F.lit("a").alias("old_sum"), F.when(C("seq") % 3 == 0, "b").otherwise("a").alias("new_sum"))
    files = t.sessions.filter("event_type = 'edit'").select(C("file_path").alias("file"), C("timestamp").alias("mtime"))
    return m.mark_stale(t.notes, nodes, files).select("id", "stale")


@query(" SELECT id, retrieval_count + CASE WHEN quality > 0.5 THEN 1 ELSE 0 END + CASE WHEN kind = 'pitfall' THEN 1 ELSE 0 END AS retrieval_count FROM notes", "notes")
def retrieval_counts(t: Tables) -> DataFrame:
    hits = t.notes.filter("quality > 0.5").select("id").unionByName(t.notes.filter("kind = 'pitfall'").select("id"))
    return m.retrieved(t.notes, hits).select("id", "retrieval_count")


_AS_OF = EPOCH + 20 * 86400


@query(f" SELECT event_id FROM sessions WHERE timestamp >= {_AS_OF} - 172800", "sessions")
def ttl_prune(t: Tables) -> DataFrame:
    return m.pruned(t.sessions, "timestamp", _AS_OF).select("event_id")


_SIGNALS = """ , sig AS (SELECT session_id, timestamp, ['THRASHING', 'EMPTY_CAPSULE', 'FAILED_SEARCH', 'CHURN', 'HOTSPOT', 'LARGE_BLAST_RADIUS', 'DEAD_END'][k % 7 + 1] AS kind FROM sessions WHERE event_type = 'miss')"""


def _signals(t: Tables) -> DataFrame:
    kinds = F.array(*map(F.lit, ("THRASHING", "EMPTY_CAPSULE", "FAILED_SEARCH", "CHURN", "HOTSPOT", "LARGE_BLAST_RADIUS", "DEAD_END")))
    return t.sessions.filter("event_type = 'miss'").select("session_id", "timestamp", F.element_at(kinds, (C("k") % 7 + 1).cast("int")).alias("kind"))


@query(_SIGNALS + f" SELECT kind, count(*) AS n FROM sig WHERE kind <> 'DEAD_END' AND timestamp >= {_AS_OF} - 172800 GROUP BY 1", "sessions")
def active_signals(t: Tables) -> DataFrame:
    return m.pruned(m.valid_signals(_signals(t)), "timestamp", _AS_OF).groupBy("kind").agg(F.count("*").alias("n"))


@query(""" , mt AS (SELECT key AS old_id, 'new' || key AS new_id FROM nodes WHERE kind = 'Function' AND seq % 2 = 0), og AS (SELECT key FROM nodes WHERE kind = 'Function' AND seq % 3 = 0)
SELECT id, coalesce(new_id, anchor_value) AS anchor_value, CASE WHEN new_id IS NOT NULL THEN false ELSE stale OR og.key IS NOT NULL END AS stale FROM notes LEFT JOIN mt ON anchor_type = 'node' AND anchor_value = old_id LEFT JOIN og ON anchor_type = 'node' AND anchor_value = og.key""", "nodes notes")
def anchor_migration(t: Tables) -> DataFrame:
    functions = t.nodes.filter("kind = 'Function'")
    matches = functions.filter("seq % 2 = 0").select(C("key").alias("old_id"), F.concat(F.lit("new"), "key").alias("new_id"))
    return m.migrate(t.notes, matches, functions.filter("seq % 3 = 0").select(C("key").alias("id"))).select("id", "anchor_value", "stale")


@query(" , c AS (SELECT id, quality FROM notes WHERE quality < 0.6), p AS (SELECT id, quality + 1 AS quality FROM notes WHERE quality > 0.4) SELECT id, round(quality, 6) AS quality FROM c UNION ALL SELECT id, round(quality, 6) FROM p WHERE id NOT IN (SELECT id FROM c)", "notes")
def fork_notes(t: Tables) -> DataFrame:
    n = t.notes.select("id", "quality")
    out = m.fork(n.filter("quality > 0.4").withColumn("quality", C("quality") + 1), n.filter("quality < 0.6"))
    return out.select("id", F.round("quality", 6).alias("quality"))


@query(_NOTES + """ , tgt AS (SELECT * FROM h WHERE quality < 0.5), src AS (SELECT CASE WHEN updated_at % 1200 = 0 THEN id ELSE (SELECT min(id) FROM tgt) END AS id, anchor_type, anchor_value, text, quality, CASE WHEN quality > 0.9 THEN NULL ELSE content_hash END AS content_hash FROM h WHERE quality >= 0.5),
fr AS (SELECT * FROM src s WHERE CASE WHEN content_hash IS NOT NULL THEN content_hash NOT IN (SELECT content_hash FROM tgt) ELSE NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.anchor_type IS NOT DISTINCT FROM s.anchor_type AND tgt.anchor_value IS NOT DISTINCT FROM s.anchor_value AND tgt.text = s.text) END AND (anchor_type IS DISTINCT FROM 'node' OR anchor_value IN (SELECT key FROM nodes)))
SELECT id, text FROM tgt UNION ALL SELECT CASE WHEN id IN (SELECT id FROM tgt) THEN md5(concat_ws('|', id, anchor_value, text)) ELSE id END, text FROM fr""", "nodes notes")
def merge_notes(t: Tables) -> DataFrame:
    h = _hashed(t)
    target = h.filter("quality < 0.5").select(*_COLUMNS)
    least = target.agg(F.min("id").alias("least"))
    source = h.filter("quality >= 0.5").crossJoin(F.broadcast(least))  # one row
    source = source.select(F.when(C("updated_at") % 1200 == 0, C("id")).otherwise(C("least")).alias("id"), "anchor_type", "anchor_value", "text", "quality", F.when(C("quality") > 0.9, F.lit(None).cast("string")).otherwise(C("content_hash")).alias("content_hash"))
    return m.merge(source, target, t.nodes.select("key")).select("id", "text")


@query(_SIGNALS + f""" , st AS (SELECT array_to_string(list_sort(list(id)), ',') AS stale_notes FROM (SELECT id FROM notes WHERE stale ORDER BY id LIMIT 20)), rc AS (SELECT session_id, event_type, timestamp, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, event_id DESC) AS r FROM sessions),
ac AS (SELECT session_id, count(*) AS n FROM sig WHERE timestamp >= {_AS_OF} - 172800 GROUP BY 1), tot AS (SELECT session_id, count(*) AS total_events, count(DISTINCT file_path) AS unique_files, count(DISTINCT symbol) AS unique_symbols FROM sessions GROUP BY 1), ev AS (SELECT session_id, string_agg(event_type, ',' ORDER BY r) AS recent FROM rc WHERE r <= 20 GROUP BY 1)
SELECT session_id, total_events, unique_files, unique_symbols, recent, coalesce(n, 0) AS active_signals, stale_notes FROM tot JOIN ev USING (session_id) LEFT JOIN ac USING (session_id), st""", "sessions notes")
def session_start_document(t: Tables) -> DataFrame:
    out = m.session_document(t.sessions, _signals(t), t.notes, _AS_OF)
    recent = F.array_join(F.transform("recent_events", lambda x: x["event_type"]), ",")
    return out.select("session_id", "total_events", "unique_files", "unique_symbols", recent.alias("recent"), "active_signals", F.array_join("stale_notes", ",").alias("stale_notes"))


_RELATIONS = """ , rel AS (SELECT id AS from_id, lead(id) OVER (ORDER BY id) AS to_id, kind AS relation, quality AS weight, created_at FROM notes QUALIFY to_id IS NOT NULL),
a AS (SELECT * FROM rel WHERE weight < 0.6), b AS (SELECT CASE WHEN from_id = 'a1_0' THEN 'new' ELSE from_id END AS from_id, CASE WHEN to_id = 'a1_0' THEN 'new' ELSE to_id END AS to_id, relation, weight, created_at - 5 AS created_at FROM rel WHERE weight > 0.4)"""


def _relations(t: Tables) -> DataFrame:
    """Each note is related to the next one by id: a chain to test with, over few columns."""
    rows = t.notes.select(C("id").alias("from_id"), C("kind").alias("relation"), C("quality").alias("weight"), "created_at")
    later = F.lead("from_id").over(Window.orderBy("from_id"))  # a fixture
    return rows.withColumn("to_id", later).filter("to_id is not null").select("from_id", "to_id", "relation", "weight", "created_at")


@query(_RELATIONS + """ , own AS (SELECT id FROM notes WHERE quality > 0.1 UNION ALL SELECT 'new')
SELECT from_id, to_id, relation, round(sum(weight), 6) AS weight, min(created_at) AS created_at FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE from_id IN (SELECT id FROM own) AND to_id IN (SELECT id FROM own)) GROUP BY 1, 2, 3""", "notes")
def merge_note_edges(t: Tables) -> DataFrame:
    rel = _relations(t)
    renamed = t.spark.sql("select * from values ('a1_0', 'new') as r(old_id, new_id)")
    own = t.notes.filter("quality > 0.1").select("id").unionByName(renamed.select(C("new_id").alias("id")))
    out = m.merge_edges(rel.filter("weight > 0.4").withColumn("created_at", C("created_at") - 5), rel.filter("weight < 0.6"), own, renamed)
    return out.withColumn("weight", F.round("weight", 6)).select("from_id", "to_id", "relation", "weight", "created_at")


@query(f" SELECT id FROM notes WHERE NOT coalesce(anchor_type = 'node' AND stale AND updated_at < {_AS_OF} - 2592000 AND anchor_value NOT IN (SELECT key FROM nodes WHERE seq % 2 = 0), false)", "nodes notes")
def orphan_notes_deleted(t: Tables) -> DataFrame:
    return m.without_orphans(t.notes, t.nodes.filter("seq % 2 = 0").select("key"), _AS_OF).select("id")


@query(""" , ch AS (SELECT key, signature FROM nodes WHERE key IN ('c11', 'c17', 's3', 'n4', 'r0')), ej AS (SELECT from_key AS key, to_json(list({'to': to_key, 'kind': kind} ORDER BY to_key, kind))::VARCHAR AS edges_json FROM links WHERE from_key IN (SELECT key FROM ch) GROUP BY 1),
v AS (SELECT * FROM versions WHERE symbol_hash IN ('c11', 'c17', 'c20')), al AS (SELECT * FROM v UNION ALL SELECT key, coalesce((SELECT max(version_num) FROM v WHERE symbol_hash = key), 0) + 1, signature, coalesce(edges_json, '[]') FROM ch LEFT JOIN ej USING (key))
SELECT symbol_hash, version_num, signature, edges_json FROM al QUALIFY row_number() OVER (PARTITION BY symbol_hash ORDER BY version_num DESC) <= 5""", "nodes links versions")
def version_append(t: Tables) -> DataFrame:
    changed = t.nodes.filter(C("key").isin("c11", "c17", "s3", "n4", "r0")).select(C("key").alias("symbol_hash"), "key", "signature")
    old = t.versions.filter(C("symbol_hash").isin("c11", "c17", "c20"))
    return m.append_versions(old, changed, t.edges).withColumn("version_num", C("version_num").cast("long"))


@query(""" SELECT event_id, session_id, previous FROM (SELECT *, lag(session_id) OVER (PARTITION BY file_path ORDER BY timestamp, session_id) AS previous FROM (SELECT min(event_id) AS event_id, session_id, file_path, timestamp FROM sessions GROUP BY ALL)) WHERE session_id IS DISTINCT FROM previous""", "sessions")
def session_switches(t: Tables) -> DataFrame:
    """A file stands for a client here; requests of one second and session are one."""
    rows = t.sessions.groupBy("session_id", "file_path", C("timestamp").alias("at")).agg(F.min("event_id").alias("event_id"))
    return streaming.session_switches(rows, "file_path").select("event_id", "session_id", "previous")
