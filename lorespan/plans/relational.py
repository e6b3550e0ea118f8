"""Scans, upserts, filters, joins, top-k and set operations over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan.adapters import Tables
from lorespan.operators import tables as ops
from lorespan.plans.registry import query

C = F.col
_EXTENSIONS = ", ".join(f"('{e}', '{name}')" for name, endings in fn.LANGUAGES.items() for e in endings)


@query(" SELECT file_type, count(*) AS n_files, sum(raw_token_estimate)::BIGINT AS tokens, count(DISTINCT content_hash) AS contents FROM files GROUP BY 1", "files")
def file_inventory_tokens(t: Tables) -> DataFrame:
    return t.files.groupBy("file_type").agg(F.count("*").alias("n_files"), F.sum("raw_token_estimate").alias("tokens"), F.countDistinct("content_hash").alias("contents"))


@query(f"""
WITH endings(ext, language) AS (VALUES {_EXTENSIONS}),
paths AS (SELECT page_id, 'src/' || page_id || '.' || ['rs','py','tsx','md','hxx','txt','mjs','markdown','sh'][page_id % 9 + 1] AS path FROM pages)
SELECT p.page_id, e.language, CASE WHEN regexp_matches(p.path, '\\.(md|markdown)$') THEN 'doc' WHEN e.language IS NOT NULL THEN 'code' ELSE 'skip' END AS route
FROM paths p LEFT JOIN endings e ON e.ext = regexp_extract(p.path, '\\.([^.]+)$', 1)""")
def ext_language_routing(t: Tables) -> DataFrame:
    endings = F.array(*map(F.lit, ("rs", "py", "tsx", "md", "hxx", "txt", "mjs", "markdown", "sh")))
    path = F.concat(F.lit("src/"), C("page_id").cast("string"), F.lit("."), F.element_at(endings, (C("page_id") % 9 + 1).cast("int")))
    return t.raw("pages").select("page_id", fn.language(path).alias("language"), fn.route(path).alias("route"))


@query(" SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, min(k) AS lo, max(k) AS hi FROM sessions GROUP BY 1", "sessions")
def props_json_scan(t: Tables) -> DataFrame:
    parsed = t.raw("events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    kinds = {"view": "read", "click": "grep", "purchase": "edit", "error": "miss", "signup": "start"}
    kind = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), C("event_type"))
    k = C("p.k")
    return parsed.groupBy(kind.alias("event_type")).agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.min(k).alias("lo"), F.max(k).alias("hi"))


@query(""" SELECT session_id, event_type, event_id, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, event_type ORDER BY (event_id % 2) DESC, event_id DESC) AS r FROM sessions) WHERE r = 1""", "sessions")
def upsert_last_writer(t: Tables) -> DataFrame:
    s = t.sessions.select("session_id", "event_type", "event_id", "value")
    out = ops.upsert(s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1"), ["session_id", "event_type"], C("event_id"))
    return out.select("session_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("SELECT 's' || l_suppkey AS from_id, 'p' || l_partkey AS to_id, count(*)::DOUBLE AS weight, min(l_orderkey) AS created_at FROM lineitem GROUP BY 1, 2")
def upsert_accumulate_weight(t: Tables) -> DataFrame:
    pairs = t.raw("lineitem").select(F.concat(F.lit("s"), C("l_suppkey").cast("string")).alias("from_id"), F.concat(F.lit("p"), C("l_partkey").cast("string")).alias("to_id"), F.lit(1.0).alias("weight"), C("l_orderkey").alias("created_at"))
    return ops.accumulate(pairs.filter("created_at % 2 = 0"), pairs.filter("created_at % 2 = 1"), ["from_id", "to_id"], "weight", "created_at")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def delete_by_file_anti(t: Tables) -> DataFrame:
    return ops.delete_matching(t.raw("documents"), t.raw("labels"), {"doc_id": "doc_id"}).select("doc_id", "lang")


@query(""" SELECT kind, count(*) AS n, sum(weight) AS weight FROM links WHERE from_key IN (SELECT key FROM nodes WHERE kind <> 'Function') AND to_key IN (SELECT key FROM nodes WHERE kind <> 'Function') GROUP BY 1""", "nodes links")
def load_graph_valid_edges(t: Tables) -> DataFrame:
    """A table of nodes without functions: edges that lead to or from one are dropped."""
    return ops.valid_edges(t.links, t.nodes.filter("kind <> 'Function'")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(" SELECT key, id, signature_hash FROM nodes", "nodes")
def node_identity_hash(t: Tables) -> DataFrame:
    return t.nodes.select("key", "id", "signature_hash")


@query("""SELECT p_partkey, joined AS words FROM (
  SELECT p_partkey, CASE WHEN len(parts) > 1 THEN name || ' ' || array_to_string(parts, ' ') ELSE name END AS joined FROM (
    SELECT *, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS parts FROM (
      SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN 'get' || p_type || 'By' || p_brand ELSE split_part(p_name, ' ', 1) END AS name FROM part)))""")
def identifier_split(t: Tables) -> DataFrame:
    name = F.when(C("p_partkey") % 3 == 0, F.replace(C("p_name"), F.lit(" "), F.lit("_"))).when(C("p_partkey") % 3 == 1, F.concat(F.lit("get"), C("p_type"), F.lit("By"), C("p_brand"))).otherwise(F.split_part(C("p_name"), F.lit(" "), F.lit(1)))
    return t.raw("part").select("p_partkey", fn.identifier_words(name).alias("words"))


@query(" SELECT id, quality FROM notes WHERE anchor_type = 'file' AND anchor_value = 'f7'", "notes")
def anchor_lookup(t: Tables) -> DataFrame:
    return t.notes.filter((C("anchor_type") == "file") & (C("anchor_value") == "f7")).select("id", "quality")


@query(" SELECT id, updated_at FROM notes WHERE anchor_type IS NULL OR anchor_type = 'project'", "notes")
def project_notes(t: Tables) -> DataFrame:
    return t.notes.filter(C("anchor_type").isNull() | (C("anchor_type") == "project")).select("id", "updated_at")


@query(" SELECT id, quality, retrieval_count FROM notes WHERE quality < 0.3 AND retrieval_count >= 10", "notes")
def low_quality_notes(t: Tables) -> DataFrame:
    return t.notes.filter("quality < 0.3 and retrieval_count >= 10").select("id", "quality", "retrieval_count")


@query(" SELECT file_path, file_type FROM files WHERE file_path ILIKE '%7.MD' ORDER BY file_path LIMIT 10", "files")
def suffix_like_chunks(t: Tables) -> DataFrame:
    return t.files.filter(C("file_path").ilike("%7.MD")).orderBy("file_path").limit(10).select("file_path", "file_type")


@query(""" , requests(file, symbol) AS (VALUES ('nation/3', 'Supplier#000000007'), ('segment/building', NULL), ('part/Brand_12.go', 'red widget'), ('nowhere', 'x'), ('nation/', 'Supplier#000000011'))
SELECT file, symbol, arg_min(key, seq) AS key, min(seq) AS seq FROM requests r JOIN nodes n ON (r.symbol IS NOT NULL AND n.name = r.symbol AND contains(n.file_path, r.file)) OR (r.symbol IS NULL AND (ends_with(n.file_path, r.file) OR ends_with(n.file_path, r.file || '.py')))
GROUP BY ALL""", "nodes")
def resolve_target(t: Tables) -> DataFrame:
    asked = t.spark.sql("select * from values ('nation/3', 'Supplier#000000007'), ('segment/building', null), ('part/Brand_12.go', 'red widget'), ('nowhere', 'x'), ('nation/', 'Supplier#000000011') as r(file, symbol)")
    named = t.nodes.join(F.broadcast(asked.filter("symbol is not null")), (C("name") == C("symbol")) & C("file_path").contains(C("file")))
    whole = t.nodes.join(F.broadcast(asked.filter("symbol is null")), C("file_path").endswith(C("file")) | C("file_path").endswith(F.concat("file", F.lit(".py"))))
    return named.unionByName(whole).groupBy("file", "symbol").agg(F.min_by("key", "seq").alias("key"), F.min("seq").alias("seq"))


@query(""" SELECT DISTINCT file_path FROM nodes JOIN (VALUES ('nation/1'), ('part/Brand_2')) p(prefix) ON starts_with(file_path, prefix) OR contains(file_path, prefix)""", "nodes")
def resolve_scope(t: Tables) -> DataFrame:
    scopes = t.spark.sql("select * from values ('nation/1'), ('part/Brand_2') as p(prefix)")
    return t.nodes.join(F.broadcast(scopes), C("file_path").contains(C("prefix"))).select("file_path").distinct()


@query(" SELECT key, regexp_matches(lower(p), 'test|spec') AS is_test FROM (SELECT key, CASE WHEN seq % 4 = 0 THEN '__tests__/' || file_path WHEN seq % 4 = 1 THEN replace(file_path, '.', '_Spec.') ELSE file_path END AS p FROM nodes)", "nodes")
def test_path_filter(t: Tables) -> DataFrame:
    path = F.when(C("seq") % 4 == 0, F.concat(F.lit("__tests__/"), C("file_path"))).when(C("seq") % 4 == 1, F.replace(C("file_path"), F.lit("."), F.lit("_Spec."))).otherwise(C("file_path"))
    return t.nodes.select("key", fn.is_test_path(path).alias("is_test"))


@query(" SELECT regexp_full_match(v, '[0-9a-fA-F]{32}') AS ok, count(*) AS n FROM (SELECT CASE WHEN seq % 2 = 0 THEN id ELSE key END AS v FROM nodes) GROUP BY 1", "nodes")
def hex_anchor_check(t: Tables) -> DataFrame:
    return t.nodes.select(fn.is_node_id(F.when(C("seq") % 2 == 0, C("id")).otherwise(C("key"))).alias("ok")).groupBy("ok").agg(F.count("*").alias("n"))


_SEEN = """WITH found AS (SELECT 'd' || doc_id AS file_path, doc_id * 10 AS mtime, md5(text) AS content_hash FROM documents),
indexed AS (SELECT 'd' || doc_id AS file_path, CASE WHEN doc_id % 3 = 0 THEN doc_id * 10 ELSE doc_id * 10 + doc_id % 3 - 2 END AS last_indexed, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(text) END AS content_hash FROM documents WHERE doc_id % 7 <> 0)
SELECT f.* FROM found f LEFT JOIN indexed x USING (file_path) WHERE x.file_path IS NULL OR (NOT x.last_indexed {0} f.mtime AND f.content_hash IS DISTINCT FROM x.content_hash)"""


def _seen(t: Tables) -> list[DataFrame]:
    """Files as found and as indexed."""
    d = t.raw("documents")
    path, digest = F.concat(F.lit("d"), C("doc_id").cast("string")).alias("file_path"), F.md5("text")
    found = d.select(path, (C("doc_id") * 10).alias("mtime"), digest.alias("content_hash"))
    at = F.when(C("doc_id") % 3 == 0, C("doc_id") * 10).otherwise(C("doc_id") * 10 + C("doc_id") % 3 - 2)
    return [found, d.filter("doc_id % 7 <> 0").select(path, at.alias("last_indexed"), F.when(C("doc_id") % 5 == 0, "old").otherwise(digest).alias("content_hash"))]


@query(_SEEN.format(">"))
def freshness_two_stage(t: Tables) -> DataFrame:
    return ops.stale_files(*_seen(t))


@query(_SEEN.format(">="))
def freshness_scan(t: Tables) -> DataFrame:
    """A file indexed in the second of its change is taken as fresh."""
    return ops.stale_files(*_seen(t), strict=False)


@query(""" SELECT a.file_path AS from_file, b.file_path AS to_file, count(*) AS n FROM links l JOIN nodes a ON a.key = l.from_key JOIN nodes b ON b.key = l.to_key WHERE a.file_path <> b.file_path GROUP BY 1, 2""", "nodes links")
def edge_endpoint_join(t: Tables) -> DataFrame:
    paths = t.nodes.select("key", "file_path")
    joined = t.links.join(paths.toDF("from_key", "from_file"), "from_key").join(paths.toDF("to_key", "to_file"), "to_key")
    return joined.filter("from_file <> to_file").groupBy("from_file", "to_file").agg(F.count("*").alias("n"))


@query(""" , ends AS (SELECT DISTINCT a.file_path AS x, b.file_path AS y FROM links l JOIN nodes a ON a.key = l.from_key JOIN nodes b ON b.key = l.to_key),
f AS (SELECT file_path, CASE WHEN file_path LIKE 'region/%' THEN 'doc' ELSE 'code' END AS file_type, sum(length(signature)) AS tokens FROM nodes GROUP BY 1),
near AS (SELECT x, sum(tokens) AS around FROM (SELECT x, y FROM ends WHERE x <> y UNION SELECT y, x FROM ends WHERE x <> y) JOIN f ON f.file_path = y GROUP BY 1),
calls AS (SELECT event_id AS call_id, CASE event_id % 4 WHEN 0 THEN 'get_capsule' WHEN 1 THEN 'search_docs' WHEN 2 THEN 'read_annotations' ELSE 'write_annotation' END AS tool, CASE WHEN event_id % 9 > 0 THEN 'nation/' || user_id % 30 || '.ts' END AS file_path FROM events)
SELECT call_id, tool, (CASE tool WHEN 'get_capsule' THEN coalesce(f.tokens, 0) + coalesce(around, 0) WHEN 'search_docs' THEN (SELECT coalesce(sum(tokens), 0) FROM f WHERE file_type = 'doc') WHEN 'read_annotations' THEN coalesce(f.tokens, 0) ELSE 0 END)::BIGINT AS tokens
FROM calls LEFT JOIN f USING (file_path) LEFT JOIN near ON near.x = calls.file_path""", "nodes links")
def estimates_without_index(t: Tables) -> DataFrame:
    """What each call would have read, by its tool; files are those of the graph."""
    own = t.nodes.select("key", "file_path")
    kind = F.when(C("file_path").startswith("region/"), "doc").otherwise("code")
    files = t.nodes.groupBy("file_path").agg(F.sum(F.length("signature")).alias("raw_token_estimate")).withColumn("file_type", kind)
    of = lambda key, name: own.select(C("key").alias(key), C("file_path").alias(name))
    ends = t.links.join(of("from_key", "from_file"), "from_key").join(of("to_key", "to_file"), "to_key").select("from_file", "to_file")
    tool = F.element_at(F.array(*map(F.lit, ("get_capsule", "search_docs", "read_annotations", "write_annotation"))), (C("event_id") % 4 + 1).cast("int"))
    path = F.when(C("event_id") % 9 > 0, F.concat(F.lit("nation/"), (C("user_id") % 30).cast("string"), F.lit(".ts")))
    calls = t.raw("events").select(C("event_id").alias("call_id"), tool.alias("tool"), path.alias("file_path"))
    return ops.estimates(calls, files, ends).select("call_id", "tool", "tokens")


@query(""" , ends AS (SELECT a.file_path AS x, b.file_path AS y FROM links l JOIN nodes a ON a.key = l.from_key JOIN nodes b ON b.key = l.to_key),
near AS (SELECT y AS file_path FROM ends WHERE x = 'nation/3.ts' AND y <> x UNION SELECT x FROM ends WHERE y = 'nation/3.ts' AND x <> y)
SELECT file_path, length(file_path) * 10 AS tokens FROM near""", "nodes links")
def neighbour_files_semi(t: Tables) -> DataFrame:
    own = t.nodes.select("key", "file_path")
    mine, others = own.filter("file_path = 'nation/3.ts'").select("key"), own.filter("file_path <> 'nation/3.ts'")
    out = t.links.join(mine, C("from_key") == C("key"), "left_semi").select(C("to_key").alias("key"))
    into = t.links.join(mine, C("to_key") == C("key"), "left_semi").select(C("from_key").alias("key"))
    return others.join(out.union(into), "key", "left_semi").select("file_path").distinct().withColumn("tokens", (F.length("file_path") * 10).cast("long"))


@query(" SELECT id, anchor_value FROM notes WHERE stale AND anchor_type = 'node' AND updated_at < 1704067200 + 2000000 AND anchor_value NOT IN (SELECT key FROM nodes)", "nodes notes")
def orphan_notes_anti(t: Tables) -> DataFrame:
    old = t.notes.filter("stale and anchor_type = 'node' and anchor_value is not null and updated_at < 1704067200 + 2000000")
    return old.join(t.nodes.select(C("key").alias("anchor_value")), "anchor_value", "left_anti").select("id", "anchor_value")


@query(" SELECT name, arg_max(id, seq) AS id, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def name_resolution_last_wins(t: Tables) -> DataFrame:
    return t.nodes.groupBy("name").agg(F.max_by("id", "seq").alias("id"), F.count("*").alias("n"))


@query(""" , asked AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || (p_partkey % 7) END AS name FROM part),
fresh AS (SELECT name, arg_max(id, seq) AS id FROM nodes WHERE seq % 2 = 0 GROUP BY 1), known AS (SELECT name, arg_min(id, seq) AS id FROM nodes GROUP BY 1)
SELECT a.name, coalesce(f.id, k.id, md5('<unresolved>' || chr(0) || a.name || chr(0) || a.name)) AS id, f.id IS NULL AND k.id IS NULL AS phantom FROM asked a LEFT JOIN fresh f USING (name) LEFT JOIN known k USING (name)""", "nodes")
def name_resolution_phantom(t: Tables) -> DataFrame:
    asked = t.raw("part").select(F.when(C("p_partkey") % 3 == 0, C("p_name")).otherwise(F.concat("p_name", F.lit(" "), (C("p_partkey") % 7).cast("string"))).alias("name")).distinct()
    fresh = t.nodes.filter("seq % 2 = 0").groupBy("name").agg(F.max_by("id", "seq").alias("fresh"))
    known = t.nodes.groupBy("name").agg(F.min_by("id", "seq").alias("known"))
    found = asked.join(fresh, "name", "left").join(known, "name", "left")
    return found.select("name", F.coalesce("fresh", "known", fn.node_id(F.lit("<unresolved>"), C("name"), C("name"))).alias("id"), (C("fresh").isNull() & C("known").isNull()).alias("phantom"))


@query(""" SELECT 'caller' AS side, n.key, l.weight FROM links l JOIN nodes n ON n.key = l.from_key WHERE l.to_key = 'p10' UNION ALL SELECT 'callee', n.key, l.weight FROM links l JOIN nodes n ON n.key = l.to_key WHERE l.from_key = 's5'""", "nodes links")
def callers_callees(t: Tables) -> DataFrame:
    ids = t.nodes.select("key")
    into = t.links.filter("to_key = 'p10'").join(ids, C("from_key") == C("key")).select(F.lit("caller").alias("side"), "key", "weight")
    out = t.links.filter("from_key = 's5'").join(ids, C("to_key") == C("key")).select(F.lit("callee").alias("side"), "key", "weight")
    return into.unionByName(out)


@query(""" , first AS (SELECT anchor_type, anchor_value, kind, min(id) AS first_id FROM notes GROUP BY ALL)
SELECT n.id, f.first_id, n.id <> f.first_id AS repeats FROM notes n JOIN first f ON n.anchor_type IS NOT DISTINCT FROM f.anchor_type AND n.anchor_value IS NOT DISTINCT FROM f.anchor_value AND n.kind = f.kind""", "notes")
def null_safe_dedup(t: Tables) -> DataFrame:
    """Each note's first equal in anchor and kind, nulls being equal."""
    first = t.notes.groupBy("anchor_type", "anchor_value", "kind").agg(F.min("id").alias("first_id")).alias("f")
    n = t.notes.select("id", "anchor_type", "anchor_value", "kind").alias("n")
    same = C("n.anchor_type").eqNullSafe(C("f.anchor_type")) & C("n.anchor_value").eqNullSafe(C("f.anchor_value")) & (C("n.kind") == C("f.kind"))
    return n.join(first, same).select("id", "first_id", (C("id") != C("first_id")).alias("repeats"))


@query(""" SELECT session_id, event_id, timestamp, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, event_id DESC) AS r FROM sessions) WHERE r <= 5""", "sessions")
def topk_recent_per_key(t: Tables) -> DataFrame:
    return ops.top_per_key(t.sessions, ["session_id"], [C("timestamp").desc(), C("event_id").desc()], 5).select("session_id", "event_id", "timestamp", C("rank").cast("long").alias("rank"))


@query(""" SELECT to_key, side, from_key, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY to_key, side ORDER BY weight DESC, from_key) AS r FROM (SELECT *, substr(from_key, 1, 1) AS side FROM links WHERE kind = 'Calls')) WHERE r <= CASE side WHEN 's' THEN 5 ELSE 3 END""", "links")
def per_source_caps(t: Tables) -> DataFrame:
    rows = t.links.filter("kind = 'Calls'").withColumn("side", F.substring("from_key", 1, 1))
    caps = F.when(C("side") == "s", 5).otherwise(3)
    return ops.top_per_key(rows, ["to_key", "side"], [C("weight").desc(), C("from_key")], caps).select("to_key", "side", "from_key", C("rank").cast("long").alias("rank"))


@query(""" SELECT DISTINCT other FROM (SELECT to_key AS other FROM links WHERE from_key = 's3' UNION SELECT from_key FROM links WHERE to_key = 'n3') ORDER BY other LIMIT 20""", "links")
def related_ids_both_ways(t: Tables) -> DataFrame:
    out = t.links.filter("from_key = 's3'").select(C("to_key").alias("other"))
    return out.union(t.links.filter("to_key = 'n3'").select("from_key")).distinct().orderBy("other").limit(20)


@query("""WITH old AS (SELECT md5(text) AS h FROM documents WHERE doc_id % 2 = 0), new AS (SELECT md5(text) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT 'orphan' AS side, count(*) AS n FROM (SELECT h FROM old EXCEPT SELECT h FROM new) UNION ALL SELECT 'candidate', count(*) FROM (SELECT h FROM new EXCEPT SELECT h FROM old)""")
def orphans_and_candidates(t: Tables) -> DataFrame:
    h = t.raw("documents").select(F.md5("text").alias("h"), (C("doc_id") % 2).alias("half"))
    old, new = h.filter("half = 0").select("h"), h.filter("half = 1").select("h")
    count = lambda rows, side: rows.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(old.subtract(new), "orphan").unionByName(count(new.subtract(old), "candidate"))


@query("""SELECT source, doc_id, n_chars, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3""")
def federated_topk(t: Tables) -> DataFrame:
    return ops.top_per_key(t.raw("documents").select("source", "doc_id", "n_chars"), ["source"], [C("n_chars").desc(), C("doc_id")], 3).withColumn("rank", C("rank").cast("long"))
