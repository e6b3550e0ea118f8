"""Traversals, ranks, detectors and identity over the node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan.adapters import Tables, rank_steps
from lorespan.operators import graph as g
from lorespan.operators.retrieval import intents
from lorespan.plans.registry import query

C = F.col


def starts(t: Tables, *keys: str) -> DataFrame:
    return t.nodes.filter(C("key").isin(*keys)).select(C("key").alias("start"))


def files(t: Tables) -> DataFrame:
    return t.nodes.select(C("key").alias("node"), "file_path")


_STARTS = "(VALUES ('s3'), ('c11'), ('n4')) v(start)"


def _bfs(step: str, hops: int, begin: str = _STARTS) -> str:
    return f""" , step AS ({step}), walk(start, node, depth) AS (SELECT start, start, 0 FROM {begin} UNION SELECT w.start, s.dst, w.depth + 1 FROM walk w JOIN step s ON s.src = w.node WHERE w.depth < {hops})
SELECT start, node, min(depth) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0"""


_OUT = "SELECT DISTINCT from_key AS src, to_key AS dst FROM links"
_IN = "SELECT DISTINCT to_key AS src, from_key AS dst FROM links"


@query(_bfs(_OUT, 2), "links", recursive=True)
def bfs_out(t: Tables) -> DataFrame:
    return g.bfs(t.edges, starts(t, "s3", "c11", "n4"), 2)


@query(_bfs(_IN, 2, "(VALUES ('n4'), ('p7')) v(start)"), "links", recursive=True)
def bfs_in(t: Tables) -> DataFrame:
    return g.bfs(t.edges_back, starts(t, "n4", "p7"), 2)


@query(f""" , f AS ({_OUT}), b AS ({_IN}), near AS (SELECT 's3' AS start, dst AS node, 1 AS depth FROM f WHERE src = 's3' UNION SELECT 's3', dst, 1 FROM b WHERE src = 's3' UNION SELECT 'n4', dst, 1 FROM f WHERE src = 'n4' UNION SELECT 'n4', dst, 1 FROM b WHERE src = 'n4')
SELECT start, node, depth FROM near WHERE node <> start""", "links")
def bfs_bidirectional(t: Tables) -> DataFrame:
    return g.bfs_both(t.edges, starts(t, "s3", "n4"), 1, back=t.edges_back)


_AROUND = "('Module', 'Class', 'Interface')"


@query(f""" , near AS (SELECT from_key AS start, to_key AS node, 1 AS side FROM links WHERE from_key IN (SELECT from_key FROM links GROUP BY 1 HAVING count(*) <= 100)
  UNION SELECT to_key, from_key, 0 FROM links WHERE to_key IN (SELECT to_key FROM links GROUP BY 1 HAVING count(*) <= 100)),
cut AS (SELECT *, row_number() OVER (PARTITION BY start, side ORDER BY node) AS r FROM near WHERE node <> start AND start IN (SELECT key FROM nodes WHERE kind IN {_AROUND})),
one AS (SELECT start, node, min(side) AS s FROM cut WHERE r <= CASE side WHEN 0 THEN 25 ELSE 50 END GROUP BY 1, 2)
SELECT start, node FROM one QUALIFY row_number() OVER (PARTITION BY start ORDER BY s, node) <= 50""", "nodes links")
def one_hop_neighbours(t: Tables) -> DataFrame:
    """What is next to each module, class and interface: at most 50, around hubs of over 100 edges nothing."""
    begin = t.nodes.filter(f"kind IN {_AROUND}").select(C("key").alias("start"))
    return g.bfs_both(t.edges, begin, 1, degree_cap=100, budget=50, back=t.edges_back).select("start", "node")


_BUDGETED = f""" , f AS ({_OUT}), b AS ({_IN}), begin(start) AS (VALUES ('s3'), ('c11'), ('n4')),
walk(start, side, node, depth) AS (SELECT start, side, start, 0 FROM begin, (VALUES (0), (1)) v(side) UNION
  SELECT w.start, w.side, n.dst, w.depth + 1 FROM walk w JOIN (SELECT 0 AS way, * FROM b UNION ALL SELECT 1, * FROM f) n ON n.src = w.node AND n.way = w.side WHERE w.depth < 2 AND n.dst NOT IN ('n0', 'p7')),
near AS (SELECT start, side, node, min(depth) AS depth FROM walk GROUP BY 1, 2, 3 HAVING min(depth) > 0),
cut AS (SELECT *, row_number() OVER (PARTITION BY start, side ORDER BY depth, node) AS r FROM near),
one AS (SELECT start, node, min((side, depth)) AS m FROM cut WHERE r <= CASE side WHEN 0 THEN 12 ELSE 25 END GROUP BY 1, 2)
SELECT start, node, m[2] AS depth FROM one QUALIFY row_number() OVER (PARTITION BY start ORDER BY m[1], m[2], node) <= 25"""


@query(_BUDGETED.replace("min((side, depth)) AS m", "min([side, depth]) AS m"), "links", recursive=True)
def bfs_budget_blocked(t: Tables) -> DataFrame:
    """Two hops both ways with a budget of 25, half of it for the way in, around blocked nodes."""
    blocked = t.spark.sql("select * from values ('n0'), ('p7') as b(node)")
    return g.bfs_both(t.edges, starts(t, "s3", "c11", "n4"), 2, budget=25, blocked=blocked, back=t.edges_back)


@query(""" , n AS (SELECT name, min((file_path, key)) AS m FROM nodes WHERE name IN (SELECT name FROM nodes WHERE name IN ('red widget', 'small ring', 'ASIA') OR key IN ('s3', 'c11')) GROUP BY 1), first AS (SELECT name, m[2] AS key FROM n),
near AS (SELECT DISTINCT f.name, f.key, 'caller' AS side, l.from_key AS other FROM first f JOIN links l ON l.to_key = f.key UNION SELECT DISTINCT f.name, f.key, 'callee', l.to_key FROM first f JOIN links l ON l.from_key = f.key)
SELECT near.name, near.key, side, row_number() OVER (PARTITION BY near.name, side ORDER BY o.name, other) AS place, other, o.name AS other_name FROM near JOIN nodes o ON o.key = other QUALIFY place <= 10""".replace("min((file_path, key))", "min([file_path, key])"), "nodes links")
def neighbourhood_display(t: Tables) -> DataFrame:
    asked = C("name").isin("red widget", "small ring", "ASIA") | C("key").isin("s3", "c11")
    return g.neighbourhood(t.nodes, t.edges, t.nodes.filter(asked).select("name").distinct()).withColumn("place", C("place").cast("long"))


@query(""" , gone(k) AS (VALUES ('n4'), ('s3')), added(src, dst, weight) AS (VALUES ('r0', 'n1', 2.0), ('r0', 'nowhere', 1.0), ('n1', 'r1', 9.0), ('s5', 'p7', 4.0)),
a AS (SELECT * FROM added WHERE src IN (SELECT key FROM nodes) AND dst IN (SELECT key FROM nodes)), e AS (SELECT from_key AS src, to_key AS dst, kind, weight FROM links WHERE from_key LIKE 'n%' OR from_key LIKE 's%'),
m AS (SELECT * FROM e WHERE (src, dst, kind) NOT IN (SELECT (src, dst, 'Contains') FROM a) UNION ALL SELECT src, dst, 'Contains', weight FROM a)
SELECT src, dst, kind, weight::DOUBLE AS weight FROM m WHERE src NOT IN (SELECT k FROM gone) AND dst NOT IN (SELECT k FROM gone)""".replace("(src, dst, kind) NOT IN (SELECT (src, dst, 'Contains') FROM a)", "src || '>' || dst || kind NOT IN (SELECT src || '>' || dst || 'Contains' FROM a)"), "nodes links")
def graph_mutation(t: Tables) -> DataFrame:
    """Edges added where both ends exist, replacing equal ones; then nodes taken out with all their edges."""
    added = t.spark.sql("select src, dst, 'Contains' as kind, cast(weight as double) as weight from values ('r0', 'n1', 2.0), ('r0', 'nowhere', 1.0), ('n1', 'r1', 9.0), ('s5', 'p7', 4.0) as a(src, dst, weight)")
    own = t.edges.filter(C("src").rlike("^[ns]"))
    gone = t.spark.sql("select * from values ('n4'), ('s3') as g(node)")
    return g.without_nodes(g.with_edges(own, added, t.nodes.select(C("key").alias("node"))), gone)


@query(_bfs("SELECT DISTINCT from_key AS src, to_key AS dst FROM links WHERE from_key NOT IN (SELECT from_key FROM links GROUP BY 1 HAVING count(*) > 50)", 3), "links", recursive=True)
def bfs_degree_cap(t: Tables) -> DataFrame:
    """Suppliers are hubs over the cap and end the walk; customers are not."""
    return g.bfs(t.edges, starts(t, "s3", "c11", "n4"), 3, degree_cap=50)


_CAPPED = "SELECT DISTINCT {a} AS src, {b} AS dst FROM links WHERE {a} NOT IN (SELECT {a} FROM links GROUP BY 1 HAVING count(*) > 50)"


@query(f""" , f AS ({_CAPPED.format(a='from_key', b='to_key')}), b AS ({_CAPPED.format(a='to_key', b='from_key')}),
asked(start, intent, back, forth, share) AS (VALUES ('c11', 'debug', 3, 2, 0.5), ('c12', 'refactor', 0, 5, 0.0), ('p7', 'understand', 2, 2, 0.5), ('c9', 'extend', 0, 2, 0.0)),
walk(start, intent, side, node, depth) AS (SELECT start, intent, s.side, start, 0 FROM asked, (VALUES (0), (1)) s(side) UNION
  SELECT w.start, w.intent, w.side, n.dst, w.depth + 1 FROM walk w JOIN asked a USING (start, intent) JOIN (SELECT 0 AS way, * FROM b UNION ALL SELECT 1, * FROM f) n ON n.src = w.node AND n.way = w.side WHERE w.depth < CASE w.side WHEN 0 THEN a.back ELSE a.forth END),
near AS (SELECT start, intent, side, node, min(depth) AS depth FROM walk WHERE depth > 0 AND node <> start GROUP BY 1, 2, 3, 4),
cut AS (SELECT *, row_number() OVER (PARTITION BY start, intent, side ORDER BY depth, node) AS r FROM near),
one AS (SELECT c.start, c.intent, node, min([side, depth]) AS m FROM cut c JOIN asked a USING (start, intent) WHERE r <= CASE side WHEN 0 THEN greatest(1, floor(100 * a.share)) ELSE 100 END GROUP BY 1, 2, 3)
SELECT start, intent, node, m[2] AS depth FROM one QUALIFY row_number() OVER (PARTITION BY start, intent ORDER BY m[1], m[2], node) <= 100""", "links", recursive=True)
def intent_traversal(t: Tables) -> DataFrame:
    asked = t.spark.sql("select * from values ('c11', 'debug'), ('c12', 'refactor'), ('p7', 'understand'), ('c9', 'extend') as a(start, intent)")
    return g.intent_traversal(t.edges, t.edges_back, asked).drop("place")


_MIXED = """cut AS (SELECT *, row_number() OVER (PARTITION BY start, intent, side ORDER BY depth, node) AS r FROM near),
one AS (SELECT c.start, c.intent, node, min([side, depth]) AS m FROM cut c JOIN asked a USING (start, intent) WHERE r <= CASE side WHEN 0 THEN greatest(1, floor(a.most * a.share)) ELSE a.most END GROUP BY 1, 2, 3),
ranked AS (SELECT o.*, row_number() OVER (PARTITION BY start, intent ORDER BY m[1], m[2], node) AS p FROM one o), firsts AS (SELECT start, node, p FROM ranked WHERE intent = 'debug' AND p <= 30),
mixed AS (SELECT * FROM firsts UNION ALL SELECT start, node, 50 + p FROM ranked r WHERE intent = 'refactor' AND p <= 50 AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.start = r.start AND f.node = r.node))
SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY p) AS place FROM mixed QUALIFY place <= 50"""


@query(f""" , f AS ({_CAPPED.format(a='from_key', b='to_key')}), b AS ({_CAPPED.format(a='to_key', b='from_key')}),
asked(start, intent, back, forth, share, most) AS (VALUES ('c11', 'debug', 3, 2, 0.5, 30), ('p7', 'debug', 3, 2, 0.5, 30), ('c11', 'refactor', 0, 5, 0.0, 50), ('p7', 'refactor', 0, 5, 0.0, 50)),
walk(start, intent, side, node, depth) AS (SELECT start, intent, s.side, start, 0 FROM asked, (VALUES (0), (1)) s(side) UNION
  SELECT w.start, w.intent, w.side, n.dst, w.depth + 1 FROM walk w JOIN asked a USING (start, intent) JOIN (SELECT 0 AS way, * FROM b UNION ALL SELECT 1, * FROM f) n ON n.src = w.node AND n.way = w.side WHERE w.depth < CASE w.side WHEN 0 THEN a.back ELSE a.forth END),
near AS (SELECT start, intent, side, node, min(depth) AS depth FROM walk WHERE depth > 0 AND node <> start GROUP BY 1, 2, 3, 4), {_MIXED}""", "links", recursive=True)
def weighted_intent_union(t: Tables) -> DataFrame:
    """A prompt that speaks for two intents: debug first, then refactor."""
    prompt = t.spark.createDataFrame([(0, "the code has a bug so rename it")], "qid int, query string")
    asked = intents(prompt).select("primary", "secondary", F.explode(F.array(F.lit("c11"), F.lit("p7"))).alias("start"))
    return g.mixed_intents(t.edges, t.edges_back, asked, budget=50).withColumn("place", C("place").cast("long"))


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.edges.select("src", "dst"), t.nodes.select(C("key").alias("node"))


def _rank_sql(reference: bool) -> str:
    return f""" , {rank_steps(30, reference)} SELECT node, round(rank * 1e6, 4) AS rank FROM ranked"""


@query(_rank_sql(True), "nodes links")
def pagerank_reference(t: Tables) -> DataFrame:
    """Links here are distinct pairs, so that counting edges and pairs is the same."""
    return g.pagerank(*_graph(t), parallel=False).select("node", F.round(C("rank") * 1e6, 4).alias("rank"))


@query(_rank_sql(False), "nodes links")
def pagerank_standard(t: Tables) -> DataFrame:
    return g.pagerank(*_graph(t), variant="standard", parallel=False).select("node", F.round(C("rank") * 1e6, 4).alias("rank"))


@query(""" , top AS (SELECT key FROM centrality ORDER BY round(centrality, 12) DESC, key LIMIT 10)
SELECT kind, count(*) AS n_edges, sum(weight) AS weight, count(DISTINCT from_key) AS sources, count(DISTINCT to_key) AS targets FROM links GROUP BY 1
UNION ALL SELECT 'top ' || key, NULL, round(centrality * 1e6, 4), NULL, NULL FROM top JOIN centrality USING (key)
UNION ALL SELECT 'nodes', count(*), NULL, NULL, NULL FROM nodes""", "nodes links centrality")
def graph_stats_topk(t: Tables) -> DataFrame:
    kinds = t.edges.groupBy("kind").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
    top = t.centrality.orderBy(F.round("centrality", 12).desc(), "key").limit(10)
    nodes = t.nodes.agg(F.count("*").alias("n_edges")).withColumn("kind", F.lit("nodes"))
    out = kinds.unionByName(top.select(F.concat(F.lit("top "), "key").alias("kind"), F.round(C("centrality") * 1e6, 4).alias("weight")), allowMissingColumns=True)
    return out.unionByName(nodes, allowMissingColumns=True)


@query(" SELECT DISTINCT l.to_key AS node, n.file_path FROM links l JOIN nodes n ON n.key = l.from_key", "nodes links")
def reverse_index(t: Tables) -> DataFrame:
    return g.reverse_index(t.edges, files(t)).select(C("dst").alias("node"), "file_path")


@query(""" SELECT DISTINCT b.file_path AS changed, a.file_path FROM links l JOIN nodes a ON a.key = l.from_key JOIN nodes b ON b.key = l.to_key WHERE b.file_path IN ('part/Brand_3.go', 'region/2.rs') AND a.file_path <> b.file_path""", "nodes links")
def affected_files(t: Tables) -> DataFrame:
    changed = t.spark.sql("select * from values ('part/Brand_3.go'), ('region/2.rs') as c(file_path)")
    return g.affected_files(t.edges, files(t), changed)


@query(f""" , added(src, dst) AS (VALUES ('r1', 's3'), ('r2', 'c11'), ('p3', 'p4'), ('n4', 'c11'), ('r0', 'n0'), ('n7', 'n7'), ('r0', 's1'), ('r3', 's2')), step AS ({_OUT}),
walk(start, node) AS (SELECT dst, dst FROM added UNION SELECT w.start, s.dst FROM walk w JOIN step s ON s.src = w.node)
SELECT DISTINCT a.src, a.dst FROM added a JOIN walk w ON w.start = a.dst AND w.node = a.src""", "links", recursive=True)
def cycle_check(t: Tables) -> DataFrame:
    added = t.spark.sql("select * from values ('r1', 's3'), ('r2', 'c11'), ('p3', 'p4'), ('n4', 'c11'), ('r0', 'n0'), ('n7', 'n7'), ('r0', 's1'), ('r3', 's2') as a(src, dst)")
    return g.closes_cycle(t.edges, added, back=t.edges_back)


@query(f""" , step AS ({_IN}), walk(start, node) AS (SELECT start, start FROM (VALUES ('n4'), ('p7'), ('r1'), ('c11'), ('p100')) v(start) UNION SELECT w.start, s.dst FROM walk w JOIN step s ON s.src = w.node),
near AS (SELECT src AS start, count(*) AS callers FROM step GROUP BY 1)
SELECT w.start, coalesce(any_value(callers), 0) AS callers, count(*) AS visited, coalesce(any_value(callers), 0) > 20 OR count(*) > 50 AS large FROM walk w LEFT JOIN near USING (start) GROUP BY 1""", "links", recursive=True)
def blast_radius(t: Tables) -> DataFrame:
    return g.blast_radius(t.edges, starts(t, "n4", "p7", "r1", "c11", "p100"), back=t.edges_back, count_all=True)


_TESTS = "SELECT key FROM nodes WHERE regexp_matches(lower(CASE WHEN seq % 50 = 0 THEN 'tests/' || file_path ELSE file_path END), 'test|spec')"


def _tests(t: Tables) -> DataFrame:
    """Every fiftieth symbol's file taken as a test."""
    path = F.when(C("seq") % 50 == 0, F.concat(F.lit("tests/"), C("file_path"))).otherwise(C("file_path"))
    return t.nodes.filter(fn.is_test_path(path)).select(C("key").alias("node"))


@query(f""" , busy AS (SELECT session_id FROM sessions GROUP BY 1 HAVING count(*) >= 10), n AS (SELECT key FROM nodes WHERE kind IN ('Function', 'Interface') AND key NOT IN (SELECT to_key FROM links WHERE from_key NOT IN ({_TESTS})))
SELECT n.key, count(*) AS sessions FROM n JOIN busy ON substr(n.key, 2) = substr(session_id, 2) GROUP BY 1""", "nodes links sessions")
def dead_end(t: Tables) -> DataFrame:
    """Symbols that nothing but tests calls, that a session of at least ten actions is at."""
    alone = g.dead_ends(t.nodes.filter("kind in ('Function', 'Interface')").select(C("key").alias("node"), F.substring("key", 2, 99).alias("number")), t.edges, _tests(t))
    busy = t.sessions.groupBy("session_id").count().filter("count >= 10").select(F.substring("session_id", 2, 99).alias("number"))
    return alone.join(busy, "number").groupBy(C("node").alias("key")).agg(F.count("*").alias("sessions"))


@query(" SELECT key FROM nodes WHERE kind = 'Method' AND key NOT IN (SELECT to_key FROM links WHERE from_key IN (SELECT key FROM nodes WHERE regexp_matches(lower(CASE WHEN seq % 50 = 0 THEN 'tests/' || file_path ELSE file_path END), 'test|spec')))", "nodes links")
def untested(t: Tables) -> DataFrame:
    return g.without_callers(t.nodes.filter("kind = 'Method'").select(C("key").alias("node")), t.edges, _tests(t)).select(C("node").alias("key"))


@query(" SELECT file_path FROM files WHERE file_type = 'code' AND file_path NOT IN (SELECT 'web/' || (seq - 1000000) || '.js' FROM nodes WHERE kind = 'Interface')", "nodes files")
def blind_spot(t: Tables) -> DataFrame:
    known = t.nodes.filter("kind = 'Interface'").select(F.concat(F.lit("web/"), (C("seq") - 1000000).cast("string"), F.lit(".js")).alias("file_path"))
    return t.files.filter("file_type = 'code'").join(known, "file_path", "left_anti").select("file_path")


_PARAMS = "list_distinct(list_filter(list_transform(string_split(regexp_extract({0}, '^[^(]*\\((.*)\\)[^)]*$', 1), ','), lambda x: trim(split_part(trim(x), ':', 1))), lambda x: x <> ''))"
_RETURNED = "nullif(trim(regexp_extract({0}, '->(.*)$', 1)), '')"
_LIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_PAIRS = f""" , p AS (SELECT o.id AS old_id, c.id AS new_id, o.block, o.name AS a, c.name AS b, o.signature = c.before AS same, o.file_path = c.file_path AS here, o.neighbours AS na, c.neighbours AS nb,
  {_PARAMS.format('o.signature')} AS pa, {_PARAMS.format('c.signature')} AS pb, {_RETURNED.format('o.signature')} AS ra, {_RETURNED.format('c.signature')} AS rb FROM old_symbols o JOIN new_symbols c USING (block)),
s AS (SELECT old_id, new_id, block, jaro_winkler_similarity(a, b) * 0.3 + (({_LIKE.format('pa', 'pb')}) * 0.6 + CASE WHEN ra IS NULL AND rb IS NULL THEN 1.0 WHEN ra IS NULL OR rb IS NULL THEN 0.0 ELSE jaro_winkler_similarity(ra, rb) END * 0.4) * 0.25
  + CASE WHEN same THEN 0.25 ELSE 0.0 END + ({_LIKE.format('na', 'nb')}) * 0.15 + CASE WHEN here THEN 0.05 ELSE 0.0 END AS score FROM p)"""


def _here() -> Column:
    return F.when(C("old_file_path") == C("new_file_path"), 1.0).otherwise(0.0)


def _sides(t: Tables) -> list[DataFrame]:
    """Old and new symbols with their block."""
    return [t.symbols(new).select("block", *(C(c).alias(f"{name}_{c}") for c in ("id", "name", "signature", "checksum", "neighbours", "file_path"))) for name, new in (("old", False), ("new", True))]


@query(_PAIRS + " SELECT old_id, new_id, round(score, 6) AS score FROM s", "new_symbols")
def cross_similarity(t: Tables) -> DataFrame:
    return g.group_similarity(*_sides(t), ["block"], _here(), digits=6, named=False)


@query(_PAIRS + """ , o AS MATERIALIZED (SELECT block, old_id, new_id, round(score, 9) AS score, row_number() OVER (PARTITION BY block ORDER BY round(score, 9) DESC, old_id, new_id) AS r FROM s WHERE round(score, 9) > 0.6),
walk(block, r, used, taken, old_id, new_id, score, kept) AS (SELECT DISTINCT block, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, false FROM o UNION ALL
  SELECT o.block, o.r, CASE WHEN free THEN list_append(w.used, o.old_id) ELSE w.used END, CASE WHEN free THEN list_append(w.taken, o.new_id) ELSE w.taken END, o.old_id, o.new_id, o.score, free
  FROM walk w JOIN o ON o.block = w.block AND o.r = w.r + 1, LATERAL (SELECT NOT list_contains(w.used, o.old_id) AND NOT list_contains(w.taken, o.new_id) AS free))
SELECT block, old_id, new_id, round(score, 6) AS score FROM walk WHERE kept""", "new_symbols", recursive=True)
def greedy_identity_match(t: Tables) -> DataFrame:
    return g.matched_symbols(*_sides(t), ["block"], _here(), digits=9).withColumn("score", F.round("score", 6))
