"""Chunks, BM25, hybrid search, intents, scores and capsules."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan import sql
from lorespan.adapters import EPOCH, Tables
from lorespan.operators import capsule as cap
from lorespan.operators import graph as g
from lorespan.operators import memory
from lorespan.operators import retrieval as r
from lorespan.operators.storage import cut
from lorespan.plans.registry import query

C = F.col


def _terms(column: str) -> str:
    return f"regexp_extract_all(translate(lower({column}), '{fn.FOLD_FROM}', '{fn.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+')"


_CHUNKS = """ , raw AS (SELECT file_path, regexp_split_to_array(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') AS ls FROM markdown WHERE length(content) > 0),
l AS (SELECT file_path, unnest(range(len(ls))) AS line, unnest(ls) AS text FROM raw),
s AS (SELECT *, sum(CASE WHEN text LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line) AS section FROM l),
p AS (SELECT *, CASE WHEN count(*) OVER w > 200 THEN (line - min(line) OVER w) // 100 ELSE 0 END AS piece FROM s WINDOW w AS (PARTITION BY file_path, section)),
g AS (SELECT file_path, section, piece, min(line) + 1 AS start_line, max(line) + 1 AS end_line, string_agg(text, chr(10) ORDER BY line) AS content FROM p GROUP BY 1, 2, 3),
h AS (SELECT file_path, section, trim(regexp_replace(max(text) FILTER (text LIKE '#%'), '^#+', '')) AS heading FROM s GROUP BY 1, 2),
chunks AS (SELECT g.file_path, row_number() OVER (PARTITION BY g.file_path ORDER BY start_line) - 1 AS chunk_index, heading, start_line, end_line, content, strlen(content) // 4 AS token_estimate, substr(md5(content), 1, 8) AS content_hash FROM g JOIN h USING (file_path, section) WHERE trim(regexp_replace(content, '\\s+', ' ', 'g')) <> '')"""


@query(_CHUNKS + " SELECT file_path, chunk_index, heading, start_line, end_line, token_estimate, content_hash FROM chunks", "markdown")
def markdown_chunks(t: Tables) -> DataFrame:
    return r.chunk_markdown(t.markdown).drop("content")


def _bm25_sql(asked: str, mode: str = "and") -> str:
    """On tables d(id, text) and asked rows (qid, phrase, phrases, size, off, term, prefix), or what selects them."""
    return f""", asked(qid, phrase, phrases, size, off, term, prefix) AS ({asked if asked.startswith("SELECT") else "VALUES " + asked}), t AS (SELECT id, {_terms('text')} AS ts FROM d), tok AS (SELECT id, unnest(range(len(ts))) AS pos, unnest(ts) AS term FROM t),
n AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean_len FROM t), a AS (SELECT qid, phrase, phrases, size, off, term FROM asked WHERE NOT prefix UNION ALL SELECT qid, phrase, phrases, size, off, v.term FROM asked JOIN (SELECT DISTINCT term FROM tok) v ON starts_with(v.term, asked.term) WHERE prefix),
w AS (SELECT qid, phrase, phrases, size, id, pos - off AS at FROM tok JOIN a USING (term) GROUP BY ALL HAVING count(DISTINCT off) = size), f AS (SELECT qid, phrase, phrases, id, count(*) AS f FROM w GROUP BY ALL), dn AS (SELECT qid, phrase, count(*) AS n FROM f GROUP BY ALL),
sc AS (SELECT qid, id, phrases, count(*) AS have, sum((CASE WHEN ln((n_docs - dn.n + 0.5) / (dn.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - dn.n + 0.5) / (dn.n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ts) / mean_len))) AS score FROM f JOIN dn USING (qid, phrase) JOIN t USING (id), n GROUP BY ALL),
hits AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE {'have = phrases' if mode == 'and' else 'true'})"""


def _queries(t: Tables, *texts: str) -> DataFrame:
    return t.spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "qid int, query string")


def _show(scores: DataFrame, k: int) -> DataFrame:
    return _shown(r.top_hits(scores, k))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", F.round("score", 6).alias("score"))


_D_NODES = " , d AS (SELECT key AS id, name || ' ' || signature AS text FROM nodes)"
_SHOW = " SELECT qid, id, round(score, 6) AS score FROM hits WHERE rank <= {0}"


@query(_D_NODES + _bm25_sql("(0, 0, 2, 1, 0, 'red', false), (0, 1, 2, 1, 0, 'widget', false), (1, 0, 1, 1, 0, 'economy', false)") + _SHOW.format(20), "nodes")
def bm25_nodes(t: Tables) -> DataFrame:
    return _shown(r.bm25_top(t.symbol_index, _queries(t, "red widget", "economy"), 20))


@query(" , d AS (SELECT id, text || ' ' || tags AS text FROM notes)" + _bm25_sql("(0, 0, 2, 1, 0, 'assistant', false), (0, 1, 2, 1, 0, 't3', false), (1, 0, 2, 1, 0, 'the', false), (1, 1, 2, 1, 0, 'user', false)", "or") + _SHOW.format(10), "notes")
def bm25_notes(t: Tables) -> DataFrame:
    docs = t.notes.select("id", F.concat_ws(" ", "text", "tags").alias("text"))
    return _show(r.bm25(docs, _queries(t, "assistant t3", "the user"), mode="or"), 10)


@query(_CHUNKS.replace(" , raw", " , raw", 1) + " , d AS (SELECT file_path || '#' || chunk_index AS id, coalesce(heading, '') || ' ' || content AS text FROM chunks)" + _bm25_sql("(0, 0, 2, 1, 0, 'the', false), (0, 1, 2, 1, 0, 'thing', false), (1, 0, 1, 1, 0, 'de', false)") + _SHOW.format(10), "markdown")
def bm25_docs(t: Tables) -> DataFrame:
    chunks = r.chunk_markdown(t.markdown)
    docs = chunks.select(F.concat("file_path", F.lit("#"), C("chunk_index").cast("string")).alias("id"), F.concat_ws(" ", F.coalesce("heading", F.lit("")), "content").alias("text"))
    return _show(r.bm25(docs, _queries(t, "the thing", "de")), 10)


@query(_D_NODES + _bm25_sql("(0, 0, 1, 1, 0, 'wid', true), (1, 0, 2, 1, 0, 'bl', true), (1, 1, 2, 1, 0, 'small', false)") + _SHOW.format(15), "nodes")
def bm25_prefix(t: Tables) -> DataFrame:
    return _show(r.bm25(t.symbol_index, _queries(t, "wid*", "bl* small")), 15)


@query(_D_NODES + _bm25_sql("(0, 0, 1, 2, 0, 'red', false), (0, 0, 1, 2, 1, 'widget', false), (1, 0, 2, 2, 0, 'small', false), (1, 0, 2, 2, 1, 'ring', false), (1, 1, 2, 1, 0, 'economy', false)") + _SHOW.format(15), "nodes")
def bm25_phrase(t: Tables) -> DataFrame:
    return _show(r.bm25(t.symbol_index, _queries(t, "red_widget", "small_ring economy")), 15)


_TYPE_WORDS = f"SELECT kind, i, len(ts), 1, 0, ts[i + 1], false FROM (SELECT kind, ts, unnest(range(len(ts))) AS i FROM (SELECT p_type AS kind, {_terms('p_type')} AS ts FROM part GROUP BY p_type))"


@query(_D_NODES + _bm25_sql(_TYPE_WORDS) + " SELECT qid AS kind, count(*) AS symbols, round(max(score), 6) AS best, count(DISTINCT n.name) AS names FROM sc JOIN nodes n ON n.key = sc.id WHERE have = phrases GROUP BY 1", "nodes")
def bm25_in_sql(t: Tables) -> DataFrame:
    """Full-text search called in a guarded text: the symbols that match each type of parts."""
    sql.register(t.spark, t.sf_dir)
    sql.full_text(t.spark, t.symbol_index, "search_symbols")
    return sql.run(t.spark, """SELECT k.kind, count(*) AS symbols, round(max(s.score), 6) AS best, count(DISTINCT n.name) AS names
      FROM (SELECT DISTINCT p_type AS kind FROM part) AS k, LATERAL search_symbols(k.kind) AS s JOIN nodes n ON n.key = s.id GROUP BY k.kind""")


_KINDS = ("Method", "Function", "Interface")


@query(f""" , t AS (SELECT kind AS repo, key AS id, {_terms("name || ' ' || signature")} AS ts FROM nodes WHERE kind IN {_KINDS}), c AS (SELECT repo, count(*) AS docs, avg(len(ts)) AS mean FROM t GROUP BY 1),
k AS (SELECT repo, id, term, count(*) AS f FROM (SELECT repo, id, unnest(ts) AS term FROM t) WHERE term IN ('1', 'anodized', 'building') GROUP BY ALL), idf AS (SELECT repo, term, ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM k JOIN c USING (repo) GROUP BY ALL),
s AS (SELECT repo, CASE term WHEN '1' THEN 0 WHEN 'anodized' THEN 1 ELSE 2 END AS qid, id, CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ts) / mean)) AS score FROM k JOIN idf USING (repo, term) JOIN c USING (repo) JOIN t USING (repo, id))
SELECT repo, qid, id, r AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY repo, qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""", "nodes")
def federated_search(t: Tables) -> DataFrame:
    """Three repositories, of parts, customers and suppliers, each with an index of its own: the five best of each, not ranked anew."""
    texts = t.nodes.select("kind", C("key").alias("id"), F.concat_ws(" ", "name", "signature").alias("text"))
    indexes = {kind: r.text_index(texts.filter(C("kind") == kind).drop("kind"), keep=lambda name, make, kind=kind: t._kept(f"{kind}_{name}", make)) for kind in _KINDS}
    asked = _queries(t, "1", "anodized", "building")
    found = [r.bm25_top(index, asked, 5).withColumn("repo", F.lit(kind)) for kind, index in indexes.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("repo", "qid", "id", C("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_D_NODES + _bm25_sql("(0, 0, 1, 1, 0, 'ring', false), (1, 0, 1, 1, 0, 'promo', false)") + """ ,
top AS (SELECT h.*, coalesce(centrality, 0.0) AS centrality FROM hits h LEFT JOIN centrality c ON c.key = h.id WHERE rank <= 50)
SELECT qid, id, round(0.6 * score / greatest(1e-10, max(score) OVER w) + 0.4 * centrality / greatest(1e-10, max(centrality) OVER w), 6) AS combined FROM top WINDOW w AS (PARTITION BY qid)""", "nodes centrality")
def hybrid_search(t: Tables) -> DataFrame:
    return r.hybrid(r.bm25(t.symbol_index, _queries(t, "ring", "promo")), t.centrality.withColumnRenamed("key", "id")).select("qid", "id", F.round("combined", 6).alias("combined"))


@query(_D_NODES + _bm25_sql("(0, 0, 1, 1, 0, 'ring', false), (1, 0, 1, 1, 0, 'promo', false)") + """ SELECT n.key, coalesce(h.qid, -1) AS qid, round(coalesce(score, 0.0), 6) AS score, round(coalesce(centrality, 0.0) * 1e6, 4) AS centrality
FROM nodes n LEFT JOIN hits h ON h.id = n.key LEFT JOIN centrality c ON c.key = n.key WHERE n.kind IN ('Method', 'Interface')""", "nodes centrality")
def hybrid_left_join(t: Tables) -> DataFrame:
    """Text scores and centrality of candidates, 0 where there is none."""
    scores = r.bm25(t.symbol_index, _queries(t, "ring", "promo")).withColumnRenamed("id", "key")
    rows = t.nodes.filter(C("kind").isin("Method", "Interface")).select("key").join(scores, "key", "left").join(t.centrality, "key", "left")
    return rows.select("key", F.coalesce("qid", F.lit(-1)).alias("qid"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.round(F.coalesce("centrality", F.lit(0.0)) * 1e6, 4).alias("centrality"))


@query(_D_NODES + _bm25_sql("(0, 0, 1, 1, 0, 'bolt', false), (1, 0, 1, 1, 0, 'customer', false)") + " SELECT qid, id, rank, round(score / max(score) OVER (PARTITION BY qid), 6) AS closeness FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM hits WHERE rank <= 5) WHERE abs(score) <= 1.2 * abs(best)", "nodes")
def disambiguation(t: Tables) -> DataFrame:
    """The five best symbols of a name, those within 1.2 times the best one's magnitude being its alternatives."""
    hits = r.bm25_top(t.symbol_index, _queries(t, "bolt", "customer"), 5)
    best = F.max("score").over(Window.partitionBy("qid"))
    close = C("score") / best
    return hits.withColumn("best", best).filter(F.abs("score") <= 1.2 * F.abs("best")).select("qid", "id", C("rank").cast("long").alias("rank"), F.round(close, 6).alias("closeness"))


#: Prompts and the intents that they are known to have.
_PROMPTS = ["", "why is this function crashing", "fix the bug in auth", "refactor the auth module", "explain how auth works", "add caching to the query engine", "review the database module", "getUser function", "the code has a bug so rename it", "who calls main", "audit security of auth", "  Fn(x: i32)  ", "***", "prefix address", "creat a thing", "xyzzy"]
_PROMPT_ROWS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(_PROMPTS))


def _talk(t: Tables) -> DataFrame:
    """What is said in conversations, accents folded, as queries; without other letters, which not every engine counts alike."""
    said = F.regexp_replace(F.translate(F.lower(F.coalesce("text", F.lit(""))), fn.FOLD_FROM, fn.FOLD_TO), r"[^\x00-\x7F]", "")
    return t.raw("conversations").select((C("conv_id") * 1000 + C("turn")).alias("qid"), said.alias("query"))


_TALK = f"SELECT conv_id * 1000 + turn AS qid, regexp_replace(translate(lower(coalesce(text, '')), '{fn.FOLD_FROM}', '{fn.FOLD_TO}'), '[^\\x00-\\x7F]', '', 'g') AS query FROM conversations"


@query(f"SELECT qid, trim(regexp_replace(translate(query, '\"''()*+-:^{{}}', '           '), '\\s+', ' ', 'g')) AS clean FROM ({_TALK} UNION ALL SELECT -1 - qid, q FROM (VALUES {_PROMPT_ROWS}) v(qid, q))")
def query_sanitiser(t: Tables) -> DataFrame:
    """Of all that is said, and of prompts with marks in them."""
    marked = _queries(t, *_PROMPTS).select((-1 - C("qid")).cast("long").alias("qid"), "query")
    return _talk(t).unionByName(marked).select("qid", fn.sanitise(C("query")).alias("clean"))


_KEYWORD_ROWS = ", ".join(f"({i}, '{k}', '{w}')" for i, (k, ws) in enumerate(r.KEYWORDS.items()) for w in ws)
_INTENT_SQL = f"""WITH p AS ({_TALK} UNION ALL SELECT -1 - qid, q FROM (VALUES {_PROMPT_ROWS}) v(qid, q)), k(place, intent, kw) AS (VALUES {_KEYWORD_ROWS}), pk AS (SELECT qid, lower(query) AS q, place, intent, kw FROM p, k),
ks AS (SELECT qid, place, intent, sum(CASE WHEN contains(q, kw) THEN CASE WHEN starts_with(q, kw) THEN 1.5 ELSE 1.0 END ELSE 0.0 END)::DOUBLE AS s FROM pk GROUP BY ALL HAVING sum(CASE WHEN contains(q, kw) THEN 1 ELSE 0 END) > 0),
fs AS (SELECT qid, place, intent, max(greatest(jaro_winkler_similarity(q, kw), list_max(list_transform(regexp_split_to_array(trim(q), '\\s+'), lambda w: jaro_winkler_similarity(w, kw))))) AS s FROM pk WHERE q <> '' AND qid NOT IN (SELECT qid FROM ks) GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, place) AS r FROM (SELECT * FROM ks UNION ALL SELECT * FROM fs WHERE s > 0.7)), a AS (SELECT * FROM s WHERE r = 1), b AS (SELECT * FROM s WHERE r = 2)"""


@query(_INTENT_SQL + " SELECT p.qid, coalesce(a.intent, 'understand') AS primary_intent, CASE WHEN a.s - b.s < 0.1 THEN b.intent END AS secondary, CASE WHEN a.s - b.s < 0.1 THEN 0.6 ELSE 1.0 END::DOUBLE AS primary_weight FROM p LEFT JOIN a USING (qid) LEFT JOIN b USING (qid)")
def intent_fuzzy(t: Tables) -> DataFrame:
    """Intents of all that is said in conversations, and of prompts."""
    return r.intents(_asked(t)).select("qid", C("primary").alias("primary_intent"), "secondary", "primary_weight")


def _asked(t: Tables) -> DataFrame:
    return _talk(t).unionByName(_queries(t, *_PROMPTS).select((-1 - C("qid")).cast("long").alias("qid"), "query"))


@query(_INTENT_SQL + " SELECT qid, intent, s AS score FROM ks")
def intent_keywords(t: Tables) -> DataFrame:
    rows = _asked(t).withColumn("q", F.lower("query"))
    scores = F.array(*[F.struct(F.lit(k).alias("intent"), s.alias("score")) for k, s in r.keyword_scores(C("q")).items()])
    return rows.select("qid", F.explode(scores).alias("x")).select("qid", "x.intent", "x.score").filter("score > 0")


#: The intent that each prompt is known to have, in the order of the prompts.
_KNOWN = ("understand", "debug", "debug", "refactor", "understand", "extend", "review", "understand", "debug", "understand", "review", "understand", "understand", "debug", "extend", "understand")
_KNOWN_ROWS = ", ".join(f"({i}, '{p}', '{k}')" for i, (p, k) in enumerate(zip(_PROMPTS, _KNOWN, strict=True)))


@query(f"""{_INTENT_SQL.replace("WITH p AS (" + _TALK + " UNION ALL SELECT -1 - qid, q FROM (VALUES " + _PROMPT_ROWS + ") v(qid, q))", f"WITH e(i, prompt, expected) AS (VALUES {_KNOWN_ROWS}), p AS (SELECT talk.qid, prompt || ' ' || query AS query, expected FROM ({_TALK}) talk JOIN e ON e.i = talk.qid % {len(_PROMPTS)})")}
SELECT coalesce(a.intent, 'understand') = p.expected AS ok, count(*) AS n FROM p LEFT JOIN a USING (qid) GROUP BY 1""")
def eval_intent_accuracy(t: Tables) -> DataFrame:
    """Cases of a known intent: a prompt before each text that is said."""
    known = t.spark.createDataFrame([(i, p, k) for i, (p, k) in enumerate(zip(_PROMPTS, _KNOWN, strict=True))], "i long, prompt string, expected string")
    cases = _talk(t).join(F.broadcast(known), C("qid") % len(_PROMPTS) == C("i")).select("qid", F.concat("prompt", F.lit(" "), "query").alias("query"), "expected")
    found = r.intents(cases.select("qid", "query")).select("qid", "primary").join(cases.select("qid", "expected"), "qid")
    return found.groupBy((C("primary") == C("expected")).alias("ok")).agg(F.count("*").alias("n"))


_AS_OF = EPOCH + 3_000_000
_PROX = "CASE anchor_type WHEN 'node' THEN CASE WHEN anchor_value = 'c17' THEN 1.0 WHEN anchor_value LIKE 'c1%' THEN 0.7 ELSE 0.5 END WHEN 'file' THEN CASE WHEN anchor_value = 'f1' THEN 0.8 WHEN anchor_value LIKE 'f1%' THEN 0.5 ELSE 0.4 END WHEN 'scope' THEN 0.6 ELSE 0.3 END"


def _near():
    here, near = C("anchor_value").isin("c17", "f1"), C("anchor_value").rlike("^[cf]1")
    return r.proximity(C("anchor_type"), here, near)


@query(f" SELECT id, ({_PROX})::DOUBLE AS proximity FROM notes", "notes")
def proximity_levels(t: Tables) -> DataFrame:
    return t.notes.select("id", _near().alias("proximity"))


@query(f""" SELECT id, round(greatest(0, least(1, (0.2 + 0.25 * ({_PROX}) + 0.15 * exp(-0.01 * greatest(0, ({_AS_OF} - updated_at) / 3600.0)) + 0.2 * quality) * CASE WHEN stale THEN 0.6 ELSE 1.0 END * CASE kind WHEN 'pitfall' THEN 1.2 WHEN 'strategy' THEN 1.1 WHEN 'context' THEN 0.8 ELSE 1.0 END))::DOUBLE, 6) AS score FROM notes""", "notes")
def note_scores(t: Tables) -> DataFrame:
    recency = fn.recency(C("updated_at"), F.lit(_AS_OF))
    return t.notes.select("id", F.round(r.note_score(F.lit(None).cast("double"), _near(), recency, C("quality"), C("stale"), C("kind")), 6).alias("score"))


@query("SELECT doc_id, round(greatest(0, least(1, 0.7 * (doc_id % 11) / 10.0 + 0.3 * CASE WHEN source = 'src1' THEN 1 ELSE 0 END))::DOUBLE, 6) AS score FROM documents")
def doc_scores(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.round(r.doc_score(C("doc_id") % 11 / 10.0, C("source") == "src1"), 6).alias("score"))


@query(f" SELECT id, round(exp(-0.01 * greatest(0, ({_AS_OF - 2_000_000} - updated_at) / 3600.0)), 6) AS recency FROM notes", "notes")
def recency_decay(t: Tables) -> DataFrame:
    return t.notes.select("id", F.round(fn.recency(C("updated_at"), F.lit(_AS_OF - 2_000_000)), 6).alias("recency"))


@query(f" SELECT event_id, round(0.5 * exp(-0.01 * greatest(0, ({_AS_OF} - timestamp) / 3600.0)) + 0.15, 6) AS score FROM sessions", "sessions")
def session_activity_scores(t: Tables) -> DataFrame:
    return t.sessions.select("event_id", F.round(r.session_score(fn.recency(C("timestamp"), F.lit(_AS_OF))), 6).alias("score"))


@query(""" , x AS (SELECT anchor_value AS label, id, quality, row_number() OVER (PARTITION BY anchor_type, anchor_value ORDER BY quality DESC, id) AS r, count(*) OVER (PARTITION BY anchor_type, anchor_value) AS n FROM notes WHERE anchor_type IN ('file', 'scope'))
SELECT label, id FROM x WHERE n <= 5 OR r <= 3 UNION ALL SELECT label, '[+' || (n - 3) || ' more notes on ' || label || ']' FROM x WHERE n > 5 AND r = 4""", "notes")
def note_distillation(t: Tables) -> DataFrame:
    rows = t.notes.filter(C("anchor_type").isin("file", "scope")).select("anchor_type", "anchor_value", C("anchor_value").alias("label"), "id", "quality", C("id").alias("content"))
    return cap.distilled(rows, ["anchor_type", "anchor_value"]).select("label", C("content").alias("id"))


@query("""WITH RECURSIVE x AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS tokens, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber::VARCHAR, concat_ws('|', l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT)) AS r FROM lineitem),
walk AS (SELECT l_orderkey, 0::BIGINT AS r, 0::BIGINT AS used, 0::BIGINT AS n FROM (SELECT DISTINCT l_orderkey FROM x) UNION ALL
SELECT x.l_orderkey, x.r, CASE WHEN w.used + x.tokens <= 60 THEN w.used + x.tokens ELSE w.used END, CASE WHEN w.used + x.tokens <= 60 THEN w.n + 1 ELSE w.n END FROM walk w JOIN x ON x.l_orderkey = w.l_orderkey AND x.r = w.r + 1)
SELECT l_orderkey, max(n) AS kept, max(used) AS used FROM walk GROUP BY 1 HAVING max(n) > 0""")
def greedy_budget_trim(t: Tables) -> DataFrame:
    """Each order's lines as a request's candidates: by falling discount, while their quantities fit into 60."""
    item = F.concat_ws("|", *(c.cast("string") for c in (C("l_partkey"), C("l_suppkey"), F.round(C("l_extendedprice") * 100).cast("long"))))
    rows = t.raw("lineitem").select(C("l_orderkey").alias("request_id"), C("l_linenumber").cast("string").alias("source"), item.alias("item"), C("l_quantity").cast("long").alias("tokens"), C("l_discount").alias("score"), F.lit(False).alias("pinned"))
    budgets = rows.select("request_id").distinct().withColumn("budget", F.lit(60))
    return cap.trimmed(rows, budgets).groupBy(C("request_id").alias("l_orderkey")).agg(F.count("*").alias("kept"), F.sum("tokens").alias("used"))


_REQUESTS = "(1, 'p7', 400, 'standard'), (2, 's3', 300, 'minimal'), (3, 'c17', 6000, 'detailed'), (4, 'c34', 350, 'unknown'), (5, 'n4', 500, 'standard'), (6, 'c51', 60, 'detailed')"


def _level(field: str) -> str:
    return f"CASE detail WHEN 'minimal' THEN {getattr(cap.LEVELS['minimal'], field)} WHEN 'detailed' THEN {getattr(cap.LEVELS['detailed'], field)} ELSE {getattr(cap.LEVELS['standard'], field)} END"


_NOTE = "CASE WHEN stale THEN '[STALE]' WHEN kind = 'strategy' THEN '[STRATEGY]' WHEN kind = 'pitfall' THEN '[PITFALL]' WHEN kind = 'context' THEN '[CONTEXT NOTE]' ELSE '[NOTE]' END || ' ' || text"
_NONE = {"anchor_type": "VARCHAR", "quality": "DOUBLE", "kind": "VARCHAR", "stale": "BOOLEAN", "updated_at": "BIGINT", "bm25": "DOUBLE", "distance": "BIGINT", "significance": "DOUBLE"}


def _more(**own: str) -> str:
    return ", ".join(own.get(c, f"NULL::{k}") + f" AS {c}" for c, k in _NONE.items())


_STEP = "SELECT DISTINCT from_key AS src, to_key AS dst FROM links WHERE from_key NOT IN (SELECT from_key FROM links GROUP BY 1 HAVING count(*) > 50)"
_NOTE_MORE = _more(anchor_type="anchor_type", quality="quality", kind="kind", stale="stale", updated_at="updated_at")
_CAPSULE_SQL = f""" , req(request_id, key, budget, detail) AS (VALUES {_REQUESTS}), {_CHUNKS[3:]}, d AS (SELECT file_path || '#' || chunk_index AS id, coalesce(heading, '') || ' ' || content AS text FROM chunks)
{_bm25_sql("(3, 0, 2, 1, 0, 'the', false), (3, 1, 2, 1, 0, 'thing', false), (6, 0, 1, 1, 0, 'de', false)")},
dc AS (SELECT h.qid AS request_id, h.id, h.score / max(h.score) OVER (PARTITION BY h.qid) AS bm25, '[doc: ' || file_path || ' > ' || coalesce(heading, '(untitled)') || ']' || chr(10) || content AS content, row_number() OVER (PARTITION BY h.qid ORDER BY h.score DESC, h.id) AS place FROM hits h JOIN chunks c ON c.file_path || '#' || c.chunk_index = h.id),
tgt AS (SELECT req.*, signature, file_path, name FROM req JOIN nodes USING (key)),
nb AS (SELECT request_id, 'caller' AS source, from_key AS item, row_number() OVER (PARTITION BY request_id ORDER BY weight DESC, from_key) AS place, {_level('callers')} AS lim FROM req JOIN links ON to_key = key
 UNION ALL SELECT request_id, 'callee', to_key, row_number() OVER (PARTITION BY request_id ORDER BY weight DESC, to_key), {_level('callees')} FROM req JOIN links ON from_key = key),
step AS ({_STEP}), far(request_id, node, depth) AS (SELECT request_id, key, 0 FROM req UNION SELECT f.request_id, s.dst, f.depth + 1 FROM far f JOIN step s ON s.src = f.node WHERE f.depth < 2),
near AS (SELECT request_id, node, min(depth) AS depth FROM far GROUP BY 1, 2 HAVING min(depth) > 0), reached AS (SELECT request_id, node AS item, row_number() OVER (PARTITION BY request_id ORDER BY depth, node) AS ord FROM near QUALIFY ord <= 100),
ext AS (SELECT x.request_id, x.item, row_number() OVER (PARTITION BY x.request_id ORDER BY ord, x.item) AS place, {_level('extended')} AS lim FROM reached x JOIN req USING (request_id) WHERE x.item <> req.key AND NOT EXISTS (SELECT 1 FROM nb WHERE nb.request_id = x.request_id AND nb.item = x.item AND nb.place <= nb.lim)),
nn AS (SELECT request_id, detail, anchor_type, anchor_value AS label, n.id, {_NOTE} AS content, quality, n.kind, stale, updated_at, row_number() OVER w AS r, count(*) OVER (PARTITION BY request_id, anchor_type) AS n FROM tgt t JOIN file_notes n ON (anchor_type = 'node' AND anchor_value = t.key) OR (anchor_type = 'file' AND anchor_value = t.file_path) WINDOW w AS (PARTITION BY request_id, anchor_type ORDER BY quality DESC, n.id)),
pn AS (SELECT id, {_NOTE} AS content, quality, kind, stale, updated_at, row_number() OVER (ORDER BY quality DESC, id) AS place FROM file_notes WHERE anchor_type IS NULL QUALIFY place <= 3),
vr AS (SELECT request_id, version_num, v.signature, edges_json, row_number() OVER (PARTITION BY request_id ORDER BY version_num DESC) AS place, {_level('history')} AS lim FROM req JOIN versions v ON symbol_hash = key),
vp AS (SELECT *, lead(signature) OVER w AS older, lead(edges_json) OVER w AS oe FROM vr WHERE place <= lim WINDOW w AS (PARTITION BY request_id ORDER BY place)),
sg AS (SELECT request_id, s.kind, detail_, row_number() OVER (PARTITION BY request_id ORDER BY timestamp DESC, s.kind, detail_) AS place FROM req JOIN (SELECT kind, node_id, detail AS detail_, timestamp FROM signals) s ON node_id = key),
cand AS (SELECT request_id, 'target' AS source, key AS item, signature AS content, 0 AS place, {_more()} FROM tgt
 UNION ALL SELECT request_id, source, item, signature, place, {_more()} FROM nb JOIN nodes ON nodes.key = item WHERE place <= lim
 UNION ALL SELECT request_id, 'node', item, signature, place, {_more()} FROM ext JOIN nodes ON nodes.key = item WHERE place <= lim
 UNION ALL SELECT request_id, 'note', id, content, r, {_NOTE_MORE} FROM nn WHERE (n <= 5 OR r <= 3) AND r <= CASE anchor_type WHEN 'node' THEN {_level('notes')} ELSE {_level('file_notes')} END
 UNION ALL SELECT request_id, 'note', 'more ' || label, '[+' || (n - 3) || ' more notes on ' || label || ']', 0, {_more(anchor_type="anchor_type")} FROM nn WHERE n > 5 AND r = 4
 UNION ALL SELECT request_id, 'note', id, content, place, {_more(quality="quality", kind="kind", stale="stale", updated_at="updated_at")} FROM req JOIN pn ON place <= {_level('project_notes')}
 UNION ALL SELECT request_id, 'history', 'v' || version_num, '[CHANGED] ' || CASE WHEN signature <> older THEN 'Signature changed: ' || older || ' → ' || signature WHEN edges_json <> oe THEN 'Dependencies changed' ELSE 'Body modified' END, place, {_more(distance="place", significance="CASE WHEN signature <> older THEN 1.0 WHEN edges_json <> oe THEN 0.7 ELSE 0.4 END")} FROM vp WHERE older IS NOT NULL
 UNION ALL SELECT request_id, 'signal', kind || ' ' || place, '[!] ' || kind || ': ' || detail_, place, {_more()} FROM sg WHERE place <= 5
 UNION ALL SELECT request_id, 'activity', event, content, place, {_more(updated_at="timestamp")} FROM act
 UNION ALL SELECT request_id, 'doc', id, content, place, {_more(bm25="bm25")} FROM dc JOIN req USING (request_id) WHERE place <= {_level('docs')}),
cn AS (SELECT c.*, coalesce(centrality, 0.0) AS cen FROM cand c LEFT JOIN centrality z ON z.key = c.item),
points AS (SELECT *, greatest(1, strlen(content) // 4) AS tokens, source IN ('target', 'signal', 'caller', 'callee') AS pinned, max(CASE WHEN source IN ('target', 'caller', 'callee', 'node') THEN cen END) OVER (PARTITION BY request_id) AS best FROM cn),
sco AS (SELECT *, (CASE WHEN source IN ('target', 'signal') THEN 1.0 WHEN source IN ('caller', 'callee', 'node') THEN 0.4 * cen / greatest(best, 1e-10)
 WHEN source = 'note' THEN greatest(0, least(1, (0.2 + 0.25 * CASE anchor_type WHEN 'node' THEN 1.0 WHEN 'file' THEN 0.8 ELSE 0.3 END + 0.15 * CASE WHEN updated_at IS NULL THEN 0.5 ELSE exp(-0.01 * greatest(0, ({_AS_OF} - updated_at) / 3600.0)) END + 0.2 * coalesce(quality, 0.5)) * CASE WHEN stale THEN 0.6 ELSE 1.0 END * CASE kind WHEN 'pitfall' THEN 1.2 WHEN 'strategy' THEN 1.1 WHEN 'context' THEN 0.8 ELSE 1.0 END))
 WHEN source = 'doc' THEN greatest(0, least(1, 0.7 * bm25)) WHEN source = 'history' THEN greatest(0, least(1, 0.6 * significance + 0.4 / distance)) ELSE 0.5 * exp(-0.01 * greatest(0, ({_AS_OF} - updated_at) / 3600.0)) + 0.15 END)::DOUBLE AS score FROM points),
lf AS (SELECT r.request_id, floor(r.budget * 0.9) - coalesce(sum(tokens) FILTER (pinned), 0) AS room FROM req r JOIN sco USING (request_id) GROUP BY r.request_id, r.budget),
od AS (SELECT s.*, room, row_number() OVER (PARTITION BY s.request_id ORDER BY score DESC, source, item) AS r FROM sco s JOIN lf USING (request_id) WHERE NOT pinned AND room > 0),
walk AS (SELECT request_id, 0::BIGINT AS r, 0::DOUBLE AS used, NULL::VARCHAR AS source, NULL::VARCHAR AS item, false AS kept FROM lf UNION ALL SELECT o.request_id, o.r, CASE WHEN w.used + o.tokens <= o.room THEN w.used + o.tokens ELSE w.used END, o.source, o.item, w.used + o.tokens <= o.room FROM walk w JOIN od o ON o.request_id = w.request_id AND o.r = w.r + 1),
fin AS (SELECT * FROM sco WHERE pinned UNION ALL SELECT s.* FROM sco s JOIN walk w ON w.kept AND w.request_id = s.request_id AND w.item = s.item AND w.source = s.source WHERE NOT s.pinned)"""
_RENDER_SQL = """, sec AS (SELECT request_id, CASE source WHEN 'signal' THEN 0 WHEN 'target' THEN 1 WHEN 'caller' THEN 2 WHEN 'callee' THEN 3 WHEN 'doc' THEN 5 ELSE 4 END AS s, string_agg(content, chr(10) ORDER BY CASE WHEN pinned THEN 0 ELSE 1 END, CASE WHEN pinned THEN 0 ELSE -score END, place, item) AS body, count(*) AS n FROM fin GROUP BY 1, 2),
texts AS (SELECT request_id, s, ['[!]', '[TARGET]', '[CALLERS]', '[CALLEES]', '[CONTEXT]', '[DOCUMENTATION]'][s + 1] || chr(10) || body AS text, n FROM sec),
ln AS (SELECT key, name, file_path, signature, row_number() OVER (PARTITION BY file_path ORDER BY seq) AS line FROM nodes WHERE file_path IN (SELECT file_path FROM tgt)),
bd AS (SELECT t.request_id, t.name, floor(t.budget * 0.9) AS budget, (SELECT string_agg(signature, chr(10) ORDER BY line) FROM ln x WHERE x.file_path = t.file_path AND x.line BETWEEN l.line AND l.line + 1) AS body FROM tgt t JOIN ln l USING (key) WHERE t.detail = 'detailed'),
used AS (SELECT request_id, sum(strlen(text) // 4) AS used FROM texts GROUP BY 1), whole AS (SELECT * FROM texts UNION ALL SELECT request_id, 6, '[BODY] ' || name || chr(10) || body, 0 FROM bd JOIN used USING (request_id) WHERE used + strlen(body) // 4 <= budget),
out AS (SELECT request_id, string_agg(text, chr(10) || chr(10) ORDER BY s) AS capsule, sum(n)::BIGINT AS items FROM whole GROUP BY 1)
SELECT request_id, capsule, items, strlen(capsule) // 4 AS token_count FROM out"""
_ACT = """, act AS (SELECT request_id, event_type || ' ' || event_id AS event, '[ACTIVITY] ' || event_type || ' ' || file_path AS content, timestamp, row_number() OVER (PARTITION BY request_id ORDER BY timestamp DESC, event_type || ' ' || event_id) AS place FROM (VALUES {0}) q(request_id, key, budget, detail) JOIN sessions ON detail = 'detailed' AND 'c' || k = key QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY timestamp DESC, event_id DESC) <= 3)""".format(_REQUESTS)
_VIEWS_OF_CAPSULES = "nodes links file_notes centrality signals versions markdown sessions"


def _capsules(t: Tables) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(requests, nodes, what else a capsule draws on); a request's recent activity is that at its symbol's number."""
    requests = t.spark.sql(f"select * from values {_REQUESTS} as r(request_id, key, budget, detail)")
    nodes = t.nodes.withColumn("signature_hash", C("key"))
    asked = t.spark.createDataFrame([(3, "the thing"), (6, "de")], "qid int, query string")
    chunks = r.chunk_markdown(t.markdown).withColumn("id", F.concat("file_path", F.lit("#"), C("chunk_index").cast("string")))
    hits = r.bm25(chunks.select("id", F.concat_ws(" ", F.coalesce("heading", F.lit("")), "content").alias("text")), asked)
    content = cap.doc_text(C("file_path"), C("heading"), C("content"))
    docs = hits.withColumn("bm25", C("score") / F.max("score").over(Window.partitionBy("qid"))).join(chunks.select("id", content.alias("content")), "id").select(C("qid").alias("request_id"), "id", "content", "bm25")
    reach = g.intent_traversal(t.edges, t.edges_back, requests.select(C("key").alias("start"), F.lit("extend").alias("intent")))
    reach = requests.select("request_id", C("key").alias("start")).join(reach, "start").select("request_id", C("node").alias("item"), "place")
    newest = F.row_number().over(Window.partitionBy("request_id").orderBy(C("timestamp").desc(), C("event_id").desc()))
    own = requests.filter("detail = 'detailed'").join(t.sessions, F.concat(F.lit("c"), C("k").cast("string")) == C("key")).withColumn("n", newest).filter("n <= 3")
    activity = own.select("request_id", F.concat("event_type", F.lit(" "), C("event_id").cast("string")).alias("item"), F.concat(F.lit("[ACTIVITY] "), "event_type", F.lit(" "), "file_path").alias("content"), C("timestamp").alias("updated_at"))
    return requests, nodes, {"docs": docs, "signals": t.signals, "versions": t.versions, "reach": reach, "activity": activity}


@query(_CAPSULE_SQL.replace(", req(", _ACT + ", req(", 1) + _RENDER_SQL, _VIEWS_OF_CAPSULES, recursive=True)
def capsule_sections(t: Tables) -> DataFrame:
    requests, nodes, more = _capsules(t)
    own, files = t.sources_of([row[1] for row in _request_rows()])
    kept = cap.kept_candidates(requests, nodes, t.edges, t.file_notes, t.centrality.withColumnRenamed("key", "item"), _AS_OF, **more)
    return cap.rendered(kept, cap.target_bodies(requests, own, files))


@query(_CAPSULE_SQL.replace(", req(", _ACT + ", req(", 1) + " SELECT n.id, n.retrieval_count + count(f.item) AS retrieval_count FROM notes n JOIN fin f ON f.source = 'note' AND f.item = n.id GROUP BY n.id, n.retrieval_count", _VIEWS_OF_CAPSULES, recursive=True)
def capsule_retrieval_counts(t: Tables) -> DataFrame:
    """The notes that capsules serve, with their retrieval counts raised."""
    requests, nodes, more = _capsules(t)
    kept = cap.kept_candidates(requests, nodes, t.edges, t.file_notes, t.centrality.withColumnRenamed("key", "item"), _AS_OF, **more)
    served = cut(cap.served_notes(kept))
    return memory.retrieved(t.notes.join(served, "id", "left_semi"), served).select("id", "retrieval_count")


def _request_rows() -> list[tuple]:
    return [*ast.literal_eval(f"[{_REQUESTS}]")]
