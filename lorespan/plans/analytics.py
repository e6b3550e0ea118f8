"""Token savings, sessions, effectiveness, latency, evaluation and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan.adapters import Tables
from lorespan.operators import signals as sig
from lorespan.operators import windows as win
from lorespan.operators.storage import cut
from lorespan.plans.registry import query

C = F.col
_SAVED = "CASE WHEN {e} = 0 THEN 0.0 ELSE round(({e} - {a}) * 100.0 / {e}, 1) END"


def _saved(actual, estimated):
    return F.round(fn.ratio((estimated - actual) * 100.0, estimated), 1)


@query(f" SELECT branch, count(*) AS calls, sum(tokens_actual)::BIGINT AS actual, sum(tokens_estimated)::BIGINT AS estimated, {_SAVED.format(a='sum(tokens_actual)', e='sum(tokens_estimated)')}::DOUBLE AS saved_pct, (sum(tokens_actual) // count(*))::BIGINT AS per_call FROM tokens GROUP BY 1", "tokens")
def token_savings(t: Tables) -> DataFrame:
    a, e = F.sum("tokens_actual"), F.sum("tokens_estimated")
    return t.tokens.groupBy("branch").agg(F.count("*").alias("calls"), a.alias("actual"), e.alias("estimated"), _saved(a, e).alias("saved_pct"), F.floor(a / F.count("*")).cast("long").alias("per_call"))


@query(" SELECT event_id, CASE WHEN tokens_estimated = 0 THEN NULL ELSE round((tokens_estimated - tokens_actual) * 100.0 / tokens_estimated, 4)::DOUBLE END AS saved_pct FROM tokens", "tokens")
def token_savings_per_call(t: Tables) -> DataFrame:
    saved = F.round(F.try_divide((C("tokens_estimated") - C("tokens_actual")) * 100.0, C("tokens_estimated")), 4)
    return t.tokens.select("event_id", saved.alias("saved_pct"))


def _grouped(rows):
    return rows.agg(F.count("*").alias("calls"), F.sum("tokens_actual").alias("actual"))


_SUMS = "SELECT branch, tool_name, count(*) AS calls, sum(tokens_actual)::BIGINT AS actual FROM tokens GROUP BY"


@query(f" {_SUMS} ROLLUP (branch, tool_name)", "tokens")
def token_savings_rollup(t: Tables) -> DataFrame:
    return _grouped(t.tokens.rollup("branch", "tool_name"))


@query(f" {_SUMS} CUBE (branch, tool_name)", "tokens")
def token_savings_cube(t: Tables) -> DataFrame:
    return _grouped(t.tokens.cube("branch", "tool_name"))


@query(f" {_SUMS} GROUPING SETS ((branch), (tool_name), ())", "tokens")
def token_savings_grouping_sets(t: Tables) -> DataFrame:
    return _grouped(t.tokens.groupingSets([["branch"], ["tool_name"], []], "branch", "tool_name")).select("branch", "tool_name", "calls", "actual")


@query(" SELECT session_id, count(*) AS events, count(DISTINCT file_path) AS files, count(DISTINCT symbol) AS symbols, max(timestamp) AS last_at FROM sessions GROUP BY 1", "sessions")
def session_summary(t: Tables) -> DataFrame:
    return t.sessions.groupBy("session_id").agg(F.count("*").alias("events"), F.countDistinct("file_path").alias("files"), F.countDistinct("symbol").alias("symbols"), F.max("timestamp").alias("last_at"))


_METRICS = """SELECT session_id, count_if(event_type = 'read') AS reads, count_if(event_type = 'grep') AS greps, count_if(event_type = 'edit') AS edits,
  count_if(event_type IN ('read', 'grep', 'miss')) AS navigation, sum(k * 4)::BIGINT AS bytes, (sum(k * 4) // 4)::BIGINT AS est_tokens, max(k)::BIGINT AS peak_context,
  min(timestamp) AS first_at, max(timestamp) AS last_at, arg_min(event_type, event_id) AS first_event, arg_max(event_type, event_id) AS last_event, max(timestamp) - min(timestamp) AS duration, count(DISTINCT file_path) AS files,
  count_if(event_type = 'miss') AS searches, count_if(event_type = 'start') AS compactions, count_if(symbol = 'sym0') AS tool_calls, CASE WHEN count_if(symbol = 'sym0') > 0 THEN 'with' ELSE 'without' END AS condition FROM sessions GROUP BY 1"""


def tool_metrics(rows: DataFrame) -> DataFrame:
    """Counts by kind and of calls of the engine's own tools (here those about sym0), bytes, peak context, files, duration, first
    and last event, and the condition (with or without the engine) of each session."""
    n = lambda *kinds: F.count_if(C("event_type").isin(*kinds))
    size = F.sum(C("k") * 4)
    return rows.groupBy("session_id").agg(
        n("read").alias("reads"), n("grep").alias("greps"), n("edit").alias("edits"), n("read", "grep", "miss").alias("navigation"), size.alias("bytes"), F.floor(size / 4).cast("long").alias("est_tokens"),
        F.max("k").alias("peak_context"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.min_by("event_type", "event_id").alias("first_event"),
        F.max_by("event_type", "event_id").alias("last_event"), (F.max("timestamp") - F.min("timestamp")).alias("duration"), F.countDistinct("file_path").alias("files"), n("miss").alias("searches"), n("start").alias("compactions"),
        F.count_if(C("symbol") == "sym0").alias("tool_calls"), F.when(F.count_if(C("symbol") == "sym0") > 0, "with").otherwise("without").alias("condition"),
    )


@query(" " + _METRICS, "sessions")
def session_tool_metrics(t: Tables) -> DataFrame:
    return tool_metrics(t.sessions)


@query(f""" , m AS ({_METRICS}), long AS (SELECT session_id, unnest(['reads', 'greps', 'edits', 'navigation', 'bytes']) AS metric, unnest([reads, greps, edits, navigation, bytes]) AS value FROM m WHERE session_id IN ('u1', 'u2')),
wide AS (SELECT metric, sum(value) FILTER (session_id = 'u1')::BIGINT AS a, sum(value) FILTER (session_id = 'u2')::BIGINT AS b FROM long GROUP BY 1)
SELECT metric, a, b, CASE WHEN a = 0 AND b = 0 THEN '' WHEN a = 0 THEN '(new)' WHEN abs((b - a) * 100.0 / a) < 0.5 THEN '' WHEN b > a THEN '+' || round((b - a) * 100.0 / a)::BIGINT || '%' ELSE round((b - a) * 100.0 / a)::BIGINT || '%' END AS delta FROM wide""", "sessions")
def ab_comparison_pivot(t: Tables) -> DataFrame:
    names = ["reads", "greps", "edits", "navigation", "bytes"]
    long = tool_metrics(t.sessions.filter(C("session_id").isin("u1", "u2"))).unpivot(["session_id"], names, "metric", "value")
    wide = long.groupBy("metric").pivot("session_id", ["u1", "u2"]).agg(F.sum("value")).toDF("metric", "a", "b")
    change = fn.ratio((C("b") - C("a")) * 100.0, C("a"))
    text = F.concat(F.when(C("b") > C("a"), "+").otherwise(""), F.round(change).cast("long").cast("string"), F.lit("%"))
    return wide.withColumn("delta", F.when((C("a") == 0) & (C("b") == 0), "").when(C("a") == 0, "(new)").when(F.abs(change) < 0.5, "").otherwise(text))


_FOLLOW = """ , near AS (SELECT c.capsule_id, s.event_type FROM capsules c JOIN sessions s ON s.session_id = c.session_id AND s.timestamp BETWEEN c.timestamp AND c.timestamp + 300 AND contains(s.file_path, c.file)),
hits AS (SELECT capsule_id, count_if(event_type = 'read') AS reads, count_if(event_type = 'grep') AS greps, count_if(event_type = 'edit') AS edits FROM near GROUP BY 1),
scored AS (SELECT c.*, coalesce(reads, 0) AS reads, coalesce(greps, 0) AS greps, coalesce(edits, 0) AS edits,
  CASE WHEN tokens_served = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, 0.5::DOUBLE - 0.15 * coalesce(reads, 0) - 0.10 * coalesce(greps, 0) + CASE WHEN coalesce(edits, 0) > 0 THEN 0.3 ELSE 0.0 END))::DOUBLE END AS score FROM capsules c LEFT JOIN hits USING (capsule_id))"""


@query(_FOLLOW + " SELECT capsule_id, reads, greps, edits, round(score, 6) AS score FROM scored", "capsules")
def followup_interval_join(t: Tables) -> DataFrame:
    return win.effectiveness(t.capsules, t.sessions.select("session_id", "event_type", "file_path", "timestamp")).select("capsule_id", "reads", "greps", "edits", F.round("score", 6).alias("score"))


@query(_FOLLOW + """ SELECT session_id, count(*) AS capsules, round(round(avg(score), 6), 2) AS score, count_if(tokens_served = 0) AS empty, round(count_if(edits > 0)::DOUBLE / count(*), 2) AS edit_rate, round(count_if(reads + greps > 1)::DOUBLE / count(*), 2) AS fallback_rate FROM scored GROUP BY 1""", "capsules")
def effectiveness_by_session(t: Tables) -> DataFrame:
    scored = win.effectiveness(t.capsules, t.sessions.select("session_id", "event_type", "file_path", "timestamp"))
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 2)
    return scored.groupBy("session_id").agg(F.count("*").alias("capsules"), F.round(F.round(F.avg("score"), 6), 2).alias("score"), F.count_if(C("tokens_served") == 0).alias("empty"), rate(C("edits") > 0).alias("edit_rate"), rate(C("reads") + C("greps") > 1).alias("fallback_rate"))


@query(""" , latest AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY timestamp DESC, event_id DESC) <= 1000),
h AS (SELECT event_type, list(value ORDER BY value) AS v FROM latest GROUP BY 1)
SELECT event_type, len(v) AS n, round(list_avg(v), 6) AS mean, v[round(0.5 * (len(v) - 1))::INT + 1] AS p50, v[round(0.95 * (len(v) - 1))::INT + 1] AS p95, v[round(0.99 * (len(v) - 1))::INT + 1] AS p99 FROM h""", "sessions")
def latency_histogram_nearest_rank(t: Tables) -> DataFrame:
    """Over the last 1,000 samples of each kind, in order of arrival."""
    last = F.row_number().over(Window.partitionBy("event_type").orderBy(C("timestamp").desc(), C("event_id").desc()))
    h = t.sessions.withColumn("r", last).filter("r <= 1000").groupBy("event_type").agg(F.sort_array(F.collect_list("value")).alias("v"), F.avg("value").alias("mean"))
    return h.select("event_type", F.size("v").cast("long").alias("n"), F.round("mean", 6).alias("mean"), *(fn.nearest_rank(C("v"), p).alias(f"p{p}") for p in (50, 95, 99)))


@query(""" SELECT session_id, round(count(*)::DOUBLE / greatest(1, (max(timestamp) - min(timestamp)) / 60.0), 6) AS per_minute, round(count_if(tokens_served = 0)::DOUBLE / count(*), 6) AS empty_rate, round(sum(tokens_served)::DOUBLE / (count(*) * 8000) * 100, 6) AS utilisation, round(1 - count(DISTINCT file)::DOUBLE / count(*), 6) AS dedup_rate FROM capsules GROUP BY 1""", "capsules")
def rates_and_utilisation(t: Tables) -> DataFrame:
    n = F.count("*")
    minutes = F.greatest(F.lit(1.0), (F.max("timestamp") - F.min("timestamp")) / 60.0)
    return t.capsules.groupBy("session_id").agg(F.round(n / minutes, 6).alias("per_minute"), F.round(F.count_if(C("tokens_served") == 0) / n, 6).alias("empty_rate"), F.round(F.sum("tokens_served") / (n * 8000) * 100, 6).alias("utilisation"), F.round(1 - F.countDistinct("file") / n, 6).alias("dedup_rate"))


def _terms_sql(column: str) -> str:
    return f"regexp_extract_all(translate(lower({column}), '{fn.FOLD_FROM}', '{fn.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), expected AS (SELECT item_id, list_distinct({_terms_sql('text')}) AS terms FROM benchmark UNION ALL SELECT -1, []),
held AS (SELECT DISTINCT item_id, unnest(list_filter(terms, lambda x: contains(lower(coalesce(d.text, '')), x))) AS term FROM n, documents d JOIN expected e ON e.item_id = d.doc_id % n.n)
SELECT e.item_id, CASE WHEN len(any_value(terms)) = 0 THEN 1.0 ELSE round(count(h.term)::DOUBLE / len(any_value(terms)), 6) END AS recall FROM expected e LEFT JOIN held h USING (item_id) GROUP BY 1""")
def eval_recall(t: Tables) -> DataFrame:
    """Share of each case's different terms that its context holds as substrings; 1 without any.

    All documents are dealt to the cases by number, and a case's context is all of its own.
    """
    cases = t.raw("benchmark").select("item_id", F.array_distinct(fn.terms(C("text"))).alias("terms"))
    cases = cases.unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("item_id"), F.array().cast("array<string>").alias("terms")))
    many = t.raw("benchmark").count()
    docs = t.raw("documents").select((C("doc_id") % many).alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("context"))
    held = docs.join(cases, "item_id").select("item_id", F.explode(F.filter("terms", lambda x: F.contains("context", x))).alias("term"))
    found = held.distinct().groupBy("item_id").agg(F.count("*").alias("n"))
    share = F.round(F.try_divide(F.coalesce("n", F.lit(0)), F.size("terms")), 6)
    return cases.join(found, "item_id", "left").select("item_id", F.when(F.size("terms") == 0, 1.0).otherwise(share).alias("recall"))


@query(""" , m AS (SELECT session_id, event_type AS metric, value / 100.0 AS value FROM sessions WHERE event_type <> 'start')
SELECT metric, count(*) AS cases, round(avg(value), 6) AS mean, count_if(value >= 0.2) AS passed, avg(value) >= 0.2 AS ok FROM m GROUP BY 1""", "sessions")
def eval_suite_averages(t: Tables) -> DataFrame:
    m = t.sessions.filter("event_type <> 'start'").select(C("event_type").alias("metric"), (C("value") / 100.0).alias("value"))
    return m.groupBy("metric").agg(F.count("*").alias("cases"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(C("value") >= 0.2).alias("passed"), (F.avg("value") >= 0.2).alias("ok"))


@query(""" SELECT session_id, query, count(*) AS misses FROM (SELECT session_id, lower(trim(CASE k % 3 WHEN 0 THEN '  ' || upper(symbol) ELSE symbol || ' ' END)) AS query FROM sessions WHERE event_type = 'miss') GROUP BY ALL HAVING count(*) >= 3""", "sessions")
def failed_search_counter(t: Tables) -> DataFrame:
    text = F.when(C("k") % 3 == 0, F.concat(F.lit("  "), F.upper("symbol"))).otherwise(F.concat("symbol", F.lit(" ")))
    misses = t.sessions.filter("event_type = 'miss'").select("session_id", F.lower(F.trim(text)).alias("query"))
    return misses.groupBy("session_id", "query").agg(F.count("*").alias("misses")).filter("misses >= 3")


@query(""" , last AS (SELECT * FROM sessions ORDER BY timestamp DESC, event_id DESC LIMIT 500), c AS (SELECT count_if(event_type = 'miss') AS errors, count_if(value < 2) AS warnings, count_if(event_type = 'read' AND k % 7 = 0) AS empty, count_if(event_type = 'read') AS reads FROM last)
SELECT *, round(100.0 * ((errors < 50)::INT + (warnings < 20)::INT + (empty * 2 < reads)::INT) / 3)::BIGINT AS score FROM c""", "sessions")
def log_health_score(t: Tables) -> DataFrame:
    last = t.sessions.orderBy(C("timestamp").desc(), C("event_id").desc()).limit(500)
    c = last.agg(F.count_if(C("event_type") == "miss").alias("errors"), F.count_if(C("value") < 2).alias("warnings"), F.count_if((C("event_type") == "read") & (C("k") % 7 == 0)).alias("empty"), F.count_if(C("event_type") == "read").alias("reads"))
    passed = (C("errors") < 50).cast("int") + (C("warnings") < 20).cast("int") + (C("empty") * 2 < C("reads")).cast("int")
    return c.withColumn("score", F.round(passed * 100.0 / 3).cast("long"))


@query()
def approx_distinct_users(t: Tables) -> DataFrame:
    return t.sessions.groupBy("event_type").agg(F.approx_count_distinct("session_id", 0.01).alias("sessions"))


_VERSIONS = """ , v AS (SELECT o_custkey AS symbol, o_orderkey, 'sig' || (o_orderkey % 3) AS signature_hash, o_orderpriority AS edges_json, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_num FROM orders)"""


def _versions(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(C("o_custkey").alias("symbol"), "o_orderkey", F.concat(F.lit("sig"), (C("o_orderkey") % 3).cast("string")).alias("signature_hash"), C("o_orderpriority").alias("edges_json"))
    return win.numbered_versions(rows, "symbol", [C("o_orderkey")])


@query("WITH " + _VERSIONS[3:] + " SELECT symbol, o_orderkey, version_num FROM v")
def version_numbering(t: Tables) -> DataFrame:
    return _versions(t).select("symbol", "o_orderkey", C("version_num").cast("long").alias("version_num"))


@query("WITH " + _VERSIONS[3:] + " SELECT symbol, max(version_num) AS version_num FROM v GROUP BY 1")
def version_max(t: Tables) -> DataFrame:
    return _versions(t).groupBy("symbol").agg(F.max("version_num").cast("long").alias("version_num"))


@query("WITH " + _VERSIONS[3:] + " SELECT symbol, version_num FROM v QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY version_num DESC) <= 5")
def version_keep_last5(t: Tables) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(C("version_num").desc()))
    return _versions(t).withColumn("r", newest).filter("r <= 5").select("symbol", C("version_num").cast("long").alias("version_num"))


@query("WITH " + _VERSIONS[3:] + """ SELECT symbol, version_num, distance, significance, round(0.6 * significance + 0.4 / distance, 6) AS score FROM (
  SELECT symbol, version_num, row_number() OVER w AS distance, lead(version_num) OVER w AS older, CASE WHEN signature_hash <> lead(signature_hash) OVER w THEN 1.0 WHEN edges_json <> lead(edges_json) OVER w THEN 0.7 ELSE 0.4 END::DOUBLE AS significance FROM v WINDOW w AS (PARTITION BY symbol ORDER BY version_num DESC)) WHERE older IS NOT NULL""")
def version_adjacent_diff(t: Tables) -> DataFrame:
    changes = win.version_changes(_versions(t), "symbol")
    return changes.select("symbol", C("version_num").cast("long").alias("version_num"), C("distance").cast("long").alias("distance"), "significance", F.round(0.6 * C("significance") + 0.4 / C("distance"), 6).alias("score"))


@query(""" , l AS (SELECT *, CASE WHEN 1 - levenshtein(lag(checksum) OVER w, checksum) / 32.0 > 0.9 THEN 1 ELSE 0 END AS close FROM edits WINDOW w AS (PARTITION BY node ORDER BY timestamp, event_id)),
x AS (SELECT event_id, node, count(*) OVER r AS n, sum(close) OVER r - (min([timestamp, event_id, close]) OVER r)[3] AS pairs FROM l WINDOW r AS (PARTITION BY node ORDER BY timestamp RANGE BETWEEN 300 PRECEDING AND CURRENT ROW))
SELECT event_id, node, n, pairs::BIGINT AS pairs FROM x WHERE n >= 3 AND pairs >= 2""", "edits")
def thrash_sliding_5min(t: Tables) -> DataFrame:
    return sig.thrashing(t.edits).select("event_id", "node", "n", "pairs")


_CROWDED = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session_id, file_path ORDER BY timestamp RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS n FROM edits) WHERE n >= 5"


@query(f" SELECT event_id, session_id, file_path, n FROM ({_CROWDED})", "edits")
def thrash_post_hoc(t: Tables) -> DataFrame:
    return sig.crowded(t.edits, ["session_id", "file_path"]).select("event_id", "session_id", "file_path", "n")


_CHURN = """e AS (SELECT DISTINCT file_path, session_id, timestamp FROM sessions WHERE event_type = 'edit'),
n AS (SELECT a.file_path, a.timestamp, count(DISTINCT b.session_id) AS sessions FROM e a JOIN e b ON a.file_path = b.file_path AND b.timestamp BETWEEN a.timestamp - 1814400 AND a.timestamp GROUP BY 1, 2),
churned AS (SELECT file_path, max(sessions) AS sessions FROM n GROUP BY 1 HAVING max(sessions) >= 3)"""


def _churned(t: Tables) -> DataFrame:
    """Files that at least three sessions edited within some three weeks."""
    most = sig.most_at_once(t.sessions.filter("event_type = 'edit'"), "file_path", "session_id", 1814400)
    return most.filter("most >= 3").select("file_path", C("most").alias("sessions"))


@query(f" , {_CHURN} SELECT file_path, sessions FROM churned", "sessions")
def churn_rolling_3w(t: Tables) -> DataFrame:
    return _churned(t)


_HOT = """churn AS (SELECT file_path, count(DISTINCT session_id) AS churn FROM sessions WHERE event_type = 'edit' GROUP BY 1), central AS (SELECT 'f' || substr(key, 2) AS file_path, centrality FROM centrality WHERE key LIKE 'p%'),
pair AS (SELECT file_path, churn, centrality FROM churn JOIN central USING (file_path)), mid AS (SELECT quantile_cont(churn, 0.5) AS c, quantile_cont(centrality, 0.5) AS r FROM pair), hot AS (SELECT file_path, churn * centrality AS heat FROM pair, mid WHERE churn > c AND centrality > r)"""


def _hotspots(t: Tables) -> DataFrame:
    """A session's file f1 is the file of symbol p1."""
    churn = t.sessions.filter("event_type = 'edit'").groupBy("file_path").agg(F.countDistinct("session_id").alias("churn"))
    central = t.centrality.filter(C("key").startswith("p")).select(F.concat(F.lit("f"), F.substring("key", 2, 99)).alias("file_path"), "centrality")
    return sig.hotspots(churn, central)


@query(f" , {_HOT} SELECT file_path, round(heat * 1e6, 4) AS heat FROM hot", "sessions centrality")
def hotspot_above_median(t: Tables) -> DataFrame:
    return _hotspots(t).select("file_path", F.round(C("heat") * 1e6, 4).alias("heat"))


@query(f""" , {_CHURN}, {_HOT}, edited AS (SELECT DISTINCT session_id, file_path FROM sessions WHERE event_type = 'edit'),
found AS (SELECT session_id, 2.0 * CASE WHEN file_path IN (SELECT file_path FROM hot) THEN 1.5 ELSE 1.0 END AS w FROM (SELECT DISTINCT session_id, file_path FROM ({_CROWDED}))
UNION ALL SELECT session_id, 2.0 * 1.3 FROM capsules WHERE tokens_served = 0
UNION ALL SELECT session_id, 2.0 FROM (SELECT session_id, query FROM (SELECT session_id, lower(trim(CASE k % 3 WHEN 0 THEN '  ' || upper(symbol) ELSE symbol || ' ' END)) AS query FROM sessions WHERE event_type = 'miss') GROUP BY ALL HAVING count(*) >= 3)
UNION ALL SELECT session_id, 1.0 FROM edited JOIN churned USING (file_path) UNION ALL SELECT session_id, 1.0 FROM edited JOIN hot USING (file_path))
SELECT session_id, count(*) AS signals, round(sum(w)::DOUBLE, 6) AS triage FROM found GROUP BY 1""", "sessions edits capsules centrality")
def session_triage(t: Tables) -> DataFrame:
    """Signals of each session: its thrashed files, empty capsules and failed searches, and churned or hot files that it edited."""
    hot = cut(_hotspots(t).select("file_path"))
    edited = t.sessions.filter("event_type = 'edit'").select("session_id", "file_path").distinct()
    none = F.lit(None).cast("string")
    signal = lambda rows, kind, path=none, effect=F.lit(None).cast("double"): rows.select("session_id", F.lit(kind).alias("kind"), path.alias("file_path"), effect.alias("effectiveness"))
    thrashed = sig.crowded(t.edits, ["session_id", "file_path"]).select("session_id", "file_path").distinct()
    found = signal(thrashed, "THRASHING", C("file_path"))
    found = found.unionByName(signal(t.capsules.filter("tokens_served = 0"), "EMPTY_CAPSULE", effect=F.lit(0.0)))
    found = found.unionByName(signal(failed_search_counter(t), "FAILED_SEARCH"))
    found = found.unionByName(signal(edited.join(_churned(t), "file_path"), "CHURN")).unionByName(signal(edited.join(hot, "file_path"), "HOTSPOT"))
    return sig.triage(found, hot).withColumn("triage", F.round("triage", 6))


@query(" SELECT timestamp // 60 * 60 AS minute, count(*) AS n, round(sum(value), 6) AS total FROM sessions GROUP BY 1", "sessions")
def tumbling_snapshots(t: Tables) -> DataFrame:
    return t.sessions.groupBy((F.floor(C("timestamp") / 60) * 60).alias("minute")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(""" SELECT start, session_id, count(*) AS n FROM (SELECT session_id, unnest([timestamp // 60 * 60 - 240, timestamp // 60 * 60 - 180, timestamp // 60 * 60 - 120, timestamp // 60 * 60 - 60, timestamp // 60 * 60]) AS start FROM sessions WHERE event_type = 'edit') GROUP BY ALL""", "sessions")
def sliding_edits(t: Tables) -> DataFrame:
    """Edits in five-minute windows that begin every minute."""
    w = F.window(F.timestamp_seconds("timestamp"), "5 minutes", "1 minute")
    edits = t.sessions.filter("event_type = 'edit'").groupBy(w.alias("w"), "session_id").agg(F.count("*").alias("n"))
    return edits.select(F.unix_timestamp("w.start").alias("start"), "session_id", "n")


@query(""" , g AS (SELECT session_id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER w < 7200 THEN 0 ELSE 1 END AS fresh, event_id FROM sessions WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS run FROM g) SELECT session_id, min(timestamp) AS first_at, max(timestamp) + 7200 AS ends_at, count(*) AS n FROM r GROUP BY session_id, run""", "sessions")
def sessionised_events(t: Tables) -> DataFrame:
    return win.session_runs(t.sessions, "session_id", "timestamp", "event_id", 7200)
