"""The supplied relational tables seen as the engine's domain tables, in Spark and, for checks, in DuckDB.

Times are epoch seconds; ``events.ts`` has no zone, so differences are taken from a zoneless epoch and do not
depend on the session's time zone.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan.operators.storage import kept, tasks

EPOCH = 1704067200
SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a zoneless timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


class Tables:
    """One scale's directory; every member is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        """key, kind, name, file_path, signature, seq, id, signature_hash, checksum (of the signature)."""
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        c = F.col

        def part(rows, key, kind, name, path, signature, seq):
            return rows.select(key.alias("key"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("file_path"), signature.alias("signature"), seq.cast("long").alias("seq"))

        parts = [
            part(self.raw("region"), text("r", c("r_regionkey")), "Module", c("r_name"), text("world/regions.rs"), text("mod ", c("r_name")), c("r_regionkey")),
            part(self.raw("nation"), text("n", c("n_nationkey")), "Class", c("n_name"), text("region/", c("n_regionkey"), ".rs"), text("struct ", c("n_name")), c("n_nationkey") + 100),
            part(self.raw("supplier"), text("s", c("s_suppkey")), "Interface", c("s_name"), text("nation/", c("s_nationkey"), ".ts"), text("interface ", c("s_name"), "(nation: ", c("s_nationkey"), ")"), c("s_suppkey") + 1000000),
            part(self.raw("customer"), text("c", c("c_custkey")), "Function", c("c_name"), text("segment/", F.lower("c_mktsegment"), ".py"), text("def ", c("c_name"), "(nation: int) -> ", c("c_mktsegment")), c("c_custkey") + F.lit(2000000000)),
            part(self.raw("part"), text("p", c("p_partkey")), "Method", c("p_name"), text("part/", F.replace(c("p_brand"), F.lit("#"), F.lit("_")), ".go"), text("func ", F.replace(c("p_name"), F.lit(" "), F.lit("_")), "_", c("p_partkey"), "(type: ", c("p_type"), ", size: ", c("p_size"), ")"), c("p_partkey") + F.lit(4000000000)),
        ]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.withColumns({"id": fn.node_id(c("file_path"), c("name"), c("signature")), "signature_hash": fn.signature_hash(c("signature")), "checksum": F.md5("signature")})

    @cached_property
    def links(self) -> DataFrame:
        """from_key, to_key, kind, weight: containment, and calls weighed by line items."""
        key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
        holds = lambda t, a, b: self.raw(t).select(a.alias("from_key"), b.alias("to_key"), F.lit("Contains").alias("kind"), F.lit(1.0).alias("weight"))
        lines = self.raw("lineitem")
        n = tasks(lines)
        called = lines.repartition(n, "l_orderkey").join(self.raw("orders").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        # dealt by caller alone, as numbers, so that equal pairs meet and the links of a caller stay together
        calls = lambda rows, prefix, a: rows.select(a, "l_partkey").repartition(n, a).groupBy(a, "l_partkey").agg(F.count("*").cast("double").alias("weight")).select(key(prefix, a).alias("from_key"), key("p", "l_partkey").alias("to_key"), F.lit("Calls").alias("kind"), "weight")
        return (
            holds("nation", key("n", "n_nationkey"), key("r", "n_regionkey"))
            .unionByName(holds("supplier", key("s", "s_suppkey"), key("n", "s_nationkey")))
            .unionByName(holds("customer", key("c", "c_custkey"), key("n", "c_nationkey")))
            .unionByName(calls(lines, "s", "l_suppkey"))
            .unionByName(calls(called, "c", "o_custkey"))
        )

    def _kept(self, name: str, make) -> DataFrame:
        """A table derived from the graph's tables, stored until one of their files changes."""
        graph = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")
        return kept(self.spark, (self.sf_dir, name), make, tuple(f"{self.sf_dir}/{t}.parquet" for t in graph))

    @cached_property
    def edges(self) -> DataFrame:
        """The links as src, dst, kind, weight, stored by src (each caller's calls lie together already): what traversals and ranks read."""
        own = lambda: self.links.select(F.col("from_key").alias("src"), F.col("to_key").alias("dst"), "kind", "weight").sortWithinPartitions("src")
        return self._kept("edges", own)

    @cached_property
    def edges_back(self) -> DataFrame:
        """The same links turned round (src is called by dst), stored by src."""
        own = lambda: self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "weight").repartition("src").sortWithinPartitions("src")
        return self._kept("edges_back", own)

    @cached_property
    def centrality(self) -> DataFrame:
        """key, centrality: PageRank of 30 rounds, stored as indexing stores it with the nodes."""
        from lorespan.operators.graph import pagerank

        own = lambda: pagerank(self.edges.select("src", "dst"), self.nodes.select(F.col("key").alias("node")), parallel=False).select(F.col("node").alias("key"), F.col("rank").alias("centrality"))
        return self._kept("centrality", own)

    @cached_property
    def symbol_index(self):
        """The full-text index of the symbols (name and signature), stored as indexing stores it."""
        from lorespan.operators.retrieval import text_index

        docs = self.nodes.select(F.col("key").alias("id"), F.concat_ws(" ", "name", "signature").alias("text"))
        return text_index(docs, keep=lambda name, make: self._kept(f"symbol_{name}", make))

    @cached_property
    def edits(self) -> DataFrame:
        """Dense edits for the detectors, from events: session_id, node, file_path, timestamp, checksum, event_id.

        An event's hours are taken as seconds, so that bursts arise; checksums alternate between few contents.
        """
        user = F.substring("session_id", 2, 99).cast("long") % 500
        node = F.concat(F.lit("n"), user.cast("string"), F.lit("_"), (F.col("k") % 5).cast("string"))
        file = F.concat(F.lit("f"), (F.col("k") % 4).cast("string"))
        return self.sessions.select("session_id", node.alias("node"), file.alias("file_path"), F.floor(F.col("timestamp") / 3600).cast("long").alias("timestamp"), F.md5((F.col("k") % 3).cast("string")).alias("checksum"), "event_id")

    def symbols(self, new: bool) -> DataFrame:
        """Symbols of a re-indexed file before or after (``new``) the change: id, name, signature, checksum, file_path, block, neighbours.

        Parts of one brand, type and size class are a block of candidates, their suppliers the neighbours. Of four parts,
        one is renamed, one takes another parameter and returns nothing, one moves to another file, one stays.
        """
        c, kind = F.col, F.col("p_partkey") % 4
        name = F.when(kind == 0, F.concat("p_name", F.lit(" two"))).otherwise(c("p_name")) if new else c("p_name")
        before = F.concat(F.lit("func "), F.replace(c("p_name"), F.lit(" "), F.lit("_")), F.lit("(type: "), "p_type", F.lit(", size: "), c("p_size").cast("string"), F.lit(") -> "), "p_brand")
        after = F.concat(F.lit("func "), F.replace(c("p_name"), F.lit(" "), F.lit("_")), F.lit("(type: "), "p_type", F.lit(", weight: "), c("p_size").cast("string"), F.lit(")"))
        signature = F.when(kind == 1, after).otherwise(before) if new else before
        block = F.concat_ws("/", "p_brand", "p_type", F.floor(c("p_size") / 2).cast("string"))
        path = F.when(kind == 2, F.concat(block, F.lit("/moved"))).otherwise(block) if new else block
        lines = self.raw("lineitem").filter("l_suppkey % 3 > 0") if new else self.raw("lineitem")
        near = lines.groupBy(c("l_partkey").alias("p_partkey")).agg(F.collect_set("l_suppkey").alias("neighbours"))
        rows = self.raw("part").join(near, "p_partkey", "left")
        return rows.select(c("p_partkey").alias("id"), name.alias("name"), signature.alias("signature"), F.md5(before).alias("checksum"), path.alias("file_path"), block.alias("block"), F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))

    @cached_property
    def sessions(self) -> DataFrame:
        """session_id, event_type, file_path, symbol, timestamp, event_id, value, k."""
        kinds = {"view": "read", "click": "grep", "purchase": "edit", "error": "miss", "signup": "start"}
        kind = F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("event_type"))
        k = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), kind.alias("event_type"),
            F.concat(F.lit("f"), k.cast("string")).alias("file_path"), F.concat(F.lit("sym"), (k % 10).cast("string")).alias("symbol"),
            seconds(F.col("ts")).alias("timestamp"), "event_id", "value", k.alias("k"),
        )

    @cached_property
    def tokens(self) -> DataFrame:
        """token_log: timestamp, session_id, branch, tool_name, tokens_actual, tokens_estimated, event_id."""
        branch = F.element_at(F.array(*map(F.lit, ("main", "dev", "exp"))), (F.col("event_id") % 3 + 1).cast("int"))
        return self.sessions.select("timestamp", "session_id", branch.alias("branch"), F.col("event_type").alias("tool_name"), F.floor(F.col("value") * 10).cast("long").alias("tokens_actual"), (F.col("k") * 40).alias("tokens_estimated"), "event_id")

    @cached_property
    def capsules(self) -> DataFrame:
        """capsule_log of the reads: capsule_id, timestamp, session_id, file, tokens_served, total_us."""
        served = F.when(F.col("k") % 7 == 0, F.lit(0)).otherwise(F.floor(F.col("value") * 100)).cast("long")
        return self.sessions.filter("event_type = 'read'").select(F.col("event_id").alias("capsule_id"), "timestamp", "session_id", F.col("file_path").alias("file"), served.alias("tokens_served"), F.floor(F.col("value") * 1000).cast("long").alias("total_us"))

    @cached_property
    def notes(self) -> DataFrame:
        """annotations, from conversation turns."""
        c, turn = F.col, F.col("turn") % 4
        value = F.when(turn == 0, F.concat(F.lit("c"), (c("conv_id") * 17 % 2000).cast("string"))).when(turn == 1, F.concat(F.lit("f"), (c("conv_id") % 50).cast("string"))).when(turn == 2, c("role"))
        kind = F.element_at(F.array(*map(F.lit, ("fact", "strategy", "pitfall", "context"))), (c("conv_id") % 4 + 1).cast("int"))
        return self.raw("conversations").select(
            F.concat(F.lit("a"), c("conv_id").cast("string"), F.lit("_"), c("turn").cast("string")).alias("id"),
            F.when(turn == 0, "node").when(turn == 1, "file").when(turn == 2, "scope").alias("anchor_type"), value.alias("anchor_value"), "text",
            F.concat(c("role"), F.lit(",t"), (c("conv_id") % 5).cast("string")).alias("tags"), (c("conv_id") % 9 == 0).alias("stale"),
            (F.lit(EPOCH) + c("conv_id") * 3600).alias("created_at"), (F.lit(EPOCH) + c("conv_id") * 3600 + c("turn") * 600).alias("updated_at"),
            kind.alias("kind"), ((c("conv_id") * 37 + c("turn") * 11) % 100 / 100.0).cast("double").alias("quality"), ((c("conv_id") * 13 + c("turn")) % 20).alias("retrieval_count"),
        )

    @cached_property
    def file_notes(self) -> DataFrame:
        """The notes, those on files being on the graph's files."""
        path = F.concat(F.lit("segment/"), F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.substring("anchor_value", 2, 9).try_cast("int") % len(SEGMENTS) + 1)), F.lit(".py"))
        return self.notes.withColumn("anchor_value", F.when(F.col("anchor_type") == "file", path).otherwise(F.col("anchor_value")))

    @cached_property
    def signals(self) -> DataFrame:
        """behavioural signals: kind, node_id, detail, timestamp, of misses and edits of a file at the symbol of its number."""
        kind = F.when(F.col("event_type") == "miss", "FAILED_SEARCH").otherwise("THRASHING")
        return self.sessions.filter("event_type in ('miss', 'edit')").select(kind.alias("kind"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("node_id"), F.concat("file_path", F.lit(" "), F.col("event_id").cast("string")).alias("detail"), "timestamp")

    @cached_property
    def versions(self) -> DataFrame:
        """node versions of customers, an order being one: symbol_hash, version_num, signature, edges_json."""
        number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        return self.raw("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("symbol_hash"), number.alias("version_num"), F.concat(F.lit("sig"), (F.col("o_orderkey") % 3).cast("string")).alias("signature"), F.col("o_orderpriority").alias("edges_json"))

    def sources_of(self, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """(nodes with line_start and line_end, files): the files of the given symbols, a line a symbol, a body two lines."""
        own = self.nodes.join(self.nodes.filter(F.col("key").isin(*keys)).select("file_path").distinct(), "file_path")
        line = F.row_number().over(Window.partitionBy("file_path").orderBy("seq"))
        own = own.withColumn("line_start", line).withColumn("line_end", line + 1)
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_start", "signature"))), lambda x: x["signature"]), "\n")
        return own.filter(F.col("key").isin(*keys)), own.groupBy("file_path").agg(text.alias("content"))

    @cached_property
    def files(self) -> DataFrame:
        """file inventory: documents as markdown, pages as code."""
        docs = self.raw("documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("text").alias("content"))
        pages = self.raw("pages").select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".js")).alias("file_path"), F.col("html").alias("content"))
        both = docs.unionByName(pages)
        return both.select("file_path", F.when(F.col("file_path").endswith(".md"), "doc").otherwise("code").alias("file_type"), fn.token_estimate(F.col("content")).alias("raw_token_estimate"), F.md5("content").alias("content_hash"))

    @cached_property
    def markdown(self) -> DataFrame:
        """file_path, content: pages with headings as markdown and other tags as line ends."""
        heads = F.regexp_replace("html", r"<h[1-6][^>]*>", "\n# ")
        return self.raw("pages").select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file_path"), F.regexp_replace(heads, r"<[^>]+>", "\n").alias("content"))


#: DuckDB twins of the members above, to be used as common table expressions; each names what it needs.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "nodes": ((), """
      SELECT *, md5(file_path || chr(0) || name || chr(0) || signature) AS id,
        substr(md5(trim(regexp_replace(signature, '\\s+', ' ', 'g'))), 1, 8) AS signature_hash, md5(signature) AS checksum
      FROM (
        SELECT 'r' || r_regionkey AS key, 'Module' AS kind, r_name AS name, 'world/regions.rs' AS file_path, 'mod ' || r_name AS signature, r_regionkey::BIGINT AS seq FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'Class', n_name, 'region/' || n_regionkey || '.rs', 'struct ' || n_name, n_nationkey + 100 FROM nation
        UNION ALL SELECT 's' || s_suppkey, 'Interface', s_name, 'nation/' || s_nationkey || '.ts', 'interface ' || s_name || '(nation: ' || s_nationkey || ')', s_suppkey + 1000000 FROM supplier
        UNION ALL SELECT 'c' || c_custkey, 'Function', c_name, 'segment/' || lower(c_mktsegment) || '.py', 'def ' || c_name || '(nation: int) -> ' || c_mktsegment, c_custkey + 2000000000 FROM customer
        UNION ALL SELECT 'p' || p_partkey, 'Method', p_name, 'part/' || replace(p_brand, '#', '_') || '.go', 'func ' || replace(p_name, ' ', '_') || '_' || p_partkey || '(type: ' || p_type || ', size: ' || p_size || ')', p_partkey + 4000000000 FROM part)"""),
    "links": ((), """
      SELECT 'n' || n_nationkey AS from_key, 'r' || n_regionkey AS to_key, 'Contains' AS kind, 1.0::DOUBLE AS weight FROM nation
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'Contains', 1.0 FROM supplier
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'Contains', 1.0 FROM customer
      UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'Calls', count(*)::DOUBLE FROM lineitem GROUP BY 1, 2
      UNION ALL SELECT 'c' || o_custkey, 'p' || l_partkey, 'Calls', count(*)::DOUBLE FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""),
    "sessions": ((), """
      SELECT 'u' || user_id AS session_id,
        CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'grep' WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'miss' WHEN 'signup' THEN 'start' END AS event_type,
        'f' || k AS file_path, 'sym' || (k % 10) AS symbol, floor(epoch(ts))::BIGINT AS timestamp, event_id, value, k
      FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""),
    "edits": (("sessions",), """
      SELECT session_id, 'n' || (substr(session_id, 2)::BIGINT % 500) || '_' || (k % 5) AS node, 'f' || (k % 4) AS file_path, timestamp // 3600 AS timestamp, md5((k % 3)::VARCHAR) AS checksum, event_id FROM sessions"""),
    "old_symbols": ((), """
      SELECT p_partkey AS id, p_name AS name, 'func ' || replace(p_name, ' ', '_') || '(type: ' || p_type || ', size: ' || p_size || ') -> ' || p_brand AS signature,
        p_brand || '/' || p_type || '/' || (p_size // 2) AS file_path, file_path AS block, coalesce(near, []) AS neighbours
      FROM part LEFT JOIN (SELECT l_partkey, list_distinct(list(l_suppkey)) AS near FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""),
    "new_symbols": (("old_symbols",), """
      SELECT id, CASE WHEN id % 4 = 0 THEN name || ' two' ELSE name END AS name, CASE WHEN id % 4 = 1 THEN regexp_replace(replace(signature, ', size: ', ', weight: '), ' -> .*$', '') ELSE signature END AS signature, signature AS before,
        CASE WHEN id % 4 = 2 THEN block || '/moved' ELSE block END AS file_path, block, list_filter(neighbours, lambda x: x % 3 > 0) AS neighbours FROM old_symbols"""),
    "tokens": (("sessions",), """
      SELECT timestamp, session_id, ['main', 'dev', 'exp'][event_id % 3 + 1] AS branch, event_type AS tool_name,
        floor(value * 10)::BIGINT AS tokens_actual, k * 40 AS tokens_estimated, event_id FROM sessions"""),
    "capsules": (("sessions",), """
      SELECT event_id AS capsule_id, timestamp, session_id, file_path AS file,
        CASE WHEN k % 7 = 0 THEN 0 ELSE floor(value * 100)::BIGINT END AS tokens_served, floor(value * 1000)::BIGINT AS total_us
      FROM sessions WHERE event_type = 'read'"""),
    "notes": ((), f"""
      SELECT 'a' || conv_id || '_' || turn AS id,
        CASE turn % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'file' WHEN 2 THEN 'scope' END AS anchor_type,
        CASE turn % 4 WHEN 0 THEN 'c' || (conv_id * 17 % 2000) WHEN 1 THEN 'f' || (conv_id % 50) WHEN 2 THEN role END AS anchor_value,
        text, role || ',t' || (conv_id % 5) AS tags, conv_id % 9 = 0 AS stale, {EPOCH} + conv_id * 3600 AS created_at,
        {EPOCH} + conv_id * 3600 + turn * 600 AS updated_at, ['fact', 'strategy', 'pitfall', 'context'][conv_id % 4 + 1] AS kind,
        ((conv_id * 37 + turn * 11) % 100) / 100.0::DOUBLE AS quality, (conv_id * 13 + turn) % 20 AS retrieval_count
      FROM conversations"""),
    "file_notes": (("notes",), f"""
      SELECT * REPLACE (CASE WHEN anchor_type = 'file' THEN 'segment/' || {[*SEGMENTS]}[substr(anchor_value, 2)::INT % {len(SEGMENTS)} + 1] || '.py' ELSE anchor_value END AS anchor_value) FROM notes"""),
    "signals": (("sessions",), """
      SELECT CASE event_type WHEN 'miss' THEN 'FAILED_SEARCH' ELSE 'THRASHING' END AS kind, 'c' || k AS node_id, file_path || ' ' || event_id AS detail, timestamp FROM sessions WHERE event_type IN ('miss', 'edit')"""),
    "versions": ((), """
      SELECT 'c' || o_custkey AS symbol_hash, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_num, 'sig' || (o_orderkey % 3) AS signature, o_orderpriority AS edges_json FROM orders"""),
    "files": ((), """
      SELECT file_path, CASE WHEN file_path LIKE '%.md' THEN 'doc' ELSE 'code' END AS file_type,
        strlen(content) // 4 AS raw_token_estimate, md5(content) AS content_hash
      FROM (SELECT 'docs/' || doc_id || '.md' AS file_path, text AS content FROM documents
            UNION ALL SELECT 'web/' || page_id || '.js', html FROM pages)"""),
    "markdown": ((), """
      SELECT 'web/' || page_id || '.md' AS file_path,
        regexp_replace(regexp_replace(html, '<h[1-6][^>]*>', chr(10) || '# ', 'g'), '<[^>]+>', chr(10), 'g') AS content FROM pages"""),
}


def rank_steps(rounds: int, reference: bool = True) -> str:
    """Common table expressions that end in ranked(node, rank): PageRank round by round over views nodes and links."""
    text = """e AS MATERIALIZED (SELECT from_key AS src, to_key AS dst FROM links), deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY 1), share AS MATERIALIZED (SELECT e.src, e.dst, deg FROM e JOIN deg USING (src)),
base AS MATERIALIZED (SELECT key AS node, deg IS NULL AS dangling, (SELECT count(*) FROM nodes)::DOUBLE AS n FROM nodes LEFT JOIN deg ON src = key), r0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE / n AS rank FROM base)"""
    for k in range(rounds):
        jump = "(s.nd - coalesce(i.linked, 0))" if reference else "(s.nd + s.d)"
        text += f""", i{k} AS MATERIALIZED (SELECT e.dst AS node, sum(r.rank / e.deg) AS inc, sum(r.rank) AS linked FROM share e JOIN r{k} r ON r.node = e.src GROUP BY 1)
, s{k} AS MATERIALIZED (SELECT sum(CASE WHEN dangling THEN rank ELSE 0 END) AS d, sum(CASE WHEN dangling THEN 0 ELSE rank END) AS nd FROM r{k}), q{k} AS MATERIALIZED (SELECT b.*, 0.85 * coalesce(i.inc, 0) + 0.85 * s.d / b.n + 0.15 / b.n * {jump} AS rank FROM base b LEFT JOIN i{k} i USING (node), s{k} s)
, r{k + 1} AS MATERIALIZED (SELECT node, dangling, n, {'rank / sum(rank) OVER ()' if reference else 'rank'} AS rank FROM q{k})"""
    return text + f", ranked AS MATERIALIZED (SELECT node, rank FROM r{rounds})"


VIEWS["centrality"] = ("nodes", "links"), f"WITH {rank_steps(30)} SELECT node AS key, rank AS centrality FROM ranked"


def with_views(names: str, recursive: bool = False) -> str:
    """``WITH ...`` defining the named views and what they need."""
    order: list[str] = []

    def put(name: str) -> None:
        for need in VIEWS[name][0]:
            put(need)
        if name not in order:
            order.append(name)

    for n in names.split():
        put(n)
    return "WITH " + "RECURSIVE " * recursive + ", ".join(f"{n} AS {'MATERIALIZED ' * (n == 'centrality')}({VIEWS[n][1]})" for n in order)
