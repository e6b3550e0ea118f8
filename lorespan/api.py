"""The tool calls as batch operations on a store: capsules, annotations and document search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan.config import Settings
from lorespan import functions as fn
from lorespan.operators import capsule, graph, memory, retrieval, windows
from lorespan.operators.indexing import Index, changes
from lorespan.operators.storage import cut, kept
from lorespan.sources import LOG_LINE, Moved, Store, logged

C = F.col
#: How many rows each call gives unless told otherwise.
NOTES_LIMIT, DOCS_LIMIT, SYMBOLS_LIMIT = 20, 10, 50


class Engine:
    """Reads and writes one branch of a store. ``as_of`` is the clock, in epoch seconds."""

    def __init__(self, store: Store, as_of: int, branch: str = "main", settings: Settings = Settings()):
        self.store, self.as_of, self.branch, self.settings = store, as_of, branch, settings

    def _read(self, table: str) -> DataFrame:
        return self.store.read(table, self.branch)

    def get_capsules(self, requests: DataFrame, files: DataFrame | None = None, count: bool = True) -> DataFrame:
        """requests (request_id, file, symbol, query, budget, detail, and caps): (request_id, capsule, items, token_count).

        Caps (``max_callers``, ..., ``include_body``) are as in ``capsule.with_caps``.

        files (file_path, content) give the bodies that detailed capsules show. With ``count`` the notes that were
        served have their retrieval counts raised.

        The target is the first symbol of that name, by file and line, whose path contains the file; without a
        name, the first of a file whose path ends so. Requests without a target have no row.
        """
        nodes = self._nodes().select(C("id").alias("key"), "signature", "signature_hash", "file_path", "name", "line_start", "line_end", "centrality")
        place = F.struct("file_path", "line_start", "key")
        named = requests.join(nodes, (C("name") == C("symbol")) & C("file_path").contains(C("file")))
        whole = requests.filter("symbol is null").join(nodes, C("file_path").endswith(C("file")))
        chosen = named.select(*requests.columns, place.alias("p")).unionByName(whole.select(*requests.columns, place.alias("p"))).groupBy(*requests.columns).agg(F.min("p").alias("p"))
        caps = [c for c in requests.columns if c.startswith("max_") or c == "include_body"]
        asked = cut(chosen.select("request_id", C("p.key").alias("key"), "budget", "detail", "query", *caps))
        edges = self._read("edges").select(C("from_id").alias("src"), C("to_id").alias("dst"), "weight")
        words = asked.filter("trim(query) <> ''").select(C("request_id").alias("qid"), "query")
        chunks = self._chunks()
        hits = retrieval.bm25(self.docs_index(), words, mode="or")
        best = F.max("score").over(Window.partitionBy("qid"))
        docs = hits.withColumn("bm25", C("score") / best).join(chunks, "id").select(C("qid").alias("request_id"), "id", capsule.doc_text(C("file_path"), C("heading"), C("content")).alias("content"), "bm25")
        meant = retrieval.intents(asked.select(C("request_id").alias("qid"), F.coalesce("query", F.lit("")).alias("query")))
        starts = asked.select(C("request_id").alias("qid"), C("key").alias("start")).join(meant, "qid").select("qid", "start", "primary", "secondary")
        blocked = nodes.filter(C("name").isin(*self.settings.blocklist)).select(C("key").alias("node")) if self.settings.blocklist else None
        reach = graph.mixed_intents(edges, graph.reversed_edges(edges), starts.select("start", "primary", "secondary").distinct(), self.settings.degree_cap, self.settings.node_budget, blocked)
        reach = starts.select(C("qid").alias("request_id"), "start").join(reach, "start").groupBy("request_id", C("node").alias("item")).agg(F.min("place").alias("place"))
        notes, requests = self._read("annotations"), asked.drop("query").withColumn("budget", F.coalesce("budget", F.lit(self.settings.budget)))
        named = self.search_symbols(words).select(C("qid").alias("request_id"), C("id").alias("item"), C("combined").alias("bm25"))
        more = {"hits": named, "signals": self._read("behavioral_signals"), "versions": self._read("node_versions"), "reach": reach}
        kept = cut(capsule.kept_candidates(requests, nodes, edges, notes, nodes.select(C("key").alias("item"), "centrality"), self.as_of, docs, **more))
        if count and not kept.filter("note_id is not null").isEmpty():
            served = cut(capsule.served_notes(kept))
            self.store.update("annotations", lambda rows: memory.retrieved(rows, served), self.branch)
        return capsule.rendered(kept, None if files is None else capsule.target_bodies(requests, nodes, files))

    def _chunks(self) -> DataFrame:
        chunks = self._read("doc_chunks")
        return chunks.select(F.concat("file_path", F.lit("#"), C("chunk_index").cast("string")).alias("id"), F.concat_ws(" ", "heading", "content").alias("text"), "content", "file_path", "heading")

    def search_docs(self, queries: DataFrame, limit: int = DOCS_LIMIT) -> DataFrame:
        """queries (qid, query): (qid, rank, file_path, heading, content, score)."""
        hits = retrieval.bm25_top(self.docs_index(), queries, limit)
        return hits.join(self._chunks(), "id").select("qid", "rank", "file_path", "heading", "content", "score")

    def docs_index(self) -> retrieval.TextIndex:
        """The full-text index of the branch's document chunks, stored until their table has another version."""
        source = self.store.manifest("doc_chunks", self.branch)
        keep = lambda name, make: kept(self.store.spark, (self.store.root, self.branch, "doc_chunks", name), make, (source,))
        return retrieval.text_index(self._chunks().select("id", "text"), self.settings.block_docs, keep)

    def symbol_index(self) -> retrieval.TextIndex:
        """The full-text index of the branch's symbols (name, signature, docstring); indexing stores it and keeps it up."""
        return self._versioned_index()[0]

    def _versioned_index(self) -> tuple[retrieval.TextIndex, int, int]:
        """The symbols' index and the versions of its tables; a store from before these had an index is given one."""
        if not self.store.has("indexed", self.branch):
            self._post(self._read("nodes"))
        (table, p), (documents, d) = (self.store.versioned(t, self.branch) for t in ("postings", "indexed"))
        blocks = documents.agg(F.max("blocks")).first()[0] or 1
        return retrieval.TextIndex(table, documents.drop("blocks"), blocks), p, d

    def _post(self, nodes: DataFrame) -> None:
        """Writes the symbols' index anew."""
        index = retrieval.text_index(_symbol_text(nodes), self.settings.block_docs)
        self.store.write("postings", index.table, self.branch)
        self.store.write("indexed", index.documents.withColumn("blocks", F.lit(index.blocks)), self.branch)

    def search_symbols(self, queries: DataFrame, limit: int = SYMBOLS_LIMIT) -> DataFrame:
        """queries (qid, query): (qid, rank, id, name, kind, file_path, signature, bm25, centrality, combined) of the ``limit`` best
        by text, in order of 0.6 of the text score and 0.4 of centrality, each over its best."""
        asked = queries.select("qid", fn.sanitise(C("query")).alias("query"))
        nodes = self._nodes().select("id", "name", "kind", "file_path", "signature", "centrality")
        hits = retrieval.bm25_top(self.symbol_index(), asked, limit).drop("rank").join(nodes.select("id"), "id", "left_semi")
        both = retrieval.hybrid(hits, nodes.select("id", "centrality"), limit)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(C("combined").desc(), "id"))
        return both.select("qid", place.alias("rank"), "id", C("score").alias("bm25"), "centrality", "combined").join(nodes.drop("centrality"), "id")

    def federated_symbols(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """(repo, qid, rank, id, name, kind, file_path, signature, score): the ``limit`` best of this store, as ``""``, and of each
        registered one that is still there, each by its own counts of words; they are not ranked among each other."""
        found = None
        reachable = [r["path"] for r in self.store.verified_repos().filter("reachable").collect()]  # a registry, a few rows
        for repo in ["", *reachable]:
            one = Engine(Store(self.store.spark, repo), self.as_of, settings=self.settings) if repo else self
            hits = retrieval.bm25_top(one.symbol_index(), queries.select("qid", fn.sanitise(C("query")).alias("query")), limit)
            rows = hits.join(one._nodes().select("id", "name", "kind", "file_path", "signature"), "id").withColumn("repo", F.lit(repo))
            found = rows if found is None else found.unionByName(rows)
        return found

    def read_annotations(self, anchor_type: str | None = None, anchor_value: str | None = None, tags: str | None = None, query: str | None = None, limit: int = NOTES_LIMIT) -> DataFrame:
        """Notes of an anchor, with tags that contain a text, matching a query; newest or best first."""
        rows = self._read("annotations")
        if anchor_type is not None:
            project = C("anchor_type").isNull() | (C("anchor_type") == "project")
            rows = rows.filter(project if anchor_type == "project" else C("anchor_type") == anchor_type)
        if anchor_value is not None:
            rows = rows.filter(C("anchor_value") == anchor_value)
        if tags is not None:
            rows = rows.filter(C("tags").contains(tags))
        if query:
            asked = self.store.spark.createDataFrame([(0, query)], "qid int, query string")
            hits = retrieval.bm25(rows.select("id", F.concat_ws(" ", "text", "tags").alias("text")), asked)
            return rows.join(hits.select("id", "score"), "id").orderBy(C("score").desc(), "id").limit(limit)
        return rows.orderBy(C("updated_at").desc(), "id").limit(limit)

    def save_index(self, index: Index, notes: DataFrame | None = None) -> None:
        """Writes an index, and the notes that moved along with it, to the branch."""
        tables = {"nodes": index.nodes, "raw_edges": index.raw, "edges": index.edges, "files": index.files}
        for table, rows in (tables if notes is None else tables | {"annotations": notes}).items():
            self.store.write(table, rows, self.branch)
        self._post(index.nodes)
        if self.store.has("ranks", self.branch):  # those of the index before
            self._rerank(index.nodes.select("id"))

    def apply_changes(self, files: DataFrame) -> None:
        """Re-indexes files (file_path, content, mtime) that changed: symbols, edges, ranks and notes, once for all of them.

        What is written are the rows of these files, of callers of names in them, of ranks that differ, and the postings of
        the symbols' blocks. Postings come first, as those of symbols that are gone are found by the nodes before; the inventory
        of files comes last: where another writer was first, or this one dies, the files still count as changed, and
        all is computed anew from what is there.
        """
        while True:
            (nodes, n), (raw, r), (edges, e), (known, f), (notes, a) = (self.store.versioned(t, self.branch) for t in ("nodes", "raw_edges", "edges", "files", "annotations"))
            new = changes(Index(nodes, raw, edges, known), files, notes)
            if new.paths.isEmpty():
                return
            ends = lambda rows: rows.select(C("to_id").alias("id"))
            touched = cut(ends(edges.join(new.callers, "from_id", "left_semi")).unionByName(ends(new.edges)).unionByName(new.nodes.select("id")).distinct())
            before = notes.select("id", C("anchor_value").alias("_value"), C("stale").alias("_stale"))
            other = ~(C("anchor_value").eqNullSafe(C("_value")) & C("stale").eqNullSafe(C("_stale")))
            moved = cut(new.notes.join(before, "id").filter(other).drop("_value", "_stale"))
            index, p, d = self._versioned_index()
            text = index.renewed(_symbol_text(new.nodes), new.gone_ids)
            try:
                self.store.swap("postings", text.rows, text.touched, self.branch, p)
                self.store.swap("indexed", text.documents.withColumn("blocks", F.lit(index.blocks)), text.ids, self.branch, d)
                self.store.swap("nodes", new.nodes, new.paths, self.branch, n)
                self.store.swap("raw_edges", new.raw, new.gone_ids.select(C("id").alias("from_id")), self.branch, r)
                self.store.swap("edges", new.edges, new.callers, self.branch, e)
                if not moved.isEmpty():
                    self.store.swap("annotations", moved, moved.select("id"), self.branch, a)
                self._rerank(touched)
                self.store.swap("files", new.files, new.files.select("file_path"), self.branch, f)
                return
            except Moved:
                continue

    def _rerank(self, touched: DataFrame) -> None:
        """Brings the ranks up to date with the edges; touched (id): symbols that are new or whose callers changed."""
        old, number = self.store.versioned("ranks", self.branch)
        nodes = self._read("nodes").select(C("id").alias("node"))
        edges = self._read("edges").select(C("from_id").alias("src"), C("to_id").alias("dst"))
        ranks = cut(nodes.join(old.select(C("id").alias("node"), "weight"), "node", "left").na.fill({"weight": 0.0}))
        due = nodes if number == 0 else touched.select(C("id").alias("node"))
        new = cut(graph.pushed_ranks(edges, ranks, due).select(C("node").alias("id"), "weight"))
        gone = old.select("id").join(nodes.select(C("node").alias("id")), "id", "left_anti")
        self.store.swap("ranks", new, new.select("id").unionByName(gone), self.branch, number)

    def _nodes(self) -> DataFrame:
        """The symbols; their centrality is the kept-up rank, where there is one, else that of their indexing."""
        nodes, ranks = self._read("nodes"), self._read("ranks")
        if not self.store.has("ranks", self.branch):
            return nodes
        total = ranks.agg(F.sum("weight").alias("_total"))
        now = nodes.join(ranks, "id", "left").crossJoin(F.broadcast(total))  # of one row
        return now.withColumn("centrality", F.coalesce(C("weight") / C("_total"), "centrality")).select(*nodes.columns)

    def switch_branch(self, name: str) -> str:
        """Goes on with another branch: ``same``, ``warm`` or ``cold``."""
        found = self.store.switch_branch(name)
        self.branch = name
        return found

    def write_annotations(self, notes: DataFrame) -> int:
        """notes (id, anchor_type, anchor_value, text, tags, kind), in order of id; unknown kinds are facts. The new version."""
        kind = F.when(C("kind").isin("strategy", "pitfall", "context"), C("kind")).otherwise("fact")
        rows = notes.withColumns({"kind": kind, "quality": F.lit(0.5), "retrieval_count": F.lit(0).cast("long"), "stale": F.lit(False), "created_at": F.lit(self.as_of).cast("long"), "updated_at": F.lit(self.as_of).cast("long"), "arrived": C("id")})
        return self.store.update("annotations", lambda old: memory.upsert_notes(old, memory.with_hash(rows), "arrived"), self.branch)

    def delete_annotations(self, ids: DataFrame) -> int:
        """ids (id): the notes and their relations go."""
        for end in ("from_id", "to_id"):
            self.store.swap("annotation_edges", self._read("annotation_edges").limit(0), ids.select(C("id").alias(end)), self.branch)
        return self.store.swap("annotations", self._read("annotations").limit(0), ids.select("id"), self.branch)

    def resolve_session(self, prefix: str) -> str:
        """The session of that name, or the only one that begins so; ValueError otherwise."""
        names = self._read("session_log").select("session_id").distinct()
        found = [r[0] for r in names.filter(C("session_id").startswith(prefix)).orderBy("session_id").limit(1000).collect()]
        if prefix in found:
            return prefix
        if len(found) != 1:
            raise ValueError(f"{len(found)} sessions begin with {prefix!r}")
        return found[0]

    def session_summary(self, prefix: str) -> DataFrame:
        """The document of a session: totals, last events, active signals, stale notes."""
        own = self._read("session_log").filter(C("session_id") == self.resolve_session(prefix)).withColumn("event_id", F.monotonically_increasing_id())
        return memory.session_document(own, memory.valid_signals(self._read("behavioral_signals")), self._read("annotations"), self.as_of)

    def effectiveness(self) -> DataFrame:
        """(session_id, capsules, score): how well each session's capsules did, by what followed them."""
        scores = windows.effectiveness(self._read("capsule_log"), self._read("session_log"))
        return scores.groupBy("session_id").agg(F.count("*").alias("capsules"), F.avg("score").alias("score"))

    def metrics(self, hours: int = 24) -> DataFrame:
        """One row on the capsules of the last hours: their number, share of empty ones, tokens, and latencies in microseconds."""
        rows = memory.pruned(self._read("capsule_log"), "timestamp", self.as_of, hours)
        latency = lambda p: F.percentile("total_us", p).alias(f"p{int(p * 100)}_us")
        empty = fn.ratio(F.count_if(C("tokens_served") == 0), F.count("*"))
        return rows.agg(F.count("*").alias("capsules"), empty.alias("empty"), F.sum("tokens_served").alias("tokens"), latency(0.5), latency(0.95), latency(0.99))

    def status(self) -> DataFrame:
        """(table, rows, last_indexed) of the branch; the last only of files."""
        out = None
        for table in ("nodes", "edges", "files", "annotations", "doc_chunks", "session_log", "token_log"):
            last = F.max("last_indexed") if table == "files" else F.lit(None)
            one = self._read(table).agg(F.count("*").alias("rows"), last.cast("long").alias("last_indexed")).select(F.lit(table).alias("table"), "rows", "last_indexed")
            out = one if out is None else out.unionByName(one)
        return out


def _symbol_text(nodes: DataFrame) -> DataFrame:
    """(id, text): what is searched of a symbol, which is one row even where a file repeats it."""
    parts = [C(c) for c in ("name", "signature", "docstring") if c in nodes.columns]
    return nodes.groupBy("id").agg(F.min(F.concat_ws(" ", *parts)).alias("text"))


def estimate_without_index(files: DataFrame, ends: DataFrame, seeds: DataFrame) -> DataFrame:
    """Tokens one would read without an index: seeds (file_path), files (file_path, raw_token_estimate), ends (from_file, to_file).

    A seed's own tokens and those of the files next to it, each once.
    """
    out = ends.join(seeds.select(C("file_path").alias("from_file")), "from_file").select(C("from_file").alias("seed"), C("to_file").alias("file_path"))
    into = ends.join(seeds.select(C("file_path").alias("to_file")), "to_file").select(C("to_file").alias("seed"), C("from_file").alias("file_path"))
    own = seeds.select(C("file_path").alias("seed"), "file_path")
    reached = out.union(into).union(own).distinct()
    return reached.join(files, "file_path").groupBy("seed").agg(F.sum("raw_token_estimate").alias("tokens"))


def follow_log(spark: SparkSession, path: str, level: str = "info", method: str | None = None) -> DataFrame:
    """A growing folder of JSON logs as a stream of the lines that ``log_lines`` would show; each line once, broken ones not."""
    lines = spark.readStream.schema(LOG_LINE).option("mode", "DROPMALFORMED").json(path)
    return logged(lines, level, method)


__all__ = ["DOCS_LIMIT", "NOTES_LIMIT", "Engine", "estimate_without_index", "follow_log"]
