"""Text retrieval: chunking, postings, BM25 with phrases and prefixes, hybrid ranking, intents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lorespan import functions as fn
from lorespan.operators.storage import cut

C = F.col

#: The words and phrases that speak for each intent, intents in order of precedence.
KEYWORDS = {
    "debug": ("error", "bug", "fix", "crash", "failing", "broken", "traceback", "panic", "why is"),
    "refactor": ("refactor", "clean up", "simplify", "extract", "rename", "restructure", "move", "split"),
    "understand": ("explain", "what does", "how does", "walk me through", "overview", "describe", "where is"),
    "extend": ("add", "implement", "create", "new feature", "integrate", "build"),
    "review": ("review", "check", "audit", "inspect", "validate"),
}
SPLIT_OVER, PIECE = 200, 100
#: Fixed value: how like a keyword a word has to be; that of Jaro-Winkler from which a common prefix counts.
ALIKE = 0.7


def chunk_markdown(docs: DataFrame) -> DataFrame:
    """docs (file_path, content): chunks that begin at lines starting with ``#``, inside code fences too.

    A section of over 200 lines is cut every 100. Blank chunks go, then chunks are numbered. Lines are the
    document's own, from 1; a text's last line end makes no empty line. Each document is handled on its own key.
    """
    text = F.regexp_replace("content", r"\r?\n\z", "")
    lines = docs.filter(F.length("content") > 0).select("file_path", F.posexplode(F.split(text, r"\r?\n")).alias("line", "text"))
    by_line = Window.partitionBy("file_path").orderBy("line")
    head = C("text").startswith("#")
    lines = lines.withColumn("section", F.sum(head.cast("int")).over(by_line))
    whole = Window.partitionBy("file_path", "section")
    first = F.min("line").over(whole)
    piece = F.when(F.count("*").over(whole) > SPLIT_OVER, F.floor((C("line") - first) / PIECE)).otherwise(F.lit(0))
    title = F.trim(F.regexp_replace(F.first(F.when(head, C("text"))).over(whole.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "^#+", ""))
    parts = lines.withColumns({"piece": piece, "heading": title})
    ordered = F.sort_array(F.collect_list(F.struct("line", "text")))
    content = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    chunks = parts.groupBy("file_path", "section", "piece").agg(F.first("heading").alias("heading"), (F.min("line") + 1).alias("start_line"), (F.max("line") + 1).alias("end_line"), content.alias("content"))
    kept = chunks.filter(F.trim(F.regexp_replace("content", r"(?U)\s+", " ")) != "")
    number = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line")) - 1
    return kept.select("file_path", number.alias("chunk_index"), "heading", "start_line", "end_line", "content", fn.token_estimate(C("content")).alias("token_estimate"), F.substring(F.md5("content"), 1, 8).alias("content_hash"))


#: Documents of a block of postings, about.
BLOCK_DOCS = 512
K1, B = 1.2, 0.75


@dataclass
class TextIndex:
    """A stored inverted index.

    ``table``: a row for each term and block of documents that hold it, sorted by term: n documents, the most times one
    holds it, the least length of one, and docs (id, len, f, at: positions). ``documents`` (id, block, len); a document's
    block follows from its id, so that a changed one is posted anew with its block alone. Documents without terms
    count for the mean length.
    """

    table: DataFrame
    documents: DataFrame
    blocks: int

    def __post_init__(self):
        number, mean = self.documents.agg(F.count("*"), F.avg("len")).first()  # of one short column
        self.number, self.mean = number, mean or 0.0

    def part(self, n: Column, f: Column, length: Column) -> Column:
        """What a term that n documents hold adds to the score of one of this length that holds it f times."""
        idf = F.log((self.number - n + 0.5) / (n + 0.5))
        return F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(self.mean)))

    def renewed(self, docs: DataFrame, gone: DataFrame) -> Renewal:
        """The index with docs (id, text) new or changed and without the ids ``gone`` (id), as what a store has to swap."""
        fresh = cut(_tokens(docs, self.blocks))
        ids = fresh.select("id").unionByName(gone.select("id"))
        touched = cut(ids.select(_block(self.blocks)).distinct())
        own = self.table.join(touched, "block", "left_semi").select("term", "block", F.inline("docs"))
        stay = own.select("term", "block", "id", "len", "at").join(ids, "id", "left_anti")
        rows = cut(_posted(stay.unionByName(_held(fresh).select(*stay.columns))))
        return Renewal(self, touched, rows, ids, fresh.select("id", "block", "len"))


@dataclass
class Renewal:
    """What documents change of an index: touched (block) and the table's new rows of these blocks; ids (id) that go, and the
    rows of documents that come."""

    before: TextIndex
    touched: DataFrame
    rows: DataFrame
    ids: DataFrame
    documents: DataFrame

    def index(self) -> TextIndex:
        """The whole index afterwards."""
        table = self.before.table.join(self.touched, "block", "left_anti").select(*self.rows.columns).unionByName(self.rows)
        return TextIndex(table, cut(self.before.documents.join(self.ids, "id", "left_anti").unionByName(self.documents)), self.before.blocks)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")


def _tokens(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.select("id", _block(blocks), fn.terms(C("text")).alias("ts")).withColumn("len", F.size("ts"))


def _held(tokens: DataFrame) -> DataFrame:
    """tokens (id, block, len, ts): (term, block, id, len, at), a document's terms with their places, found by sorting its own."""
    rows = tokens.select("id", "block", "len", F.array_sort(F.transform("ts", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))).alias("_sorted"))
    begins = F.filter(F.transform("_sorted", lambda x, i: F.when((i == 0) | (F.get("_sorted", i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_begins", begins)
    run = lambda i, k: F.slice("_sorted", i + 1, F.coalesce(F.get("_begins", k + 1), C("len")) - i)
    each = F.transform("_begins", lambda i, k: F.struct(F.get("_sorted", i)["term"].alias("term"), F.transform(run(i, k), lambda x: x["pos"]).alias("at")))
    return rows.select("id", "block", "len", F.inline(each)).select("term", "block", "id", "len", "at")


def _posted(held: DataFrame) -> DataFrame:
    """held (term, block, id, len, at): the table; a group holds a block's documents at most."""
    own = F.struct("id", "len", F.size("at").alias("f"), "at")
    return held.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(F.size("at")).alias("most"), F.min("len").alias("least"), F.sort_array(F.collect_list(own)).alias("docs"))


def text_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, make: cut(make())) -> TextIndex:
    """The index of docs (id, text), stored by ``keep`` (name, how to make it)."""
    found = keep("documents", lambda: _tokens(docs, 1).drop("block"))  # counted when stored, so that texts are made once
    blocks = max(1, -(-found.count() // block_docs))
    found = found.withColumn("block", _block(blocks))
    # dealt once, by range, which brings a group's rows together too
    table = keep("postings", lambda: _posted(_held(found).repartitionByRange("term", "block")).sortWithinPartitions("term", "block"))
    return TextIndex(table, found.select("id", "block", "len"), blocks)


def phrases(queries: DataFrame) -> DataFrame:
    """queries (qid, query): (qid, phrase, off, term, prefix, size, phrases), words with ``_`` being phrases of their parts.

    The query's words are split at spaces; each is cut into terms as documents are; a final ``*`` makes the
    last one a prefix.
    """
    words = queries.select("qid", F.posexplode(F.filter(F.split(F.trim("query"), r"\s+"), lambda x: x != "")).alias("phrase", "word"))
    parts = words.select("qid", "phrase", fn.terms(C("word")).alias("t"), C("word").endswith("*").alias("star")).filter(F.size("t") > 0)
    count = F.count("*").over(Window.partitionBy("qid"))
    parts = parts.withColumn("phrases", count)
    out = parts.select("qid", "phrase", "phrases", F.size("t").alias("size"), "star", F.posexplode("t").alias("off", "term"))
    return out.withColumn("prefix", C("star") & (C("off") == C("size") - 1)).drop("star")


def bm25(docs: DataFrame | TextIndex, queries: DataFrame, mode: str = "and") -> DataFrame:
    """docs (id, text) or their index, queries (qid, query): (qid, id, score), higher being better; every match.

    ``and``: documents with all of a query's phrases; ``or``: with any. Rarity is floored at 1e-6. The table's rows meet
    the queries' terms by equality, a prefix by the beginnings of terms of the lengths that are asked; only rows that
    match are opened.
    """
    index = docs if isinstance(docs, TextIndex) else text_index(docs)
    asked = phrases(queries)
    exact = asked.filter(~C("prefix")).select("qid", "phrase", "phrases", "size", "off", "term")
    starred = asked.filter("prefix").select("qid", "phrase", "phrases", "size", "off", C("term").alias("stem"))
    lengths = starred.agg(F.collect_set(F.length("stem")).alias("lengths"))  # one row of a few numbers
    begun = index.table.select("term", "docs").crossJoin(F.broadcast(lengths)).select("docs", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("term")), lambda n: C("term").substr(F.lit(1), n))).alias("stem"))
    columns = ("qid", "phrase", "phrases", "size", "off", "docs")
    rows = index.table.join(exact, "term").select(*columns).unionByName(begun.join(starred, "stem").select(*columns))
    opened = rows.select("qid", "phrase", "phrases", "size", "off", F.inline("docs"))
    hits = opened.select("qid", "phrase", "phrases", "size", "off", "id", "len", F.explode("at").alias("pos"))
    whole = hits.groupBy("qid", "phrase", "phrases", "size", "id", "len", (C("pos") - C("off")).alias("at")).agg(F.countDistinct("off").alias("have")).filter("have = size")
    freq = cut(whole.groupBy("qid", "phrase", "phrases", "id", "len").agg(F.count("*").alias("f")))
    freq = freq.join(freq.groupBy("qid", "phrase").agg(F.count("*").alias("n")), ["qid", "phrase"])
    return _summed(freq.withColumn("part", index.part(C("n"), C("f"), C("len"))), mode)


def _summed(parts: DataFrame, mode: str) -> DataFrame:
    out = parts.groupBy("qid", "id", "phrases").agg(F.sum("part").alias("score"), F.count("*").alias("have"))
    return out.filter("have = phrases" if mode == "and" else "have > 0").select("qid", "id", "score")


def bm25_top(index: TextIndex, queries: DataFrame, k: int, mode: str = "and", first: int = 4) -> DataFrame:
    """(qid, id, score, rank): the k best of ``bm25``, without opening blocks that cannot hold one of them.

    A block's bound is what a document would score that held every term as often as any of the block does and were as short
    as the shortest. Of each query the ``first`` blocks by bound are opened; then those whose bound reaches the k-th score
    so found. Bounds come from columns beside the postings. Queries with phrases of several words or prefixes, whose
    documents must be counted by opening them, go the way of ``bm25``.
    """
    asked = cut(phrases(queries))
    plain = asked.groupBy("qid").agg(F.max(C("prefix") | (C("size") > 1)).alias("complex"))
    hard = queries.join(plain.filter("complex").select("qid"), "qid", "left_semi")
    easy = asked.join(plain.filter("not complex").select("qid"), "qid", "left_semi").select("qid", "phrase", "phrases", "term")
    heads = cut(index.table.select("term", "block", "n", "most", "least").join(easy, "term"))
    df = heads.groupBy("qid", "phrase").agg(F.sum("n").alias("df"))
    bound = heads.join(df, ["qid", "phrase"]).withColumn("part", index.part(C("df"), C("most"), C("least")))
    bound = bound.groupBy("qid", "phrases", "block").agg((F.sum("part") * (1 + 1e-9)).alias("bound"), F.count("*").alias("have"))
    bound = cut(bound.filter("have = phrases" if mode == "and" else "have > 0").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block"))))

    def opened(which: DataFrame) -> DataFrame:
        own = heads.select("qid", "phrase", "phrases", "term", "block").join(df, ["qid", "phrase"]).join(which.select("qid", "block"), ["qid", "block"])
        rows = index.table.select("term", "block", "docs").join(own, ["term", "block"]).select("qid", "phrase", "phrases", C("df").alias("n"), F.inline("docs"))
        return _summed(rows.withColumn("part", index.part(C("n"), C("f"), C("len"))), mode)

    some = cut(top_hits(opened(bound.filter(C("place") <= first)), k).drop("rank"))
    least = some.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(C("n") == k)
    rest = bound.filter(C("place") > first).join(least, "qid", "left").filter(C("least").isNull() | (C("bound") >= C("least")))
    return top_hits(some.unionByName(opened(rest)).unionByName(bm25(index, hard, mode)), k)


def top_hits(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(C("score").desc(), "id"))
    return scores.withColumn("rank", rank).filter(C("rank") <= k)


def hybrid(scores: DataFrame, centrality: DataFrame, k: int = 50) -> DataFrame:
    """0.6 of the text score and 0.4 of centrality (id, centrality), each over its best among a query's k first hits."""
    hits = top_hits(scores, k).join(centrality, "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    best = lambda c: F.greatest(F.max(c).over(Window.partitionBy("qid")), F.lit(1e-10))
    return hits.withColumn("combined", 0.6 * C("score") / best("score") + 0.4 * C("centrality") / best("centrality"))


def _best_two(queries: DataFrame, scores: dict[str, Column], least: float, name: str) -> DataFrame:
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-s).alias("minus"), F.lit(i).alias("place"), F.lit(k).alias("intent")) for i, (k, s) in enumerate(scores.items())]), lambda x: -x["minus"] > least))
    return queries.withColumn(name, ranked)


def _pick(ranked: Column) -> Column:
    """(primary, secondary, weights) of a ranked list; null if empty."""
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    close = second.isNotNull() & (F.abs(top["minus"] - second["minus"]) < 0.1)
    none = F.lit(None).cast("string")
    fields = F.struct(top["intent"].alias("primary"), F.when(close, second["intent"]).otherwise(none).alias("secondary"), F.when(close, 0.6).otherwise(1.0).alias("primary_weight"), F.when(close, 0.4).otherwise(0.0).alias("secondary_weight"))
    return F.when(F.size(ranked) > 0, fields)


def keyword_scores(query: Column) -> dict[str, Column]:
    one = lambda k: F.when(query.contains(k), F.when(query.startswith(k), 1.5).otherwise(1.0)).otherwise(0.0)
    return {intent: sum((one(k) for k in words), F.lit(0.0)) for intent, words in KEYWORDS.items()}


def _letters(texts: list[str], known: list[str]) -> np.ndarray:
    """How often each text holds each of the known letters, a row a text."""
    code = np.full(128, len(known), np.int64)
    code[[ord(c) for c in known]] = np.arange(len(known))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    at = np.where(flat < 128, code[np.minimum(flat, 127)], len(known))
    return np.bincount(own * (len(known) + 1) + at, minlength=len(texts) * (len(known) + 1)).reshape(len(texts), -1)[:, : len(known)]


def _likeness(texts: list[str]) -> np.ndarray:
    """Of each text its best similarity with a keyword of each intent, 0 where none is over ``ALIKE``.

    Characters that match are equal ones, so what letters text and keyword have in common bounds their Jaro similarity; the
    prefix counts only over 0.7. Pairs that the bound leaves are compared, hardly any of long texts.
    """
    out = np.zeros((len(texts), len(KEYWORDS)))
    known = sorted({c for words in KEYWORDS.values() for k in words for c in k})
    held, length = _letters(texts, known), np.array([len(x) for x in texts], np.int64)
    for i, words in enumerate(KEYWORDS.values()):
        for k, own in zip(words, _letters(list(words), known), strict=True):
            common = np.minimum(held[:, own > 0], own[own > 0]).sum(axis=1)
            near = np.flatnonzero((common / np.maximum(length, 1) + common / len(k) + 1) / 3 > ALIKE - 1e-9)
            if len(near):
                out[near, i] = np.maximum(out[near, i], fn.jaro_winkler_pairs([texts[j] for j in near], [k] * len(near)))
    return np.where(out > ALIKE, out, 0.0)


@F.arrow_udf(ArrayType(DoubleType()))
def _keyword_likeness(texts: pa.Array) -> pa.Array:
    """Of each list of texts the best of ``_likeness``; a text is compared once a batch, however often it is said."""
    flat = texts.flatten().dictionary_encode()
    own = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
    said, best = flat.dictionary.to_pylist(), np.zeros((len(texts), len(KEYWORDS)))
    alike = np.concatenate([np.zeros((0, len(KEYWORDS))), *(_likeness(said[i : i + fn.PAIRS]) for i in range(0, len(said), fn.PAIRS))])
    np.maximum.at(best, own, alike[flat.indices.to_numpy(zero_copy_only=False)])
    return pa.FixedSizeListArray.from_arrays(pa.array(best.ravel()), len(KEYWORDS)).cast(pa.list_(pa.float64()))


def intents(queries: DataFrame) -> DataFrame:
    """queries (qid, query): primary and secondary intent with weights.

    Keywords found as substrings count 1, or 1.5 at the start; the best two are mixed 60/40 when closer than 0.1.
    Without any, the best Jaro-Winkler similarity of a word or the whole text with a keyword, if over 0.7;
    else ``understand``. Equal scores go by the order of intents.
    """
    rows = _best_two(queries.withColumn("_q", F.lower("query")), keyword_scores(C("_q")), 0.0, "_hits")
    texts = F.when((F.size("_hits") == 0) & (C("_q") != ""), F.array_distinct(F.concat(F.array("_q"), F.split(F.trim("_q"), r"\s+"))))
    rows = _best_two(rows.withColumn("_like", _keyword_likeness(texts)), {k: F.get("_like", F.lit(i)) for i, k in enumerate(KEYWORDS)}, ALIKE, "_near")
    found = rows.select("qid", "query", F.when(F.size("_hits") > 0, _pick(C("_hits"))).otherwise(_pick(C("_near"))).alias("r"))
    r = lambda f, other: F.coalesce(C(f"r.{f}"), F.lit(other)).alias(f)
    return found.select("qid", "query", r("primary", "understand"), C("r.secondary").alias("secondary"), r("primary_weight", 1.0), r("secondary_weight", 0.0))


#: How much a note's kind counts.
KIND_WEIGHT = {"pitfall": 1.2, "strategy": 1.1, "context": 0.8}


def note_score(bm25: Column, proximity: Column, recency: Column, quality: Column, stale: Column, kind: Column) -> Column:
    """Missing text, time and quality inputs count 0.5."""
    half = F.lit(0.5)
    base = 0.4 * F.coalesce(bm25, half) + 0.25 * proximity + 0.15 * F.coalesce(recency, half) + 0.2 * F.coalesce(quality, half)
    weight = reduce(lambda w, k: w.when(kind == k, KIND_WEIGHT[k]), list(KIND_WEIGHT)[1:], F.when(kind == "pitfall", KIND_WEIGHT["pitfall"])).otherwise(1.0)
    return fn.clamp(base * F.when(stale, 0.6).otherwise(1.0) * weight)


def proximity(anchor_type: Column, is_target: Column, is_near: Column) -> Column:
    """How close an anchor is to the target: by node, by file, by scope, else project-wide."""
    return (
        F.when(anchor_type == "node", F.when(is_target, 1.0).when(is_near, 0.7).otherwise(0.5))
        .when(anchor_type == "file", F.when(is_target, 0.8).when(is_near, 0.5).otherwise(0.4))
        .when(anchor_type == "scope", 0.6)
        .otherwise(0.3)
    )


def doc_score(bm25: Column, priority: Column) -> Column:
    return fn.clamp(0.7 * F.coalesce(bm25, F.lit(0.5)) + 0.3 * F.when(priority, 1.0).otherwise(0.0))


def graph_score(centrality: Column, best: Column, bm25: Column) -> Column:
    return 0.4 * centrality / F.greatest(best, F.lit(1e-10)) + 0.6 * F.coalesce(bm25, F.lit(0.0))


def session_score(recency: Column) -> Column:
    return 0.5 * recency + 0.15
