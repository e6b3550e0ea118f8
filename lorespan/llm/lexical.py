"""Ranked lexical search over a two-level quantised index.

A task turns its documents into shards of bounded length and inverts each: terms, the documents that hold them, and
of every posting two levels. The first is one byte, the posting's impact in units rounded up, so that sums over a
query's terms bound a score from above and, less one unit a posting, from below. The second is the exact frequency.

A search takes the queries in blocks of bounded size and scans the index for each. Document frequencies come first;
then bytes alone give each query's k-th best lower bound over the whole corpus; then every document whose upper bound
reaches that is scored from the second level in 64-bit integers. Nothing that could rank is left out: a document of
the first k scores at least the k-th lower bound. Only k lower bounds and at most k scored documents of a shard leave
a task, so no shuffle follows the number of postings, and copies of one text cost no more than others.

Terms are compared by 64-bit hashes of their bytes: of a corpus of 10**10 different terms one would be taken for a
given query's term with a chance of 5e-10.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorespan.llm import text as T
from lorespan.llm.store import discard, settle

SHARD_BYTES = 4 << 20
SHARD_DOCS = 1 << 16
#: Words of queries in one broadcast block, about.
BLOCK_WORDS = 1 << 18
#: The impact that a byte counts: 255 of them reach every impact, which is below a million.
UNIT = 3922
_SHARD = "n array<bigint>, terms binary, starts binary, places binary, impacts binary, tfs binary"


@dataclass(frozen=True)
class Index:
    """``shards``: a settled table, one row a shard; of the corpus, documents with a term and all terms."""

    shards: DataFrame
    documents: int
    terms: int


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one occurrence in a query adds per unit of the term's weight, exactly."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // max(terms, 1)))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for _, raw, offsets in T.slices(batches, "t"):
        counts = T.Words(raw, offsets, T.ALNUM_LOWERED).counts
        documents, terms = documents + int((counts > 0).sum()), terms + int(counts.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])


def _inverted(documents: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCS):
                for part, raw, offsets in T.slices(iter([batch.slice(at, SHARD_DOCS)]), "t", SHARD_BYTES):
                    words = T.Words(raw, offsets, T.ALNUM_LOWERED, lower=True)
                    ids = part.column(part.schema.get_field_index("k"))
                    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()  # places follow ids
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(len(order))
                    vocabulary, symbol = np.unique(words.hashes(), return_inverse=True)
                    keys, tf = np.unique(symbol * len(order) + place[words.text_of()], return_counts=True)
                    n = words.counts[order]
                    own = keys % max(1, len(order))
                    level = -(-impacts(tf, n[own], documents, terms) // UNIT)
                    starts = np.searchsorted(keys, np.arange(len(vocabulary) + 1) * len(order))
                    blobs = [vocabulary, starts.astype(np.int64), own.astype(np.uint16), level.astype(np.uint8), tf.astype(np.uint32)]
                    columns = [pa.array([x], pa.list_(x.type)) for x in (ids.take(pa.array(order)), pa.array(n, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["ids", "n", "terms", "starts", "places", "impacts", "tfs"])

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes the whole text of every row: one pass for the corpus' size, one for the shards.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lowered. Null and empty texts have none and
    never rank. Rows that share an id are documents of their own, as are rows without one. Columns but these two are
    not read; an empty table gives an index that finds nothing.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    size = T.mapped(rows.select("t"), _lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = (x or 0 for x in size)
    kind = rows.schema["k"].dataType.simpleString()
    return Index(settle(T.mapped(rows, _inverted(documents, terms), f"ids array<{kind}>, {_SHARD}")), documents, terms)


@dataclass
class Queries:
    """A block of queries: its different terms in order, and of each query the places of its terms and their repeats."""

    vocabulary: np.ndarray
    numbers: list[int]
    own: list[tuple[np.ndarray, np.ndarray]]
    k: int
    weights: np.ndarray | None = None
    least: np.ndarray | None = None


def _queries(numbers: list[int], texts: list[str | None], k: int) -> Queries:
    raw, offsets = T.buffers(pa.array(texts, pa.string()))
    words = T.Words(raw, offsets, T.ALNUM_LOWERED, lower=True)
    vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
    own = [np.unique(symbols[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return Queries(vocabulary, numbers, own, k)


class _Shard:
    """Postings of the block's terms in a shard."""

    def __init__(self, batch: pa.RecordBatch, i: int, queries: Queries):
        self.batch, self.i = batch, i
        terms = self.blob("terms", np.uint64)
        at = np.searchsorted(terms, queries.vocabulary)
        at[at == len(terms)] = 0
        known = terms[at] == queries.vocabulary if len(terms) else np.zeros(len(at), bool)
        starts = self.blob("starts", np.int64)
        self.lo = np.where(known, starts[at], 0)
        self.hi = np.where(known, starts[np.minimum(at + 1, len(starts) - 1)], 0)

    def blob(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(self.batch.column(self.batch.schema.get_field_index(name))[self.i].as_buffer(), kind)

    def list(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))[self.i].values

    def bounds(self, queries: Queries, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(query, bound of every document's score) of the queries that have a term here."""
        places, level = self.blob("places", np.uint16), self.blob("impacts", np.uint8).astype(np.int64)
        each = np.maximum((level - 1) * UNIT + 1, 0) if lower else level * UNIT
        each[level == 0] = 0
        documents = int(places.max()) + 1 if len(places) else 0
        for q, (terms, times) in enumerate(queries.own):
            found = self.lo[terms] < self.hi[terms]
            if found.any():
                sums = np.zeros(documents, np.int64)
                for t, n in zip(terms[found].tolist(), times[found].tolist(), strict=True):
                    a, b = self.lo[t], self.hi[t]
                    sums[places[a:b]] += each[a:b] * (int(queries.weights[t]) * n)
                yield q, sums

    def scores(self, queries: Queries, q: int, documents: np.ndarray, size: tuple[int, int]) -> np.ndarray:
        """Exact scores of the documents at ascending places."""
        places, tfs, n = self.blob("places", np.uint16), self.blob("tfs", np.uint32), self.list("n").to_numpy()
        out = np.zeros(len(documents), np.int64)
        for t, times in zip(*(x.tolist() for x in queries.own[q]), strict=True):
            own, tf = places[self.lo[t] : self.hi[t]], tfs[self.lo[t] : self.hi[t]]
            if len(own):
                at = np.minimum(np.searchsorted(own, documents), len(own) - 1)
                here = own[at] == documents
                out[here] += impacts(tf[at[here]].astype(np.int64), n[documents[here]], *size) * (int(queries.weights[t]) * times)
        return out


def _shards(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[_Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Shard(batch, i, queries)


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        total = np.zeros(len(queries.vocabulary), np.int64)
        for shard in _shards(batches, queries):
            total += shard.hi - shard.lo
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    return run


def _best_bounds(shared):
    """The k best lower bounds of each query over a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best: dict[int, np.ndarray] = {}
        for shard in _shards(batches, queries):
            for q, sums in shard.bounds(queries, lower=True):
                had = best.get(q, np.zeros(0, np.int64))
                more = np.concatenate([had, sums[sums > (had[0] if len(had) == queries.k else 0)]])
                best[q] = np.sort(np.partition(more, len(more) - queries.k)[-queries.k :] if len(more) > queries.k else more)
        n = [len(x) for x in best.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(best), n).astype(np.int64)), pa.array(np.concatenate([*best.values(), np.zeros(0, np.int64)]))], names=["q", "bound"])

    return run


def _rescored(shared, size: tuple[int, int], kind: pa.DataType):
    """Of each shard, the k first by exact score among the documents that reach the query's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        for shard in _shards(batches, queries):
            numbers, ids, scores = [], [], []
            for q, sums in shard.bounds(queries, lower=False):
                reached = np.flatnonzero(sums >= max(1, int(queries.least[q])))
                if len(reached):
                    exact = shard.scores(queries, q, reached, size)
                    first = np.argsort(-exact, kind="stable")[: queries.k]  # places follow ids
                    first = first[exact[first] > 0]
                    numbers.append(np.full(len(first), queries.numbers[q]))
                    ids.append(shard.list("ids").take(pa.array(reached[first])))
                    scores.append(exact[first])
            if numbers:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.concat_arrays(ids).cast(kind), pa.array(np.concatenate(scores))], names=["i", "k", "score"])

    return run


def _ranked_block(index: Index, queries: Queries) -> DataFrame:
    """(i, k, score): at most k rows a query and shard, all of the first k among them; settled."""
    spark, shards, size = index.shards.sparkSession, index.shards, (index.documents, index.terms)
    spread = lambda: spark.sparkContext.broadcast(queries)  # noqa: E731  as it is by now
    shared = spread()
    counted = T.mapped(shards.select("terms", "starts"), _frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # of one block's terms
    shared.destroy()
    queries.weights = np.array([weight(index.documents, df.get(t, 0)) for t in range(len(queries.vocabulary))], np.int64)

    shared = spread()
    bounds = T.mapped(shards.select("terms", "starts", "places", "impacts"), _best_bounds(shared), "q long, bound long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound")))
    least = bounds.withColumn("place", place).filter(F.col("place") <= queries.k).filter(F.col("place") == queries.k)
    queries.least = np.zeros(len(queries.own), np.int64)
    for r in least.collect():  # one row a query of the block
        queries.least[r["q"]] = r["bound"]
    shared.destroy()

    shared = spread()
    kind = shards.schema["ids"].dataType.elementType
    out = settle(T.mapped(shards, _rescored(shared, size, to_arrow_type(kind)), f"i long, k {kind.simpleString()}, score long"))
    shared.destroy()
    return out


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the k best documents of each row of items, or all with a score above 0.

    Equal scores go by ascending id, nulls last. Rows that share an item id are searched each for itself; null and
    empty query texts find nothing. The driver holds one block of queries at a time.
    """
    spark = items.sparkSession
    rows = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("length(t) > 0")
    numbered = settle(rows.withColumn("i", F.monotonically_increasing_id()))
    many, words = numbered.agg(F.count("*"), F.sum(F.expr("length(t) div 2 + 1"))).first()  # at least the words
    blocks = min(many, -(-(words or 0) // block_words))
    found = []
    for b in range(blocks):
        own = numbered.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).select("i", "t").collect()
        if own:
            found.append(_ranked_block(index, _queries([r["i"] for r in own], [r["t"] for r in own], k)))
    if not found:
        kind = index.shards.schema["ids"].dataType.elementType.simpleString()
        return spark.createDataFrame([], f"item_id {rows.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kind}, score long")
    order = Window.partitionBy("i").orderBy(F.desc("score"), F.asc_nulls_last("k"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = settle(best.join(numbered.drop("t"), "i").select("item_id", F.col("rank").cast("int"), F.col("k").alias("doc_id"), "score"))
    discard(numbered, *found)
    return out


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``search`` of all items over an index of docs that is made for it; cases as in both."""
    index = build_index(docs, id_col, text_col)
    out = search(index, items, k)
    discard(index.shards)
    return out
