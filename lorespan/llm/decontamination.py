"""Benchmark passages in documents, found through an FM-index of each training shard.

A task turns its documents into shards of bounded length and indexes all words of each, once, for phrases of any
length; the indexes are kept as a table in the shared folder. The test items are a stated query set in blocks of
bounded size, searched one after another: a block alone is broadcast, its windows are searched backwards through
wavelet-tree ranks in every shard, occurrences are located by sampled suffix positions and merged to removal
spans. Memory follows a shard and a block, not the benchmark. Only documents that have hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm import text as T
from lorespan.llm.fm_index import FMIndex
from lorespan.llm.store import settle, split_by_ids
from lorespan.llm.substrings import cut_text

SHARD_WORDS = 1 << 20
SHARD_DOCS = 1 << 16
#: Words of test items in one broadcast block, about.
BLOCK_WORDS = 2 << 20
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans")
_FOUND = "row long, item_ids array<string>, spans array<struct<first:long,last:long>>"


def _lowered(texts: list[str | None]) -> T.Words:
    raw, offsets = T.buffers(pa.array(texts, pa.string()))
    return T.Words(raw, offsets, T.ALNUM_LOWERED, lower=True)


def shard_index(hashes: np.ndarray, counts: np.ndarray, base: int) -> bytes:
    """The index of documents whose word hashes come one after another, numbered from ``base`` on."""
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    places = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
    text = np.zeros(len(hashes) + len(counts), np.int32)
    text[places] = symbols + 1
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    return FMIndex(text, len(vocabulary) + 1).to_bytes(vocabulary=vocabulary, first=first.astype(np.int32), base=np.array([base]))


def _index(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33

        def flush(parts, hashes, counts):
            counts = np.concatenate(counts)
            index = pa.array([None] * (len(counts) - 1) + [shard_index(np.concatenate(hashes), counts, row)], pa.binary())
            kept = pa.Table.from_batches(parts).select(names).combine_chunks()
            own = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in kept.columns]
            return pa.RecordBatch.from_arrays([*own, pa.array(np.arange(row, row + len(counts))), pa.array(counts, pa.int64()), index], names=[*names, "row", "n_words", "index"])

        parts, hashes, counts, n, docs = [], [], [], 0, 0
        for part, raw, offsets in T.slices(batches, "t"):
            words = T.Words(raw, offsets, T.ALNUM_LOWERED, lower=True)
            parts.append(part)
            hashes.append(words.hashes())
            counts.append(words.counts)
            n, docs = n + len(words), docs + part.num_rows
            if n >= SHARD_WORDS or docs >= SHARD_DOCS:
                yield flush(parts, hashes, counts)
                row += docs
                parts, hashes, counts, n, docs = [], [], [], 0, 0
        if parts:
            yield flush(parts, hashes, counts)

    return run


def index_shards(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A settled table of the columns ``keep`` (as k0, k1, ..., the text's as t) of every row, its ``row`` number and
    ``n_words``; the last row of each shard carries the shard's ``index``. It serves any benchmark and any window."""
    inner = inner_names(keep, text_col)
    source = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items() if i != "t"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kinds = ", ".join(f"{i} {source.schema[i].dataType.simpleString()}" for i in inner.values())
    return settle(T.mapped(source, _index([*inner.values()]), f"{kinds}, row long, n_words long, index binary"))


def inner_names(keep: list[str], text_col: str) -> dict[str, str]:
    return {c: "t" if c == text_col else f"k{i}" for i, c in enumerate(keep)}


@dataclass
class Phrases:
    """Windows of a block of items, as places in the block's vocabulary."""

    vocabulary: np.ndarray
    names: list[str]
    #: by length: windows (one a row), and the items that hold each (in rows of the third from its offset on)
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def phrases(names: list[str], texts: list[str | None], window: int) -> Phrases:
    """All windows of ``window`` words of the items, of shorter items the whole."""
    words = _lowered(texts)
    vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
    found: dict[int, tuple[list, list]] = {}
    for d, n in enumerate(words.counts.tolist()):
        if not n:
            continue
        size = min(window, n)
        own = symbols[words.first[d] : words.first[d] + n]
        rows, items = found.setdefault(size, ([], []))
        rows.append(np.lib.stride_tricks.sliding_window_view(own, size))
        items.append(np.full(n - size + 1, d))
    windows = {}
    for size, (rows, items) in found.items():
        distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(items)], axis=1), axis=0)
        windows[size] = distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]
    return Phrases(vocabulary, names, windows)


def occurrences(index: FMIndex, vocabulary: np.ndarray, block: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the shard's text, which window) of the block's windows."""
    if not len(vocabulary) or not len(block.vocabulary):
        return
    at = np.minimum(np.searchsorted(vocabulary, block.vocabulary), len(vocabulary) - 1)
    symbols = np.where(vocabulary[at] == block.vocabulary, at + 1, 0)
    for size, (patterns, _, _) in block.windows.items():
        translated = symbols[patterns]
        known = np.flatnonzero((translated > 0).all(axis=1))
        if len(known):
            lo, hi = index.search(translated[known])
            yield size, index.locate(T.ranges(lo, hi - lo)), np.repeat(known, hi - lo)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Phrases = shared.value
        for batch in batches:
            for data in batch.column(0):
                index, more = FMIndex.from_bytes(data.as_py())
                first, pairs, edges = more["first"], [np.zeros((0, 2), np.int64)], np.zeros(more["first"][-1] + 1, np.int32)
                for size, where, which in occurrences(index, more["vocabulary"], block):
                    np.add.at(edges, where, 1)
                    np.add.at(edges, where + size, -1)
                    doc = np.searchsorted(first, where, "right") - 1
                    doc, which = np.unique(np.stack([doc, which], axis=1), axis=0).T
                    _, offsets, items = block.windows[size]
                    each = offsets[which + 1] - offsets[which]
                    pairs.append(np.stack([np.repeat(doc, each), items[T.ranges(offsets[which], each)]], axis=1))
                found = np.unique(np.concatenate(pairs), axis=0)
                hit = np.cumsum(edges) > 0  # never at a separator
                cuts = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8))).reshape(-1, 2)
                owner = np.searchsorted(first, cuts[:, 0], "right") - 1
                docs = np.unique(found[:, 0])
                ids, spans = [], []
                for a, b, c, d in zip(*(np.searchsorted(x, docs, side) for x in (found[:, 0], owner) for side in ("left", "right")), strict=True):
                    ids.append(sorted({block.names[i] for i in found[a:b, 1].tolist()}))
                    spans.append([{"first": x, "last": y - 1} for x, y in (cuts[c:d] - first[owner[c]]).tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(docs + more["base"][0], pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], names=["row", "item_ids", "spans"])

    return run


def found_passages(shards: DataFrame, benchmark: DataFrame, window: int = 13, item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``row``, ``item_ids`` (sorted) and ``spans`` (merged) of the documents of ``index_shards`` that hold a window of an item.

    The driver holds one block of items at a time.
    """
    spark = shards.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).dropna().distinct()
    many, size = items.agg(F.count("*"), F.sum(F.expr("length(t) div 2 + 1"))).first()  # at least the words
    blocks = min(many, -(-(size or 0) // block_words))
    numbered = settle(items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, blocks)))))
    indexes, parts = shards.filter("index is not null").select("index"), [spark.createDataFrame([], _FOUND)]
    for b in range(blocks):
        own = numbered.filter(F.col("block") == b).orderBy("i", "t").collect()
        if not own:
            continue
        shared = spark.sparkContext.broadcast(phrases([r["i"] for r in own], [r["t"] for r in own], window))
        parts.append(settle(T.mapped(indexes, _search(shared), _FOUND)))
        shared.destroy()
    found = reduce(DataFrame.unionByName, parts)
    names = found.select("row", F.explode("item_ids").alias("i")).groupBy("row").agg(F.sort_array(F.collect_set("i")).alias("item_ids"))
    # spans of several blocks may overlap: islands of overlapping or touching ones become one
    order = Window.partitionBy("row").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("row", F.inline("spans")).withColumn("opens", F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int"))
    islands = spans.withColumn("island", F.sum("opens").over(order)).groupBy("row", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return names.join(islands.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), "row")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns ``keep`` (default doc_id; the text's may be among them) of each row, and what it holds of the benchmark.

    n_words; n_hit, words inside an occurrence of a window of some item; n_items and item_ids (as sorted
    text), items with such a window; spans, the merged hit words as first and last word number; contaminated,
    n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words. Items without id or words are
    ignored; items may share windows, and rows with one item id count as one item. An empty benchmark hits
    nothing; an empty table gives no rows; repeated rows stay. The result's names must not be in ``keep``.
    """
    inner = inner_names(keep or ["doc_id"], text_col)
    rows = index_shards(docs, [*inner], text_col)
    found = settle(found_passages(rows, benchmark, window, item_col, item_text_col, block_words))
    listed, others = split_by_ids(rows.drop("index"), "row", found)
    none = {"item_ids": F.array().cast("array<string>"), "spans": F.array().cast(found.schema["spans"].dataType)}
    out = listed.join(found, "row", "left").unionByName(others.withColumns(none)).withColumns({c: F.coalesce(c, x) for c, x in none.items()})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    out = out.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "item_ids"), 256)})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select(*(F.col(i).alias(c) for c, i in inner.items()), *RESULTS)


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in T.slices(batches, "t"):
            words, data, out = T.Words(raw, offsets, T.ALNUM_LOWERED), raw.tobytes(), []
            for d, spans in enumerate(part.column(part.schema.get_field_index("spans")).to_pylist()):
                gone = np.zeros(words.counts[d], bool)
                for s in spans:
                    gone[s["first"] : s["last"] + 1] = True
                own = slice(words.first[d], words.first[d + 1])
                out.append(cut_text(data[offsets[d] : offsets[d + 1]], words.starts[own] - offsets[d], gone))
            own = [pa.array(out, pa.binary()).cast(pa.string()) if n == "t" else part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(own, names=names)

    return run


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, all columns, their texts without the removal spans.

    A removed word goes with what follows it up to the next word. Texts without a span stay as they are; cases as in
    ``contaminated_documents``.
    """
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in names.items()))
    rows = contaminated_documents(own, benchmark, window, [*names.values()], names[text_col], item_col, item_text_col, block_words).filter("not contaminated")
    kept = [i if i != names[text_col] else "t" for i in names.values()]
    hit = rows.filter("n_hit > 0").withColumnRenamed(names[text_col], "t")
    cut = T.mapped(hit.select(*kept, "spans"), _cut(kept), ", ".join(f"{c} {hit.schema[c].dataType.simpleString()}" for c in kept))
    whole = rows.filter("n_hit = 0").withColumnRenamed(names[text_col], "t").select(*kept)
    return whole.unionByName(cut).toDF(*docs.columns)
