"""Removal of word sequences that an earlier document already has, by difference-cover anchors.

Two copies of the same passage rarely start at the same offset of their documents. A difference cover is a
set of residues modulo a period such that every shift between two offsets is a difference of two of its
members; so if both texts hash short anchor windows only at cover positions, any common run of
``window`` words has an anchor that both hashed. Steps:

1. exact copies of a text are set aside (the whole text is covered by the smallest id);
2. anchors of all other texts meet by hash; those in one document only end here;
3. around anchors that were shared, texts are extended to full windows, whose hashes decide: a window is
   removed where it also starts in a document with a smaller id;
4. covered words are cut.

Anchors and windows are reduced to smallest and largest id in every map task, never gathered, and no pairs
of documents are made, so a passage that a third of all documents share costs as much a row as any other.
Texts are shuffled only where a bitmap of ids says that they may have a copy or a shared window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm import text as T
from lorespan.llm.store import discard, settle, split_by_ids

#: A perfect difference set modulo 31, each shift being one difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SALTS = 16


def check_cover(period: int, cover: tuple[int, ...]) -> None:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")


class _Plan:
    """Window, anchor length and cover as numpy, for one slice of texts."""

    def __init__(self, window: int, period: int, cover: tuple[int, ...]):
        check_cover(period, cover)
        if window <= period:
            raise ValueError("the window must be longer than the period")
        self.window, self.period, self.anchor = window, period, window - period + 1
        self.cover = np.zeros(period, bool)
        self.cover[list(cover)] = True

    def words(self, raw, offsets):
        words = T.Words(raw, offsets, T.BLANK_SEPARATED)
        place = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)
        return words, words.hashes(), place


def _anchors(plan: _Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in T.slices(batches, "t"):
            words, hashes, place = plan.words(raw, offsets)
            n = max(0, len(words) - plan.anchor + 1)
            of = words.text_of()
            ok = T.whole_window(words, plan.anchor) & plan.cover[place[:n] % plan.period] & (words.counts >= plan.window)[of[:n]]
            at, keys = _once_a_text(np.flatnonzero(ok), of, T.windows(hashes, plan.anchor))
            yield pa.RecordBatch.from_arrays([T.signed(keys), part.column(0).take(pa.array(of[at]))], names=["h", "k"])

    return run


def _once_a_text(at: np.ndarray, of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) without those whose hash comes earlier in the same text."""
    keys = hashes[at]
    _, first = np.unique(T.mix(keys + of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    return at[first], keys[first]


def _in_list(part: pa.RecordBatch, column: str, of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which positions have a hash that is in their text's list."""
    lists = part.column(part.schema.get_field_index(column))
    counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    out = np.zeros(len(hashes), bool)
    if counts.any():
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        salt = np.uint64(0xD6E8FEB86659FD93)
        listed = T.mix(values + np.repeat(np.arange(len(counts)), counts).astype(np.uint64) * salt)
        some = np.flatnonzero((counts > 0)[of[: len(hashes)]])
        out[some] = np.isin(T.mix(hashes[some] + of[some].astype(np.uint64) * salt), listed)
    return out


def _windows(plan: _Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in T.slices(batches, "t"):
            words, hashes, place = plan.words(raw, offsets)
            whole = T.whole_window(words, plan.window)
            if not len(whole):
                continue
            # a shared window holds an anchor that both its texts hashed
            of, met = words.text_of(), np.zeros(len(words), bool)
            anchors = T.windows(hashes, plan.anchor)
            met[: len(anchors)] = _in_list(part, "met", of, anchors) & plan.cover[place[: len(anchors)] % plan.period]
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum(met, out=sums[1:])
            n = len(whole)
            at = np.flatnonzero(whole & (sums[plan.period : plan.period + n] > sums[:n]))
            at, first = _once_a_text(at, of, T.windows(hashes, plan.window))
            second = T.windows(words.hashes(seed=2), plan.window, seed=9)[at] >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([T.signed(first), pa.array(second.astype(np.int64)), part.column(0).take(pa.array(of[at]))], names=["h", "h2", "k"])

    return run


def removed_words(words: T.Words, starts: np.ndarray, window: int, wholly: np.ndarray) -> np.ndarray:
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return (np.cumsum(edges[:-1]) > 0) | np.repeat(wholly, words.counts)


def _cut(plan: _Plan, carried: list[str], digest: bool):
    names = [*carried, "words_", "removed_", "kept_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in T.slices(batches, "t"):
            words, hashes, _ = plan.words(raw, offsets)
            own = T.windows(hashes, plan.window)
            at = np.flatnonzero(T.whole_window(words, plan.window) & _in_list(part, "gone", words.text_of(), own))
            copy = part.column(part.schema.get_field_index("copy")).to_numpy(zero_copy_only=False).astype(bool)
            gone = removed_words(words, at, plan.window, copy & (words.counts >= plan.window))
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum(gone, out=sums[1:])
            removed = np.diff(sums[words.first])
            out = []
            data = raw.tobytes()
            for d in range(part.num_rows):
                a, b = words.first[d], words.first[d + 1]
                text = data[offsets[d] : offsets[d + 1]]
                if digest:
                    tokens = text.split()  # at the same bytes as the word pattern
                    left = compress(tokens, ~gone[a:b]) if removed[d] else tokens
                    out.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    out.append(cut_text(text, words.starts[a:b] - offsets[d], gone[a:b]) if removed[d] else text)
            own = [part.column(part.schema.get_field_index(c)) for c in carried]
            kept = pa.array(out, pa.string() if digest else pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), kept], names=names)

    return run


def cut_text(text: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the removed words and the space after each; the rest as it was."""
    ends = np.append(starts[1:], len(text))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~gone, [False]]).astype(np.int8)))
    head = text[: starts[0]] if len(starts) and not gone[0] else b""
    return head + b"".join(text[starts[a] : ends[b - 1]] for a, b in edges.reshape(-1, 2).tolist())


def exact_copies(docs: DataFrame) -> DataFrame:
    """Of docs (k, t): each k with a text that a smaller k also has, that text's MD5 and its smallest k.

    The copies of one text meet their smallest id in ``SALTS`` tasks.
    """
    keyed = docs.filter(F.col("k").isNotNull() & F.col("t").isNotNull()).select("k", F.md5("t").alias("m"))
    first = keyed.groupBy("m").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last").drop("last")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return settle(keyed.withColumn("salt", F.pmod(F.hash("k"), F.lit(SALTS))).join(salted, ["m", "salt"]).filter("k > first").select("m", "k", "first").distinct())


def copied_texts(copies: DataFrame) -> DataFrame:
    return copies.groupBy("k").agg(F.collect_set("m").alias("copied"))


def is_copy() -> Column:
    return F.coalesce(F.array_contains("copied", F.md5("t")), F.lit(False))


def without_copies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """docs less the rows that exact_copies lists; only rows whose k is listed are shuffled."""
    listed, others = split_by_ids(docs, "k", copies)
    return others.unionByName(listed.join(copied_texts(copies), "k", "left").filter(~is_copy()).select(*docs.columns))


def _cut_rows(docs: DataFrame, plan: _Plan, carried: list[str], digest: bool) -> DataFrame:
    """docs (k, t, ...): the carried columns, numbers of words and removed words, and what is kept.

    Aggregates come before the joins with the rows they stand for, both sides dealt as AQE sees fit: a hash
    that very many documents share is aggregated in every map task and its rows are split in the join.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    copies = exact_copies(docs.select("k", "t"))
    live = without_copies(docs.select("k", "t").filter(F.col("k").isNotNull()), copies)

    anchors = T.mapped(live, _anchors(plan), f"h long, k {kinds['k']}")
    shared = anchors.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("h")
    met = settle(anchors.join(shared, "h").select("k", "h"))

    near = split_by_ids(live, "k", met)[0].join(met.groupBy("k").agg(F.collect_list("h").alias("met")), "k")
    found = T.mapped(near, _windows(plan), f"h long, h2 long, k {kinds['k']}")
    least = found.groupBy("h", "h2").agg(F.min("k").alias("lo"))
    gone = settle(found.join(least, ["h", "h2"]).filter("k > lo").select("k", "h"))
    discard(met)

    touched, others = split_by_ids(docs, "k", gone.select("k").unionByName(copies.select("k")))
    lists = gone.groupBy("k").agg(F.collect_list("h").alias("gone"))
    changed = touched.join(copied_texts(copies), "k", "left").join(lists, "k", "left").withColumn("copy", is_copy()).drop("copied")
    whole = others.withColumns({"copy": F.lit(False), "gone": F.lit(None).cast("array<bigint>")})
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carried), "words_ long", "removed_ long", "kept_ string"])
    first, second = (T.mapped(x, _cut(plan, carried, digest), schema) for x in (changed, whole))
    return first.unionByName(second)


def remove_repeats(docs: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text without repeated passages, and ``n_words_before``, ``n_words_removed``.

    A word goes if a window of ``window`` words that covers it also starts in a document of smaller id;
    windows are those of the input. Null text stays null and has no words; an empty or short text stays.
    A null id is neither compared nor cut. Rows that share an id are cut each by its own windows and
    never by each other's. Equal rows of one id therefore all stay. An empty table gives no rows.
    The two new names replace columns of docs that have them.
    """
    names = [c for c in docs.columns if c not in ("n_words_before", "n_words_removed")]
    out = _cut_columns(docs.select(*(F.col(f"`{c}`") for c in names)), _Plan(window, period, cover), id_col, text_col)
    return out.select(*(F.col(f"c{i}_").alias(c) for i, c in enumerate(names)), F.col("words_").alias("n_words_before"), F.col("removed_").alias("n_words_removed"))


def without_repeats(docs: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without repeated passages, all columns; rows of which nothing is left go. Cases as in remove_repeats."""
    out = _cut_columns(docs, _Plan(window, period, cover), id_col, text_col).filter("removed_ = 0 or removed_ < words_")
    return out.select(*(F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)))


def _cut_columns(docs: DataFrame, plan: _Plan, id_col: str, text_col: str) -> DataFrame:
    """The columns of docs as c0_, c1_, ..., the text cut, with ``words_`` and ``removed_``."""
    inner = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"), *(F.col(f"`{c}`").alias(i) for c, i in inner.items() if c != text_col))
    out = _cut_rows(rows, plan, [i for c, i in inner.items() if c != text_col] + ["t"], False)
    return out.withColumn(inner[text_col], F.when(F.col("t").isNotNull(), F.col("kept_")))


def removal_digest(docs: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by spaces; cases as in remove_repeats."""
    plan = _Plan(window, period, cover)
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))
    out = _cut_rows(rows, plan, ["k"], True)
    return out.select(F.col("k").alias("doc_id"), F.col("words_").alias("n_words"), F.col("removed_").alias("n_removed"), F.col("kept_").alias("kept_sha256"))

