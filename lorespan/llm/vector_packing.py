"""Packing of examples under several limits at once (tokens, segments, loss-bearing tokens).

Placement is vector bin packing by the dot-product heuristic: an open sequence takes, of the pieces that
fit, the one whose demands weigh most against what the sequence has left. Gaps that no whole piece fits
are then filled by cutting pieces of the emptiest sequences, and what is left at the end of a group is cut
into power-of-two lengths, which need no padding.

Each task packs its own rows in groups of bounded size: no shuffle, memory bounded by a group (or by one
document). Sequence ids hold the partition number, so a task that runs again on another executor gives
the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm import text as T
from lorespan.llm.tokens import encoder, proven

GROUP_DOCS = 4096
GROUP_TOKENS = 4 << 20
FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


@dataclass(frozen=True)
class Limits:
    """Of one sequence. A power of two as ``tokens`` lets remainders go without padding."""

    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("limits must be positive")


class _Sequence:
    __slots__ = ("loss", "pieces", "tokens")

    def __init__(self):
        self.pieces, self.tokens, self.loss = [], 0, 0

    def add(self, piece: tuple[int, int, int], loss: int) -> None:
        self.pieces.append(piece)
        self.tokens += piece[2]
        self.loss += loss


def loss_of(start: int, length: int, loss_from: int) -> int:
    """Loss-bearing tokens of a piece: those at or after the document's ``loss_from``."""
    return max(0, start + length - max(start, loss_from))


def place(lengths: np.ndarray, loss_from: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents of these lengths once."""
    out, rest = [], []
    for d, n in enumerate(lengths.tolist()):
        at, n = _balanced(d, n, int(loss_from[d]), limits, out)
        while n - at >= limits.tokens or loss_of(at, n - at, int(loss_from[d])) > limits.loss_tokens:
            size = min(limits.tokens, n - at, max(0, int(loss_from[d]) - at) + limits.loss_tokens)
            if size == limits.tokens:
                out.append([(d, at, size)])
            else:
                rest.append((d, at, size))
            at += size
        if at < n:
            rest.append((d, at, n - at))
    rest.sort(key=lambda p: (-p[2], p[0], p[1]))
    sequences = _by_dot_product(rest, loss_from, limits)
    _fill_gaps(sequences, loss_from, limits)
    two = limits.tokens & (limits.tokens - 1) == 0
    for s in sequences:
        out += _powers_of_two(s.pieces) if two else [s.pieces]
    return out


def _balanced(d: int, n: int, loss_from: int, limits: Limits, out: list) -> tuple[int, int]:
    """Full sequences of a long document, each of tokens from before its loss and from its end in the document's own
    proportion, as far as the limits allow; returns the middle that is left."""
    at, loss_from = 0, min(loss_from, n)
    tail = min(limits.loss_tokens, limits.tokens * (n - loss_from) // n) if n else 0
    head = limits.tokens - tail
    while limits.segments > 1 and tail and n - at >= limits.tokens and loss_from - at >= head and n - loss_from >= tail:
        out.append([(d, at, head), (d, n - tail, tail)])
        at, n = at + head, n - tail
    return at, n


def _by_dot_product(pieces: list[tuple[int, int, int]], loss_from: np.ndarray, limits: Limits) -> list[_Sequence]:
    if not pieces:
        return []
    tokens = np.array([p[2] for p in pieces])
    loss = np.array([loss_of(p[1], p[2], int(loss_from[p[0]])) for p in pieces])
    demand = np.stack([tokens / limits.tokens, np.full(len(pieces), 1 / limits.segments), loss / limits.loss_tokens])
    weighted = demand * demand.mean(axis=1, keepdims=True)  # scarce dimensions count for more
    left, sequences = np.arange(len(pieces)), []
    while len(left):
        s = _Sequence()
        while True:
            free = limits.tokens - s.tokens, limits.segments - len(s.pieces), limits.loss_tokens - s.loss
            if not free[1] or not free[0]:
                break
            # pieces are sorted by tokens: those that fit by tokens are a tail
            fit = left[int(np.searchsorted(-tokens[left], -free[0])) :]
            fit = fit[loss[fit] <= free[2]]
            if not len(fit):
                break
            score = (free[0] / limits.tokens) * weighted[0, fit] + (free[1] / limits.segments) * weighted[1, fit] + (free[2] / limits.loss_tokens) * weighted[2, fit]
            best = int(fit[int(np.argmax(score))])
            s.add(pieces[best], int(loss[best]))
            left = np.delete(left, int(np.searchsorted(left, best)))
        sequences.append(s)
    return sequences


def _fill_gaps(sequences: list[_Sequence], loss_from: np.ndarray, limits: Limits) -> None:
    """Cuts pieces off the emptiest sequences into the gaps of the fullest, until none is left to give."""
    sequences.sort(key=lambda s: s.tokens)
    low, high = 0, len(sequences) - 1
    while low < high:
        to, giver = sequences[high], sequences[low]
        gap, slots, loss_left = limits.tokens - to.tokens, limits.segments - len(to.pieces), limits.loss_tokens - to.loss
        if not gap or not slots or not loss_left:
            high -= 1
            continue
        d, at, n = giver.pieces.pop()
        giver.tokens -= n
        giver.loss -= loss_of(at, n, int(loss_from[d]))
        take = min(gap, n, max(0, int(loss_from[d]) - at) + loss_left)
        to.add((d, at, take), loss_of(at, take, int(loss_from[d])))
        if take < n:
            giver.add((d, at + take, n - take), loss_of(at + take, n - take, int(loss_from[d])))
        if not giver.pieces:
            low += 1
    sequences[:] = [s for s in sequences if s.pieces]


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    out, pieces, total = [], pieces[::-1], sum(p[2] for p in pieces)
    for bit in reversed(range(total.bit_length())):
        want, sequence = total & (1 << bit), []
        if not want:
            continue
        while want:
            d, at, n = pieces.pop()
            take = min(want, n)
            sequence.append((d, at, take))
            want -= take
            if take < n:
                pieces.append((d, at + take, n - take))
        out.append(sequence)
    return out


def _packer(path: str, same: bool, limits: Limits, end_id: int, prefix_share: float, prefix_most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, base, made = encoder(path, same), TaskContext.get().partitionId() << 33, 0

        def flush(keys, ids, loss_from):
            nonlocal made
            lengths = np.array([len(x) for x in ids])
            rows, of = [], []
            for sequence in place(lengths, np.array(loss_from), limits):
                offset = 0
                for d, at, n in sequence:
                    of.append(d)
                    rows.append((at, n, zlib.crc32(ids[d][at : at + n].tobytes()), int(lengths[d]), base + made, offset, loss_of(at, n, loss_from[d])))
                    offset += n
                made += 1
            own = (keys[0] if len(keys) == 1 else pa.concat_arrays(keys)).take(pa.array(of))
            return pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", *FIELDS])

        keys, ids, loss_from, held = [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text, prompt = batch.column(1)[i], batch.column(2)[i]
                head = codec.ids(prompt.as_py()) if prompt.is_valid else np.zeros(0, np.uint32)
                body = codec.ids(text.as_py()) if text.is_valid else np.zeros(0, np.uint32)
                row = np.concatenate([head, body, np.array([end_id], np.uint32)]).astype("<u4")
                keys.append(batch.column(0).slice(i, 1))
                ids.append(row)
                loss_from.append(len(head) + min(prefix_most, int(prefix_share * len(body))))
                held += len(row)
                if len(keys) >= GROUP_DOCS or held >= GROUP_TOKENS:
                    yield flush(keys, ids, loss_from)
                    keys, ids, loss_from, held = [], [], [], 0
        if keys:
            yield flush(keys, ids, loss_from)

    return pack


def pack_examples(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, prefix_share: float = 0.0, prefix_most: int = 512) -> DataFrame:
    """One row per piece: where its tokens are in its document and in its sequence.

    docs: ``id_col``, ``text_col``, and optionally ``prompt_col``, a text that comes first and bears no loss
    (instruction data); of the text's own tokens the first ``prefix_share``, at most ``prefix_most``, bear none
    either (prefix language modelling). Null texts count as empty; every example ends with ``end_id``, so an empty one is a single token.
    Repeated ids and rows are packed as separate examples; a null id stays null; other columns are ignored; an empty
    table gives no rows. A text longer than a sequence is cut without loss.
    """
    prompt = F.col(f"`{prompt_col}`") if prompt_col else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), prompt.cast("string").alias("prompt"))
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *(f"{f} long" for f in FIELDS)])
    return T.mapped(rows, _packer(tokenizer, proven(tokenizer), limits, end_id, prefix_share, prefix_most), schema)
