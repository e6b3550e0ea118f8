"""Whole-text word machinery shared by the operators: Arrow string buffers in, numpy arrays out.

A text is never cut to a prefix. Batches are walked in slices of about ``SLICE_BYTES`` of text, so the
working memory of a task does not depend on the number of rows; one text longer than a slice is a slice
of its own, and its words are hashed block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark hands a worker at once (by number of rows alone, long texts have no bound).
BATCH_BYTES = 4 << 20
_BLOCK = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes that end a word: white space as in [\x20\x09-\x0D].
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words of everything else.
BLANK_SEPARATED = ~SPACES
#: Words of 0-9, a-z, A-Z (to be lowered) and every non-ASCII character.
ALNUM_LOWERED = np.zeros(256, bool)
ALNUM_LOWERED[0x30:0x3A] = ALNUM_LOWERED[0x41:0x5B] = ALNUM_LOWERED[0x61:0x7B] = ALNUM_LOWERED[0x80:] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if not _cache or len(_cache[0][0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _cache[0] = _powers(size, _BASE), _powers(size, _BASE_INV)
    return _cache[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty. offsets start at 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mapped(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow(function, schema) with batches of bounded size, which holds for the session from now on."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches, with the text column's bytes and offsets; about ``limit`` bytes or one text each."""
    for batch in batches:
        raw, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Words:
    """Words of the texts in a slice: byte spans, 64-bit hashes and each text's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray, lower: bool = False):
        is_word = alphabet[raw]
        begins = np.zeros(len(raw) + 1, bool)
        begins[offsets[:-1]] = True
        begins = begins[: len(raw)]
        before = np.empty_like(is_word)
        before[:1] = False
        before[1:] = is_word[:-1] & ~begins[1:]
        self.starts = np.flatnonzero(is_word & ~before)
        # a word ends where the next byte is no word byte or belongs to the next text
        after = np.zeros_like(is_word)
        after[:-1] = is_word[1:] & ~begins[1:]
        self.ends = np.flatnonzero(is_word & ~after) + 1
        self.raw, self.offsets, self.lower = raw, offsets, lower
        #: word i of text d is at first[d] + i
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends, seed, self.lower)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes (and length) of each span, spans in order; independent for each seed."""
    codes = _byte_codes(seed)
    if lower:
        codes = codes[LOWER]
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        begin, end = int(starts[at]), int(ends[to - 1])
        power, inverse = _tables(end - begin + 1)
        sums = np.zeros(end - begin + 1, _U)
        np.cumsum(codes[raw[begin:end]] * power[: end - begin], out=sums[1:])
        a, b = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U))
        at = to
    return out


def windows(hashes: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Hash of the ``size`` words from each word on, as a rolling polynomial; len(hashes) - size + 1 of them.

    A window may span two texts: the caller masks those.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    if size <= 8:
        out = np.zeros(n, _U)
        factor = 1
        for k in range(size):
            out += hashes[k : k + n] * _U(factor)
            factor = factor * (_BASE + 2 * seed) % (1 << 64)
        return mix(out)
    out = np.empty(n, _U)
    step = 1 << 20  # in blocks, so that the tables of powers stay small
    base = (_BASE + 2 * seed) % (1 << 64)
    width = min(step, n) + size
    power, inverse = _powers(width, base), _powers(width, pow(base, -1, 1 << 64))
    for at in range(0, n, step):
        m = min(step, n - at)
        sums = np.zeros(m + size, _U)
        np.cumsum(hashes[at : at + m + size - 1] * power[: m + size - 1], out=sums[1:])
        out[at : at + m] = mix((sums[size : size + m] - sums[:m]) * inverse[:m])
    return out


def whole_window(words: Words, size: int) -> np.ndarray:
    """Which of the windows lie in one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    last = np.repeat(words.first[1:], words.counts)
    return np.arange(n) + size <= last[:n]


def code_points(raw: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a UTF-8 character."""
    return (raw & 0xC0) != 0x80


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. +counts[0], starts[1] .. +counts[1], ... in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + shift
