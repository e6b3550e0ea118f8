"""A full-text index of word symbols: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import io

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling of those that are not yet alone.

    Symbol 0 separates and ends the text: zeros differ by position, so no comparison goes past one and the number
    of rounds follows the longest passage that repeats.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    zero = symbols == 0
    zeros = int(zero.sum())
    rank = symbols.astype(np.int64) + zeros
    rank[zero] = np.arange(zeros)
    bits = int(rank.max()).bit_length() or 1
    step = max(1, 63 // bits)
    key = rank.copy()
    for j in range(1, step):
        key <<= bits
        key[: max(0, n - j)] |= rank[j:]
    order = np.argsort(key)
    slots, run = np.arange(n), key[order]
    while True:
        at = order[slots]
        fresh = np.append(True, run[1:] != run[:-1])
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] << 32 | rank[at + step]
        by = np.argsort(key)
        order[slots], run, step = at[by], key[by], 2 * step


class Bits:
    """A bit vector in 64-bit words with counts of ones before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8")

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank and access on a sequence over 0..sigma-1, one bit vector a level, vectorised over queries."""

    def __init__(self, levels: list[np.ndarray], n: int, sigma: int):
        self.levels = [Bits(w) for w in levels]
        self.zeros = [n - int(b.rank(np.array([n]))[0]) for b in self.levels]
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    @staticmethod
    def packed(values: np.ndarray, sigma: int) -> list[np.ndarray]:
        values, out = values.astype(np.uint32), []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (values >> np.uint32(level) & np.uint32(1)).astype(bool)
            out.append(Bits.packed(bit))
            values = np.concatenate([values[~bit], values[bit]])
        return out

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            up = bits.rank(at)
            at = np.where(symbols >> (len(self.levels) - 1 - k) & 1 == 1, zeros + up, at - up)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._walk(symbols, at) - self.start[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, its rank there)."""
        symbols = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            up, bit = bits.rank(at), bits.get(at)
            symbols = 2 * symbols + bit
            at = np.where(bit == 1, zeros + up, at - up)
        return symbols, at - self.start[symbols]


class FMIndex:
    """symbols: 1..sigma-1, and 0 after each segment (also after the last). Patterns hold no 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        order = suffix_array(symbols)
        before = np.where(order > 0, symbols[order - 1], 0)
        # segment starts are always sampled, so that no walk goes over a separator
        kept = (order % sample == 0) | (before == 0)
        self._set({"levels": np.array(WaveletMatrix.packed(before, sigma)), "counts": np.bincount(symbols, minlength=sigma).astype(np.int32), "kept": Bits.packed(kept), "samples": order[kept].astype(np.int32)})

    def _set(self, parts: dict[str, np.ndarray]) -> None:
        self.parts = parts
        self.less = np.concatenate([[0], np.cumsum(parts["counts"], dtype=np.int64)])
        self.matrix = WaveletMatrix([*parts["levels"]], int(self.less[-1]), len(parts["counts"]))
        self.kept, self.samples = Bits(parts["kept"]), parts["samples"]

    def to_bytes(self, **more: np.ndarray) -> bytes:
        """The index and further arrays, as bytes."""
        out = io.BytesIO()
        np.savez(out, **self.parts, **more)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[FMIndex, dict[str, np.ndarray]]:
        """The index and the further arrays that ``to_bytes`` was given."""
        with np.load(io.BytesIO(data), allow_pickle=False) as f:
            parts = {k: f[k] for k in f.files}
        index = cls.__new__(cls)
        index._set({k: parts.pop(k) for k in ("levels", "counts", "kept", "samples")})
        return index, parts

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns of one length (one a row): first and last + 1 of each one's suffix range."""
        lo, hi = self.less[patterns[:, -1]], self.less[patterns[:, -1] + 1]
        alive = np.flatnonzero(hi > lo)
        for column in reversed(range(patterns.shape[1] - 1)):
            symbols = patterns[alive, column]
            lo[alive] = self.less[symbols] + self.matrix.rank(symbols, lo[alive])
            hi[alive] = self.less[symbols] + self.matrix.rank(symbols, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the text until a sampled row."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            done = self.kept.get(rows) == 1
            out[left[done]] = self.samples[self.kept.rank(rows[done])] + steps
            left, rows = left[~done], rows[~done]
            symbols, ranks = self.matrix.access(rows)
            rows, steps = self.less[symbols] + ranks, steps + 1
        return out
