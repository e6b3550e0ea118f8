"""Token counts of whole texts by a finite-state transducer compiled from a byte-level BPE tokenizer.

Compilation. Pre-tokenizer and BPE are one deterministic machine over characters. A state holds the kind of
pre-token being read, the BPE state of its bytes so far, and at most one character whose pre-token is not known
yet (the last of some white space, the first letter of a contraction of two). The BPE state rests on this: the
encoding of a prefix ends in one token, the only vocabulary entry that ends there and whose pair with the last
token before it no merge breaks. So it holds, for each earlier place from which a token could still go on: the
place in the vocabulary's trie, the last token up to that place, and how many more or fewer tokens the encoding
had there. Reading a character leads to one next state and emits the change of the number of tokens, so the
numbers along a path add up to the token count; a last number per state accounts for the held character where the
text ends. States and transitions are made when first met. A character that begins a new pre-token leads to the
same place whatever the old one was, so all such transitions share one entry.

Running. Every text is cut into chunks of ``CHUNK`` characters, wherever that falls. All chunks of a slice step
together, one character at a time, as array operations; each gets a state map (start state to end state and
count) over the first state and the states that the chunk before it can end in. Two paths through a chunk are
followed only until they meet. The maps then compose by a parallel scan: in every round each entry of a map is
joined with the one that it leads to, which doubles the chunks it spans.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from lorespan.llm import text as T
from lorespan.llm.tokens import byte_level_model

LETTER, NUMBER, SPACE, OTHER = range(4)
#: What follows an apostrophe in a contraction of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Kinds of state besides those of pre-tokens: before one, after an apostrophe that begins one, and after a contraction's first letter of two.
FRESH, QUOTE, ENDING = range(4, 7)
APOSTROPHE, NONE = 0x27, -1
CHUNK = 128
#: Transitions after which a worker starts anew with the next slice.
MAX_MOVES = 2_000_000
#: Remembered pairs of tokens.
MAX_PAIRS = 500_000


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """A class for each code point, from the Unicode tables of the library whose counts are to be met."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, code = "".join(map(chr, points)), np.array(points)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\P{L}+"), (NUMBER, r"\P{N}+"), (SPACE, r"\S+")):
        for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(every):
            out[code[a:b]] = kind
    return out


class Table:
    """An open-addressing map of int64 keys (>= 0) to rows of values, for whole arrays of keys."""

    def __init__(self, kinds: tuple[type, ...], bits: int = 16):
        self.kinds, self.size = kinds, 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.keys = bits, np.full(1 << bits, -1, np.int64)
        self.values = [np.zeros(1 << bits, k) for k in self.kinds]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the free place where it would go."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        wrong = np.flatnonzero((held != keys) & (held >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            held = self.keys[at[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held >= 0)]
        return at

    def put(self, keys: np.ndarray, *values: np.ndarray) -> None:
        """Distinct new keys."""
        while 2 * (self.size + len(keys)) > len(self.keys):
            old, rows = self.keys, self.values
            self._make(self.bits + 1)
            kept, self.size = np.flatnonzero(old >= 0), 0
            self._fill(old[kept], [r[kept] for r in rows])
        self._fill(keys, values)

    def _fill(self, keys, values) -> None:
        self.size += len(keys)
        left = np.arange(len(keys))
        while len(left):
            at, first = np.unique(self.find(keys[left]), return_index=True)
            own = left[first]
            self.keys[at] = keys[own]
            for column, v in zip(self.values, values, strict=True):
                column[at] = v[own]
            left = np.delete(left, first)


class Merges:
    """BPE of one pre-token as states: numbers, 0 before its first byte."""

    def __init__(self, path: str):
        ids, merges, self.added = byte_level_model(path)
        ranks, parts = {}, {}
        for rank, (a, b) in enumerate(merges):
            ranks[ids[a], ids[b]] = rank
            parts[ids[a + b]] = ids[a], ids[b], rank
        self._ranks, self._parts, self._never = ranks, parts, len(merges)
        self._spines: tuple[dict, dict] = ({}, {})
        self._pairs: dict[tuple[int, int], bool] = {}
        sound: dict[int, bool] = {}
        for word, token in sorted(ids.items(), key=lambda x: len(x[0])):
            made = parts.get(token)
            sound[token] = len(word) == 1 if made is None else sound[made[0]] and sound[made[1]] and self._joins(made[0], made[1]) == 2
        # trie: child by node << 8 | byte; the token that ends at each node; whether tokens go on from there
        self._child, self._token, self._inner = {}, [-1], [True]
        for word, token in ids.items():
            node = 0
            for b in word if sound[token] else b"":
                key = node << 8 | b
                self._inner[node] = True
                child = self._child.get(key)
                if child is None:
                    child = self._child[key] = len(self._token)
                    self._token.append(-1)
                    self._inner.append(False)
                node = child
            if node:
                self._token[node] = token
        self.forget()

    def forget(self) -> None:
        self._states: list[bytes] = []
        self._index: dict[bytes, int] = {}
        self._moves: dict[int, tuple[int, int]] = {}
        self._number(struct.pack("<3i", 0, -1, 0))

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at a token's left (0) or right (1) end as merges build it, each with the rank that ends its time."""
        known = self._spines[side]
        if token not in known:
            pieces, piece, until = [], token, self._never
            while piece in self._parts:
                pieces.append((piece, until))
                until, piece = self._parts[piece][2], self._parts[piece][side]
            known[token] = [*reversed([*pieces, (piece, until)])]
        return known[token]

    def _joins(self, x: int, y: int) -> int:
        """What merges do at the border of tokens x, y side by side: 0 nothing, 1 break them, 2 join x and y whole.

        Merges go by rank, equal ranks from the left: a merge over the border comes before those of
        higher rank at either side, and before an equal one on its right.
        """
        a, b, i, j = self._spine(x, 1), self._spine(y, 0), 0, 0
        while True:
            (p, ends_p), (q, ends_q) = a[i], b[j]
            rank = self._ranks.get((p, q), self._never)
            if rank < ends_p and rank <= ends_q and rank < self._never:
                return 2 if p == x and q == y else 1
            if ends_p == ends_q == self._never:
                return 0
            if ends_p <= ends_q:
                i += 1
            else:
                j += 1

    def _stay(self, x: int, y: int) -> bool:
        known = self._pairs.get((x, y))
        if known is None:
            known = self._pairs[x, y] = self._joins(x, y) == 0
            if len(self._pairs) > MAX_PAIRS:
                self._pairs.clear()
        return known

    def _number(self, state: bytes) -> int:
        found = self._index.get(state)
        if found is None:
            found = self._index[state] = len(self._states)
            self._states.append(state)
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the token count)."""
        still, token, change = [], -1, 0
        for node, last, ahead in struct.iter_unpack("<3i", self._states[state]):
            child = self._child.get(node << 8 | byte)
            if child is None:
                continue
            ends = self._token[child]
            if token < 0 <= ends and (last < 0 or self._stay(last, ends)):
                token, change = ends, ahead + 1
            if self._inner[child]:
                still.append((child, last, ahead))
        if token < 0:
            raise AssertionError("no token ends here: the vocabulary lacks a byte")
        packed = b"".join(struct.pack("<3i", n, t, c - change) for n, t, c in still)
        return self._number(packed + struct.pack("<3i", 0, token, 0)), change

    def read(self, state: int, point: int) -> tuple[int, int]:
        """(state after a character, change of the token count)."""
        change = 0
        for byte in chr(point).encode():
            key = state << 8 | byte
            move = self._moves.get(key)
            if move is None:
                move = self._moves[key] = self._compile(state, byte)
            state, change = move[0], change + move[1]
        return state, change


class Machine:
    """The transducer of one tokenizer; states are numbers, 0 the first."""

    def __init__(self, path: str, classes: np.ndarray):
        self.merges, self.classes = Merges(path), classes
        self.added = self.merges.added
        self.forget()

    def forget(self) -> None:
        self.merges.forget()
        self._states: list[tuple[int, int, int]] = []
        self._index: dict[tuple[int, int, int], int] = {}
        self._moves = Table((np.int32, np.int16))
        #: By state: the class of characters that go on with the pre-token, the state that stands for this one at all others, and what the text's end adds.
        self._same, self._reset, self._last = np.zeros(1024, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._number((FRESH, 0, NONE))

    @property
    def size(self) -> int:
        return self._moves.size

    def _number(self, state: tuple[int, int, int]) -> int:
        found = self._index.get(state)
        if found is not None:
            return found
        number = self._index[state] = len(self._states)
        self._states.append(state)
        if number == len(self._same):
            self._same, self._reset, self._last = (np.concatenate([x, np.zeros_like(x)]) for x in (self._same, self._reset, self._last))
        kind, bpe, held = state
        self._same[number] = kind if kind < FRESH else 0xFF
        self._reset[number] = number if kind >= FRESH else self._number((SPACE, 0, held)) if kind == SPACE and bpe else number if kind == SPACE else 0
        self._last[number] = self.merges.read(bpe if kind == SPACE else 0, held)[1] if held != NONE else 0
        return number

    def _begin(self, point: int) -> tuple[tuple[int, int, int], int]:
        """The first character of a pre-token."""
        kind = int(self.classes[point])
        if kind == SPACE:
            return (SPACE, 0, point), 0
        bpe, change = self.merges.read(0, point)
        return (QUOTE if point == APOSTROPHE else kind, bpe, NONE), change

    def _next(self, state: tuple[int, int, int], point: int) -> tuple[tuple[int, int, int], int]:
        kind, bpe, held = state
        own, read = int(self.classes[point]), self.merges.read
        if kind == SPACE and own == SPACE:
            bpe, change = read(bpe, held)
            return (SPACE, bpe, point), change
        if kind == SPACE:  # what came before the held character is a pre-token
            after, change = read(0, held)
            if held == 0x20:
                bpe, more = read(after, point)
                return (own, bpe, NONE), change + more
            state, more = self._begin(point)
            return state, change + more
        if kind == QUOTE and chr(point) in CONTRACTIONS:
            return (FRESH, 0, NONE), read(bpe, point)[1]
        if kind == QUOTE and any(c[0] == chr(point) for c in CONTRACTIONS):
            return (ENDING, bpe, point), 0
        if kind == ENDING:
            if chr(held) + chr(point) in CONTRACTIONS:
                bpe, change = read(bpe, held)
                return (FRESH, 0, NONE), change + read(bpe, point)[1]
            bpe, change = read(0, held)
            state, more = self._next((LETTER, bpe, NONE), point)
            return state, change + more
        if own == (OTHER if kind == QUOTE else kind):
            bpe, change = read(bpe, point)
            return (own, bpe, NONE), change
        return self._begin(point)

    def step(self, states: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, emitted changes) of one character each."""
        states = np.where(self._same[states] == self.classes[points], states, self._reset[states])
        keys = states << 21 | points
        at = self._moves.find(keys)
        new = np.unique(keys[self._moves.keys[at] < 0])
        if len(new):
            made = [self._next(self._states[k >> 21], k & 0x1FFFFF) for k in new.tolist()]
            self._moves.put(new, np.array([self._number(s) for s, _ in made], np.int32), np.array([c for _, c in made], np.int16))
            at = self._moves.find(keys)
        return self._moves.values[0][at].astype(np.int64), self._moves.values[1][at]

    def run(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end state, emitted count) of each span read from the first state, all spans together."""
        order = np.argsort(-lengths, kind="stable")
        at, size, now = starts[order], lengths[order], np.zeros(len(order), np.int64)
        counts = np.zeros(len(order), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t))
            now[:n], change = self.step(now[:n], points[at[:n] + t])
            counts[:n] += change
        ends, out = np.empty_like(now), np.empty_like(counts)
        ends[order], out[order] = now, counts
        return ends, out

    def run_beside(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans read from ``states`` next to the path from the first state until both meet: (state where it ends or -1 if they met, count less that of the other path)."""
        ends, ahead = np.full(len(states), -1), np.zeros(len(states), np.int64)
        lane, now, other, t = np.flatnonzero(states != 0), states[states != 0], np.zeros(int((states != 0).sum()), np.int64), 0
        while len(lane):
            over = lengths[lane] == t
            ends[lane[over]] = now[over]
            lane, now, other = lane[~over], now[~over], other[~over]
            read = points[starts[lane] + t]
            both, change = self.step(np.concatenate([now, other]), np.concatenate([read, read]))
            now, other = both[: len(lane)], both[len(lane) :]
            ahead[lane] += change[: len(lane)].astype(np.int64) - change[len(lane) :]
            apart = now != other
            lane, now, other, t = lane[apart], now[apart], other[apart], t + 1
        return ends, ahead

    def counts(self, points: np.ndarray, first: np.ndarray, chunk: int = 0) -> np.ndarray:
        """Token counts of texts whose characters are points[first[d] : first[d + 1]]."""
        chunk, out = chunk or CHUNK, np.zeros(len(first) - 1, np.int64)
        many = -(-np.diff(first) // chunk)
        if not many.any():
            return out
        of = np.repeat(np.arange(len(out)), many)
        opens = np.concatenate([[0], np.cumsum(many)])[:-1][many > 0]  # the first chunk of each text that has one
        starts = T.ranges(np.zeros(len(many), np.int64), many) * chunk + first[of]
        lengths = np.minimum(chunk, first[of + 1] - starts)
        leads = np.concatenate([of[1:] == of[:-1], [False]])  # whether a chunk of the same text follows

        # state maps: entries (chunk, start state) -> (end state, count), kept in order of their keys
        ends, counts = self.run(points, starts, lengths)
        straight = ends, counts
        keys = np.arange(len(of)) << 32
        fresh = np.arange(len(of))
        while len(fresh):
            where = keys[fresh] >> 32
            on = leads[where]
            wanted = np.unique(where[on] + 1 << 32 | ends[fresh][on])
            place = np.searchsorted(keys, wanted)
            wanted = wanted[keys[np.minimum(place, len(keys) - 1)] != wanted]
            where, state = wanted >> 32, wanted & 0xFFFFFFFF
            end, ahead = self.run_beside(points, starts[where], lengths[where], state)
            end = np.where(end < 0, straight[0][where], end)
            order = np.argsort(np.concatenate([keys, wanted]), kind="stable")
            fresh = np.flatnonzero(order >= len(keys))
            keys, ends, counts = (np.concatenate(x)[order] for x in ((keys, wanted), (ends, end), (counts, straight[1][where] + ahead)))
        out[many > 0] = self._composed(keys, ends, counts, leads)[np.searchsorted(keys, opens << 32)]
        return out

    def _composed(self, keys: np.ndarray, ends: np.ndarray, counts: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """Of each entry, the count from its chunk's start to the text's end; rounds double the chunks that entries span."""
        lead = np.where(leads[keys >> 32], np.searchsorted(keys, ((keys >> 32) + 1 << 32) | ends), -1)
        total = counts + np.where(lead < 0, self._last[ends], 0)
        live = np.flatnonzero(lead >= 0)
        while len(live):
            to = lead[live]
            total[live], lead[live] = total[live] + total[to], lead[to]
            self.compositions += len(live)
            live = live[lead[live] >= 0]
        return total

    #: Entries of state maps that were joined with another one so far.
    compositions = 0


def split_added(raw: np.ndarray, offsets: np.ndarray, added: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, text of each part, added tokens of each text): texts split at added tokens' strings."""
    n = len(offsets) - 1
    data, extra = raw.tobytes(), np.zeros(n, np.int64)
    if not any(a.encode() in data for a in added):
        return raw, offsets, np.arange(n), extra
    pattern = re.compile(b"|".join(re.escape(a.encode()) for a in sorted(added, key=len, reverse=True)))
    parts, owner = [], []
    for d in range(n):
        own = pattern.split(data[offsets[d] : offsets[d + 1]])
        extra[d] = len(own) - 1
        parts += own
        owner += [d] * len(own)
    joined = np.frombuffer(b"".join(parts), np.uint8)
    return joined, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array(owner), extra


class Counter:
    """Token counts of slices of texts."""

    def __init__(self, path: str, classes: np.ndarray):
        self.machine = Machine(path, classes)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.machine.size > MAX_MOVES:
            self.machine.forget()
        n = len(offsets) - 1
        raw, offsets, owner, out = split_added(raw, offsets, self.machine.added)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(T.code_points(raw), out=sums[1:])
        return out + np.bincount(owner, weights=self.machine.counts(points, sums[offsets]), minlength=n).astype(np.int64)


@lru_cache(maxsize=1)
def _counter(path: str, classes: bytes) -> Counter:
    """One per worker process."""
    return Counter(path, np.frombuffer(classes, np.uint8))


def _count(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, shared.value)
        for part, raw, offsets in T.slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(counter(raw, offsets))], names=["k", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Counts equal those of the ``tokenizers`` library without begin, end or added special tokens; strings of
    added tokens inside texts count as those tokens. The file must be a plain byte-level BPE tokenizer, else
    ValueError. Null and empty texts have 0 bytes and tokens; null ids, repeated rows and an empty
    table pass as they are; further columns are left out.
    """
    with open(tokenizer, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(a.get("single_word") or a.get("lstrip") or a.get("rstrip") for a in added):
        raise ValueError("added tokens that take in their surroundings are not supported")
    byte_level_model(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(character_classes().tobytes())
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    out = T.mapped(rows, _count(tokenizer, shared), f"k {rows.schema['k'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
