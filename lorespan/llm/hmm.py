"""A hidden Markov language model of whole texts: latent states trained by Baum-Welch, sequences scored exactly.

Every word of the training texts is counted. Words too rare to be symbols of their own share a class by how they end;
a state emits the class, and the class the word by its count, so the model gives every text a proper probability and
the tables that go to tasks stay bounded whatever the vocabulary:

* symbols (``Settings.symbols``): words above one count, 256 classes and the end of a text, emitted by the states;
* counted words (``Settings.counted``): words above a lower count, whose counts go along with the symbols;
* all others: their counts stay a distributed table that a document's rare words are joined with.

Texts become symbol numbers once, in a settled table. Each round of Baum-Welch is a pass over that table: tasks add up
expected counts, Spark adds the tasks', the driver sees one row a symbol. Documents longer than a chunk are composed
from the chunks' transition products, so the recursions run over many chunks at once and are exact at any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm import text as T
from lorespan.llm.store import discard, settle

C = F.col
CLASSES = 256
SLICE_BYTES = 4 << 20
_STEPS = 16  # between scalings: emissions are no smaller than the unigram model's


@dataclass(frozen=True)
class Settings:
    states: int = 8
    rounds: int = 3
    #: Bounds of the broadcast tables, in words; symbols and classes fit 16 bits.
    symbols: int = 65_000
    counted: int = 1 << 19
    #: Tokens of a chunk, and of the chunks that are handled at once.
    chunk: int = 4096
    group: int = 1 << 18
    seed: int = 11


@dataclass
class Lexicon:
    """Counted words in order of their hashes: second hash, count, symbol (or -1); of the classes, how a word's count counts."""

    first: np.ndarray
    second: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    words: int
    #: log10 of what the counts of a class's words, plus one each and one for those never seen, add up to
    class_total: np.ndarray
    symbol_count: np.ndarray

    @property
    def end(self) -> int:
        return self.words + CLASSES

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Places of words, -1 where they are not among the counted."""
        if not len(self.first):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.first, h), len(self.first) - 1)
        return np.where((self.first[at] == h) & (self.second[at] == g), at, -1)


@dataclass
class Model:
    """Probabilities of the first state, of the next one by state, and of symbols (rows) by state."""

    initial: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each different pair, which of these every pair is)."""
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    if (g[index][inverse] != g).any():
        _, index, inverse = np.unique(np.stack([h, g], axis=1), axis=0, return_index=True, return_inverse=True)
    return index, inverse.reshape(-1)


def _hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, two independent hashes of each, the class by its last two bytes."""
    words = T.Words(raw, offsets, T.BLANK_SEPARATED, lower=True)
    last = T.LOWER[raw[words.ends - 1]].astype(np.uint32)
    before = np.where(words.ends - words.starts > 1, T.LOWER[raw[np.maximum(words.ends - 2, 0)]], 0).astype(np.uint32)
    return words, words.hashes(1), words.hashes(2), ((last * 251 + before * 7919 + (before >> 3)) % CLASSES).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, raw, offsets in T.slices(batches, "t", SLICE_BYTES):
        _, h, g, kind = _hashed(raw, offsets)
        index, which = _distinct(h, g)
        n = np.bincount(which, minlength=len(index))
        columns = [T.signed(h[index]), T.signed(g[index]), pa.array(kind[index]), pa.array(n)]
        ends = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), pa.array([part.num_rows])]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(columns, ends, strict=True)], names=["h", "g", "kind", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, g, kind, c): every different word of the column ``t``, by two hashes, its class and count; nulls: the ends."""
    return settle(T.mapped(texts, _counts, "h long, g long, kind int, n long").groupBy("h", "g").agg(F.max("kind").alias("kind"), F.sum("n").alias("c")))


def _floor_of_counts(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more, to the sixteenth of an octave."""
    octave = F.floor(F.log2("c") * 16 + 1e-9).cast("int")
    taken, least = 0, None
    for r in counts.groupBy(octave.alias("o")).count().orderBy(F.desc("o")).collect():  # under 1,024 rows
        taken += r["count"]
        if taken > most:
            break
        least = r["o"]
    return (1 << 62) if least is None else max(1, math.ceil(2 ** (least / 16)))


def lexicon(counts: DataFrame, settings: Settings) -> tuple[Lexicon, int, int, int]:
    """(lexicon, N, V, the least count of its words). N and V hold the ends of texts as one word."""
    words = counts.filter("h is not null")
    total = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(C("h").isNull(), C("c")))).first()
    tokens, different, ends = (x or 0 for x in total)
    least, least_symbol = (_floor_of_counts(words, n) for n in (settings.counted, settings.symbols))
    found = words.filter(C("c") >= least).select("h", "g", "c").toArrow()
    h, g, c = (found.column(n).to_numpy() for n in ("h", "g", "c"))
    order = np.lexsort((g, h.view(np.uint64)))
    h, g, c = h.view(np.uint64)[order], g.view(np.uint64)[order], c[order]
    own = c >= least_symbol
    symbol = np.where(own, np.cumsum(own) - 1, -1).astype(np.int32)
    n = int(own.sum())
    classes, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in words.filter(C("c") < least_symbol).groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        classes[r["kind"]], kinds[r["kind"]] = r["c"], r["n"]
    symbol_count = np.concatenate([c[own], classes, [ends]])
    return Lexicon(h, g, c, symbol, n, np.log10(classes + kinds + 1.0), symbol_count), tokens, different, least


def _encoded(shared, names: list[str]):
    def lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Lexicon = shared.value
        for part, raw, offsets in T.slices(batches, "t", SLICE_BYTES):
            words, h, g, kind = _hashed(raw, offsets)
            index, which = _distinct(h, g)
            place = known.find(h[index], g[index])
            symbol = np.where(place >= 0, known.symbol[place] if len(known.symbol) else -1, -1)
            classed = symbol < 0
            symbol = np.where(classed, known.words + kind[index], symbol)
            logs = np.log10(np.where(place >= 0, known.count[place] if len(known.count) else 0, 0) + 1.0)
            owner = words.text_of()
            n = part.num_rows
            added = lambda x, owner=owner, n=n: np.bincount(owner, x, minlength=n)
            base = added(logs[which])
            inner = added(np.where(classed, logs - known.class_total[kind[index]], 0.0)[which])
            found = added((place >= 0).astype(float)[which]).astype(np.int64)
            # symbols of each text, then its end
            at = np.arange(len(which)) + owner
            symbols = np.full(len(which) + n, known.end, np.uint16)
            symbols[at] = symbol[which]
            ends = 2 * (words.first + np.arange(n + 1))
            blobs = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(symbols)]).cast(pa.binary())
            rare = np.flatnonzero(place[which] < 0)
            keys, times = np.unique(owner[rare] * len(index) + which[rare], return_counts=True)
            whose, word = keys // max(1, len(index)), index[keys % max(1, len(index))]
            own = [part.column(part.schema.get_field_index(c)) for c in names]
            numbers = [pa.array(words.counts + 1, pa.int64()), pa.array(found), pa.array(base), pa.array(inner)]
            rares = [lists(whose, x, n) for x in (T.signed(h[word]), T.signed(g[word]), pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own, *numbers, blobs, *rares], names=[*names, "n_tokens", "found", "base", "inner", "symbols", "rare_h", "rare_g", "rare_n"])

    return run


class Chunks:
    """Texts' symbols cut into chunks of at most ``size``, and what the model says of them."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, model: Model, settings: Settings):
        self.symbols, self.model, self.settings = symbols, model, settings
        self.parts = -(-counts // settings.chunk)  # a text has its end at least
        self.text = np.repeat(np.arange(len(counts)), self.parts)
        self.of_text = np.concatenate([[0], np.cumsum(self.parts)])
        within = np.arange(len(self.text)) - self.of_text[self.text]
        self.starts = (np.cumsum(counts) - counts)[self.text] + within * settings.chunk
        self.counts = np.minimum(counts[self.text] - within * settings.chunk, settings.chunk)
        self.opens = within == 0
        self.long = self.parts[self.text] > 1

    def groups(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(chunks, longest first; symbols by step, then chunk; where steps begin) of so many tokens at a time."""
        which = which[np.argsort(-self.counts[which], kind="stable")]
        at = 0
        while at < len(which):
            to = at + max(1, int(np.searchsorted(np.cumsum(self.counts[which[at : at + self.settings.group]]), self.settings.group, "right")))
            own = which[at:to]
            n = self.counts[own]
            active = np.searchsorted(-n, -np.arange(n[0]), "left")  # chunks longer than each step
            base = np.concatenate([[0], np.cumsum(active)])
            step = np.repeat(np.arange(n[0]), active)
            chunk = np.arange(base[-1]) - base[step]
            yield own, self.symbols[self.starts[own][chunk] + step], base
            at = to

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Of chunks of long texts: the products of their steps, scaled, and the logarithms of the scales."""
        s = self.settings.states
        out, logs = np.zeros((len(self.text), s, s)), np.zeros(len(self.text))
        for own, symbols, base in self.groups(np.flatnonzero(self.long)):
            emit = self.model.emit[symbols]
            now = np.where(self.opens[own][:, None, None], np.eye(s), self.model.step) * emit[: base[1]][:, None, :]
            scale = np.zeros(len(own))
            for t in range(1, len(base) - 1):
                n = base[t + 1] - base[t]
                now[:n] = (now[:n].reshape(-1, s) @ self.model.step).reshape(-1, s, s) * emit[base[t] : base[t + 1]][:, None, :]
                if t % _STEPS == 0:
                    total = now[:n].sum(axis=(1, 2))
                    now[:n] /= total[:, None, None]
                    scale[:n] += np.log(total)
            total = now.sum(axis=(1, 2))
            out[own], logs[own] = now / total[:, None, None], scale + np.log(total)
        return out, logs

    def boundaries(self, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State weights before each chunk and the chance of what follows it by state, both scaled."""
        entry = np.tile(self.model.initial, (len(self.text), 1))
        leave = np.ones((len(self.text), self.settings.states))
        for text in np.flatnonzero(self.parts > 1):
            a, b = self.of_text[text], self.of_text[text + 1]
            for c in range(a + 1, b):
                entry[c] = entry[c - 1] @ products[c - 1]
                entry[c] /= entry[c].sum()
            for c in range(b - 2, a - 1, -1):
                leave[c] = products[c + 1] @ leave[c + 1]
                leave[c] /= leave[c].sum()
        return entry, leave

    def _first(self, own: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """State weights before the first symbols."""
        return np.where(self.opens[own][:, None], entry[own], entry[own] @ self.model.step)

    def likelihoods(self) -> np.ndarray:
        """Natural logarithm of every text's probability, by the scaled forward recursion."""
        out = np.zeros(len(self.parts))
        for own, symbols, base in self.groups(np.flatnonzero(~self.long)):
            emit, scale = self.model.emit[symbols], np.zeros(len(own))
            now = self.model.initial * emit[: base[1]]
            for t in range(1, len(base) - 1):
                n = base[t + 1] - base[t]
                now[:n] = (now[:n] @ self.model.step) * emit[base[t] : base[t + 1]]
                if t % _STEPS == 0:
                    total = now[:n].sum(axis=1)
                    now[:n] /= total[:, None]
                    scale[:n] += np.log(total)
            out[self.text[own]] = scale + np.log(now.sum(axis=1))
        if self.long.any():
            products, logs = self.products()
            for text in np.flatnonzero(self.parts > 1):
                now, total = self.model.initial, 0.0
                for c in range(self.of_text[text], self.of_text[text + 1]):
                    now = now @ products[c]
                    total += logs[c] + math.log(now.sum())
                    now = now / now.sum()
                out[text] = total
        return out

    def expected(self, into: Expected) -> None:
        """Adds the expected counts of the Baum-Welch step."""
        entry, leave = self.boundaries(self.products()[0]) if self.long.any() else (np.tile(self.model.initial, (len(self.text), 1)), np.ones((len(self.text), self.settings.states)))
        step = self.model.step
        for own, symbols, base in self.groups(np.arange(len(self.text))):
            emit, steps = self.model.emit[symbols], len(base) - 1
            ahead = np.empty_like(emit)
            ahead[: base[1]] = self._first(own, entry) * emit[: base[1]]
            for t in range(1, steps):
                n = base[t + 1] - base[t]
                now = ahead[base[t] : base[t + 1]]
                np.matmul(ahead[base[t - 1] : base[t - 1] + n], step, out=now)
                now *= emit[base[t] : base[t + 1]]
                if t % _STEPS == 0:
                    now /= now.sum(axis=1, keepdims=True)
            # emission times what follows, by state; a chunk's last symbol is followed by what is behind the chunk
            behind = np.empty_like(emit)
            following = leave[own]
            for t in range(steps - 1, -1, -1):
                n = base[t + 1] - base[t]
                now = behind[base[t] : base[t + 1]]
                m = base[t + 2] - base[t + 1] if t + 1 < steps else 0
                now[m:] = following[m:n]
                if m:
                    np.matmul(behind[base[t + 1] : base[t + 2]], step.T, out=now[:m])
                now *= emit[base[t] : base[t + 1]]
                if t % _STEPS == 0:
                    now /= now.sum(axis=1, keepdims=True)
            # the share of each state at each symbol: ahead has the emission, and so has behind
            share = ahead * behind
            share /= emit
            share /= share.sum(axis=1, keepdims=True)
            into.add(symbols, share)
            opens = self.opens[own]
            into.initial += share[: base[1]][opens].sum(axis=0)
            before = np.concatenate([np.repeat(base[t - 1], base[t + 1] - base[t]) + np.arange(base[t + 1] - base[t]) for t in range(1, steps)]) if steps > 1 else np.zeros(0, int)
            self._transitions(into, ahead[before], behind[base[1] :])
            self._transitions(into, entry[own][~opens], behind[: base[1]][~opens])

    def _transitions(self, into: Expected, ahead: np.ndarray, behind: np.ndarray) -> None:
        total = ((ahead @ self.model.step) * behind).sum(axis=1, keepdims=True)
        into.step += (ahead / total).T @ behind * self.model.step


class Expected:
    """Counts of first states, of steps and of symbols by state."""

    def __init__(self, symbols: int, states: int):
        self.initial, self.step, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))

    def add(self, symbols: np.ndarray, share: np.ndarray) -> None:
        for s in range(share.shape[1]):
            self.emit[s] += np.bincount(symbols, share[:, s], minlength=self.emit.shape[1])

    def rows(self, limit: int = 1 << 14) -> Iterator[pa.RecordBatch]:
        """Symbols from 0 on; -1 the first states, -2 and below the steps from each state."""
        seen = np.flatnonzero(self.emit.any(axis=0))
        keys = np.concatenate([[-1], -2 - np.arange(len(self.step)), seen])
        values = np.concatenate([self.initial[None], self.step, self.emit[:, seen].T])
        for at in range(0, len(keys), limit):
            own = values[at : at + limit]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + limit], pa.int32()), *(pa.array(own[:, s]) for s in range(own.shape[1]))], names=["symbol", *(f"s{s}" for s in range(own.shape[1]))])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        blob = batch.column(batch.schema.get_field_index("symbols")).cast(pa.large_binary())
        offsets = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1] // 2
        if batch.num_rows:
            yield batch, np.frombuffer(blob.buffers()[2], np.uint16)[offsets[0] : offsets[-1]], np.diff(offsets)


def _guessed(shared, settings: Settings):
    """A first model's counts: every text of one state, by which of random directions its symbols' sum leans to most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual: np.ndarray = shared.value  # how frequent symbols are
        out = Expected(len(usual), settings.states)
        directions = np.random.default_rng(settings.seed).standard_normal((len(usual), settings.states))
        centred = directions - usual @ directions
        for _, symbols, counts in _texts(batches):
            owner = np.repeat(np.arange(len(counts)), counts)
            lean = np.stack([np.bincount(owner, centred[symbols, s], minlength=len(counts)) for s in range(settings.states)], axis=1)
            state = lean.argmax(axis=1)
            out.initial += np.bincount(state, minlength=settings.states)
            for s in range(settings.states):
                out.emit[s] += np.bincount(symbols[state[owner] == s], minlength=len(usual))
        yield from out.rows()

    return run


def _round(shared, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        out = Expected(len(model.emit), settings.states)
        for _, symbols, counts in _texts(batches):
            Chunks(symbols, counts, model, settings).expected(out)
        yield from out.rows()

    return run


def _summed(counted: DataFrame, symbols: int, settings: Settings) -> Expected:
    names = [f"s{s}" for s in range(settings.states)]
    found = counted.groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # a row a symbol at most
    keys, values = found.column("symbol").to_numpy(), np.stack([found.column(n).to_numpy() for n in names], axis=1)
    out = Expected(symbols, settings.states)
    out.emit[:, keys[keys >= 0]] = values[keys >= 0].T
    for k, v in zip(keys[keys < 0].tolist(), values[keys < 0], strict=True):
        if k == -1:
            out.initial = v
        else:
            out.step[-2 - k] = v
    return out


def _maximised(counts: Expected, usual: np.ndarray) -> Model:
    """The model of expected counts; a state's symbols are mixed with the usual ones, as many as there are symbols."""
    states = len(counts.initial)
    emit = (counts.emit.T + len(usual) * usual[:, None]) / (counts.emit.sum(axis=1) + len(usual))
    step = (counts.step + 1.0 / states) / (counts.step.sum(axis=1, keepdims=True) + 1)
    return Model((counts.initial + 1) / (counts.initial.sum() + states), step, emit)


def train(encoded: DataFrame, known: Lexicon, settings: Settings) -> Model:
    """Baum-Welch over all rows of ``encoded``, from a first model in which a text is of one state."""
    context = encoded.sparkSession.sparkContext
    usual = (known.symbol_count + 1) / (known.symbol_count.sum() + len(known.symbol_count))
    kinds = ", ".join(["symbol int", *(f"s{s} double" for s in range(settings.states))])
    rows, size = encoded.select("symbols"), len(usual)
    shared = context.broadcast(usual)
    guess = _summed(T.mapped(rows, _guessed(shared, settings), kinds), size, settings)
    shared.destroy()
    guess.step = (np.eye(settings.states) * 9 + 1) * (1 + guess.emit.sum(axis=1, keepdims=True))
    model = _maximised(guess, usual)
    for _ in range(settings.rounds):
        shared = context.broadcast(model)
        model = _maximised(_summed(T.mapped(rows, _round(shared, settings), kinds), size, settings), usual)
        shared.destroy()
    return model


def _scored(shared, names: list[str], settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch, symbols, counts in _texts(batches):
            score = Chunks(symbols, counts, model, settings).likelihoods() / math.log(10)
            own = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(score)], names=[*names, "chain"])

    return run


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def score_texts(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", unseen: Column | None = None) -> DataFrame:
    """One row per row of docs: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from the rows that are not ``unseen`` (default: crc32 of the id modulo 7 is 2; null ids are
    learned from). Tokens are words between white space, A-Z lowered, and one end; a null or empty text has its end
    only. ``base_score`` is the unigram model's log10 probability, add-one over the training tokens; ``score`` the hidden
    Markov model's. Repeated rows count and are scored each; further columns are not read; an empty table gives no
    rows, and with nothing to learn from every symbol is as likely as any other.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"), (held_out(C(f"`{id_col}`")) if unseen is None else unseen).alias("out"))
    counts = word_counts(rows.filter("not out").select("t"))
    known, tokens, different, least = lexicon(counts, settings)
    shared = context.broadcast(known)
    kind = rows.schema["k"].dataType.simpleString()
    source = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "k", "out", "t")
    encoded = settle(T.mapped(source, _encoded(shared, ["rid", "k", "out"]), f"rid long, k {kind}, out boolean, n_tokens long, found long, base double, inner double, symbols binary, rare_h array<bigint>, rare_g array<bigint>, rare_n array<bigint>"))
    shared.destroy()
    model = train(encoded.filter("not out"), known, settings)

    rare = encoded.filter("size(rare_n) > 0").select("rid", F.explode(F.arrays_zip("rare_h", "rare_g", "rare_n")).alias("w"))
    rare = rare.select("rid", C("w.rare_h").alias("h"), C("w.rare_g").alias("g"), C("w.rare_n").alias("n"))
    seen = rare.join(counts.filter(C("h").isNotNull() & (C("c") < least)).select("h", "g", "c"), ["h", "g"])
    more = seen.groupBy("rid").agg(F.sum("n").alias("more"), F.sum(C("n") * F.log10(C("c") + 1.0)).alias("logs"))

    shared = context.broadcast(model)
    names = ["rid", "k", "out", "n_tokens", "found", "base", "inner"]
    chains = T.mapped(encoded.select(*names, "symbols"), _scored(shared, names, settings), f"rid long, k {kind}, out boolean, n_tokens long, found long, base double, inner double, chain double")
    ends = int(known.symbol_count[-1])
    lacking = lambda c: F.coalesce(c, F.lit(0))
    logs = lacking(C("logs"))
    base = C("base") + math.log10(ends + 1) + logs - C("n_tokens") * math.log10(tokens + different + 1)
    return chains.join(more, "rid", "left").select(
        C("k").alias("doc_id"),
        C("out").alias("held_out"),
        "n_tokens",
        (C("found") + lacking(C("more")) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (C("chain") + C("inner") + logs).alias("score"),
    )
