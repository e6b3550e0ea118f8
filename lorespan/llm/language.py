"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams of its lower-cased letters (everything else is one space),
weighted 1 + log(count) times inverse document frequency, and of unit length. Each language has several
centroids, the clusters of its training vectors (spherical k-means); the nearest centroid by cosine names
the language. A text whose cosine is below what all but a few training texts of its language and length reach is
rejected.

The model is fitted on a bounded sample (``sample`` labelled texts of each of at most ``languages`` languages,
``texts`` in all) of sparse vectors, one language's at a time made dense; it is ``dims`` x (languages x clusters)
floats, broadcast. Prediction walks whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm import text as T

UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ROWS = 64


@dataclass(frozen=True)
class Settings:
    bits: int = 13
    clusters: int = 4
    sample: int = 500
    languages: int = 256
    texts: int = 16_384
    #: The floor is ``rejection`` times the ``low`` quantile of training cosines; of 20 or more one may be odd anyway.
    low: float = 0.005
    rejection: float = 0.8
    rounds: int = 20
    seed: int = 11

    @property
    def dims(self) -> int:
        return 1 << self.bits


class NothingToLearn(ValueError):
    """No row has both a label and a text."""


@dataclass
class Model:
    settings: Settings
    labels: list[str]
    idf: np.ndarray
    #: dims x (labels x clusters), unit columns; empty clusters are zero.
    centroids: np.ndarray
    #: labels x 41: least cosine accepted, by the bit length of the number of trigrams.
    floor: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label index, cosine, rejected) of rows of trigram counts; without labels all are ``und`` and rejected."""
        if not self.labels:
            return np.zeros(len(counts), np.int64), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosines = unit(weigh(counts, self.idf)) @ self.centroids
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return best // self.settings.clusters, score, score < self.floor[best // self.settings.clusters, length_class(counts)]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros(counts.shape, np.float32)
    seen = counts > 0
    out[seen] = 1 + np.log(counts[seen])
    return out * idf


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.sum(axis=1))[1].clip(0, 40)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """texts x dims counts of hashed trigrams; a trigram lies in one text and is not all spaces."""
    n = len(offsets) - 1
    folded = _FOLD[raw].astype(np.uint32)
    if len(folded) < 3:
        return np.zeros((n, 1 << bits), np.float32)
    code = folded[:-2] | folded[1:-1] << np.uint32(8) | folded[2:] << np.uint32(16)
    ok = code != 0x202020
    for edge in offsets[1:-1].tolist():
        ok[max(0, edge - 2) : edge] = False
    lengths = np.maximum(0, np.diff(np.minimum(offsets, len(code))))
    slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    flat = slot + (np.repeat(np.arange(n, dtype=np.int64), lengths) << bits)
    return np.bincount(flat[ok], minlength=n << bits).reshape(n, 1 << bits).astype(np.float32)


def _vectors(bits: int):
    """Of the sampled training rows: label, and the counts as (index, count) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in T.slices(batches, "t"):
            for a in range(0, part.num_rows, _ROWS):
                b = min(a + _ROWS, part.num_rows)
                counts = trigram_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                rows = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(a, b - a), pa.array(rows, pa.list_(pa.int32())), pa.array([c[i] for c, i in zip(counts, rows, strict=True)], pa.list_(pa.float32()))],
                    names=["label", "slots", "counts"],
                )

    return run


def _clusters(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; k unit centroids, zero where there are fewer different vectors."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        moved = unit(np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
        if np.allclose(moved, centres):
            break
        centres = moved
    return np.vstack([centres, np.zeros((k - len(centres), x.shape[1]), np.float32)])


def fit(labelled: DataFrame, settings: Settings = Settings(), label_col: str = "lang", text_col: str = "text", key_col: str = "doc_id") -> Model:
    """Learns from rows with text and label; which rows of a label are sampled depends on a hash of the key only.

    Labels are counted over all rows; each row of a label is kept with probability sample / count, the sample being
    smaller where there are many labels. Of more labels than ``settings.languages`` the most frequent are learned, of equally
    frequent ones the first in order. Raises ValueError if no row has both.
    """
    rows = labelled.select(F.col(f"`{label_col}`").alias("label"), F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{key_col}`").alias("k"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("t").isNotNull())
    often = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(settings.languages)
    sizes = {r["label"]: r["count"] for r in often.collect()}
    if not sizes:
        raise NothingToLearn("no row has a label and a text")
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, min(settings.sample, settings.texts // len(sizes)) / n)))])
    part = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("k").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.filter(part < F.try_element_at(share, F.col("label"))).select("label", "t")
    found = T.mapped(chosen, _vectors(settings.bits), "label string, slots array<int>, counts array<float>").toArrow()
    sparse: dict[str, list[tuple[bytes, bytes]]] = {}
    for label, slots, values in zip(found.column("label").to_pylist(), found.column("slots"), found.column("counts"), strict=True):
        sparse.setdefault(label, []).append((slots.values.to_numpy().tobytes(), values.values.to_numpy().tobytes()))
    labels = sorted(sparse)
    for own in sparse.values():
        own.sort()  # whatever order the rows came in

    def dense(rows: list[tuple[bytes, bytes]]) -> np.ndarray:
        out = np.zeros((len(rows), settings.dims), np.float32)
        for i, (slots, values) in enumerate(rows):
            out[i, np.frombuffer(slots, np.int32)] = np.frombuffer(values, np.float32)
        return out

    holders = sum(np.bincount(np.frombuffer(slots, np.int32), minlength=settings.dims) for own in sparse.values() for slots, _ in own)
    idf = (np.log((1 + found.num_rows) / (1 + holders)) + 1).astype(np.float32)
    rng = np.random.default_rng(settings.seed)
    centroids = np.vstack([_clusters(unit(weigh(dense(sparse[x]), idf)), settings.clusters, settings.rounds, rng) for x in labels]).T.astype(np.float32)
    model = Model(settings, labels, idf, np.ascontiguousarray(centroids), np.zeros((len(labels), 41)))
    # what texts named so reach at each length, short ones from parts of long ones
    reached: dict[tuple[int, int], list[float]] = {}
    for own in (sparse[x] for x in labels):
        for at in range(0, len(own), 128):
            part = dense(own[at : at + 128]).astype(np.int64)
            for share in (1.0, 0.3, 0.1, 0.03, 0.01, 0.003):
                drawn = rng.binomial(part, share).astype(np.float32)
                which, score, _ = model.predict(drawn)
                for key, cosine in zip(zip(which.tolist(), length_class(drawn).tolist(), strict=True), score.tolist(), strict=True):
                    reached.setdefault(key, []).append(cosine)
    for (label, size), cosines in reached.items():
        model.floor[label, size] = settings.rejection * np.sort(cosines)[max(int(len(cosines) >= 20), int(settings.low * len(cosines)))]
    for size in range(1, 41):  # lengths that no training text has go by the next shorter ones
        model.floor[:, size] = np.where(model.floor[:, size] > 0, model.floor[:, size], model.floor[:, size - 1])
    return model


def fit_if_labelled(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of ``fit``, or where nothing can be learned one that rejects every text as ``und``."""
    try:
        return fit(labelled, settings)
    except NothingToLearn:
        return Model(settings, [], np.ones(settings.dims, np.float32), np.zeros((settings.dims, 0), np.float32), np.zeros((0, 41)))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def _predict(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        labels = pa.array([*model.labels, UNKNOWN])
        for part, raw, offsets in T.slices(batches, "t"):
            lettered = part.column(part.schema.get_field_index("lettered")).to_numpy(zero_copy_only=False).astype(bool)
            for a in range(0, part.num_rows, _ROWS):
                b = min(a + _ROWS, part.num_rows)
                which, score, rejected = model.predict(trigram_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.settings.bits))
                which = np.where(lettered[a:b], which, len(model.labels))
                score = np.where(lettered[a:b], score, 0.0)
                own = [part.column(part.schema.get_field_index(n)).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*own, labels.take(pa.array(which)), pa.array(score.astype(float)), pa.array(rejected | ~lettered[a:b])], names=[*names, "lang_pred", "score", "rejected"])

    return run


def _identified(docs: DataFrame, model: Model, inner: dict[str, str], text_col: str) -> DataFrame:
    """The columns ``inner`` (by their names there), lang_pred, score, rejected."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items() if i != "t"), text.alias("t"), has_letter(text).alias("lettered"))
    kinds = ", ".join(f"{i} {rows.schema[i].dataType.simpleString()}" for i in inner.values())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return T.mapped(rows, _predict(shared, list(inner.values())), f"{kinds}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with ``lang_pred``, ``score`` (cosine) and ``rejected``.

    Null and letterless texts are ``und`` with score 0 and rejected. Of equal cosines the first label in
    sorted order wins. Repeated rows stay, and an empty table gives no rows. The three new names must not be
    in ``keep``, which must name a column and may name the text's.
    """
    inner = {c: "t" if c == text_col else f"k{i}" for i, c in enumerate(keep)}
    out = _identified(docs, model, inner, text_col)
    return out.select(*(F.col(i).alias(c) for c, i in inner.items()), "lang_pred", "score", "rejected")


def in_known_languages(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, all columns, whatever their names. Cases as in ``identify``."""
    inner = {c: "t" if c == text_col else f"k{i}" for i, c in enumerate(docs.columns)}
    return _identified(docs, model, inner, text_col).filter("not rejected").select(*(F.col(i).alias(c) for c, i in inner.items()))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
