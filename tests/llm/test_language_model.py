from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lorespan.llm import hmm
from tests.llm.helpers import BLANK, LOWER, SCHEMA, awkward, frame


def _tokens(text):
    return BLANK.findall((text or "").translate(LOWER))


def _out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def test_counts_and_base_scores_equal_brute_force(spark):
    docs = frame(spark, clash=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    train = [t for k, t in rows if not _out(k)]
    counts = Counter(w for t in train for w in _tokens(t))
    total, different = sum(counts.values()) + len(train), len(counts) + 1
    expected = []
    for k, t in rows:
        own = [counts[w] for w in _tokens(t)] + [len(train)]
        base = sum(math.log10((c + 1) / (total + different + 1)) for c in own)
        expected.append((k, _out(k), len(own), sum(c > 0 for c in own), total, round(base, 6)))
    for small in (hmm.Settings(), hmm.Settings(symbols=40, counted=90, states=3, rounds=1)):
        out = hmm.score_texts(docs, small).collect()
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=repr) == sorted(expected, key=repr)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def _model(rng, symbols, states):
    emit = rng.random((symbols, states)) + 0.01
    return hmm.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(states), rng.random((states, states)))), emit / emit.sum(axis=0))


def _plain(model, symbols):
    """Forward and backward weights of one text, step by step; posterior counts."""
    ahead, behind = [model.initial * model.emit[symbols[0]]], [np.ones(len(model.initial))]
    for s in symbols[1:]:
        ahead.append((ahead[-1] @ model.step) * model.emit[s])
    for s in symbols[:0:-1]:
        behind.insert(0, model.step @ (model.emit[s] * behind[0]))
    total = ahead[-1].sum()
    share = [a * b / total for a, b in zip(ahead, behind, strict=True)]
    step = sum((np.outer(ahead[t], model.emit[symbols[t + 1]] * behind[t + 1]) * model.step / total for t in range(len(symbols) - 1)), np.zeros_like(model.step))
    return math.log(total), share, step


@pytest.mark.parametrize(("chunk", "group"), [(4096, 1 << 18), (5, 40), (1, 3), (7, 7)])
def test_recursions_equal_plain_ones(chunk, group):
    rng = np.random.default_rng(5)
    model = _model(rng, 12, 4)
    texts = [rng.integers(0, 12, n) for n in (1, 2, 5, 6, 7, 30, 90, 1, 14)]
    settings = hmm.Settings(states=4, chunk=chunk, group=group)
    chunks = hmm.Chunks(np.concatenate(texts).astype(np.uint16), np.array([len(t) for t in texts]), model, settings)
    found, into = chunks.likelihoods(), hmm.Expected(12, 4)
    chunks.expected(into)
    initial, step, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((4, 12))
    for i, symbols in enumerate(texts):
        score, share, own = _plain(model, symbols)
        assert found[i] == pytest.approx(score, rel=1e-10)
        initial, step = initial + share[0], step + own
        for s, x in zip(symbols, share, strict=True):
            emit[:, s] += x
    assert np.allclose(into.initial, initial) and np.allclose(into.step, step) and np.allclose(into.emit, emit)


def test_long_texts_do_not_underflow():
    rng = np.random.default_rng(6)
    model, symbols = _model(rng, 300, 3), rng.integers(0, 300, 50_000).astype(np.uint16)
    whole, cut = (hmm.Chunks(symbols, np.array([len(symbols)]), model, hmm.Settings(states=3, chunk=c)).likelihoods()[0] for c in (1 << 20, 1000))
    now, plain = model.initial, 0.0
    for i, s in enumerate(symbols):
        now = (now @ model.step if i else now) * model.emit[s]
        plain, now = plain + math.log(now.sum()), now / now.sum()
    assert whole == pytest.approx(plain, rel=1e-10) and cut == pytest.approx(plain, rel=1e-10)


def test_rounds_raise_the_likelihood_of_the_training_texts(spark):
    """Baum-Welch over partitions: no round lowers it (but for the mixing with usual symbols), and states tell two vocabularies apart."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(60)}" for _ in range(80))) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    totals = []
    for rounds in (0, 1, 3):
        rows = hmm.score_texts(table, hmm.Settings(states=4, rounds=rounds)).collect()
        totals.append(sum(r["score"] for r in rows if not r["held_out"]))
    unseen = [(r["score"], r["base_score"]) for r in rows if r["held_out"]]
    assert totals == sorted(totals)
    assert sum(s for s, _ in unseen) > 0.9 * sum(b for _, b in unseen) and len(unseen) > 20


def test_probabilities_of_all_words_add_up_to_one(spark):
    """Over every next word, known ones and one of each class that is unseen, from any state."""
    table = frame(spark)
    texts = table.selectExpr("text AS t")
    counts = hmm.word_counts(texts)
    known, _, different, least = hmm.lexicon(counts, hmm.Settings(symbols=30, counted=80))
    words = counts.filter("h is not null").collect()
    assert len(words) == different - 1 and least > 1 and known.words <= 30
    share = np.zeros(hmm.CLASSES)
    rare = [r for r in words if r["c"] not in set(known.symbol_count[: known.words].tolist()) or r["c"] < known.symbol_count[: known.words].min()]
    for r in rare:
        share[r["kind"]] += (r["c"] + 1) / 10 ** known.class_total[r["kind"]]
    share += 1 / 10**known.class_total
    assert np.allclose(share, 1)


def test_empty_and_unlearnable_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hmm.score_texts(none).count() == 0
    out_of_training = [(i, "one two", "en", "s", 7) for i in range(100) if _out(i)]
    rows = hmm.score_texts(spark.createDataFrame(out_of_training, SCHEMA)).collect()
    assert rows and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0.0 and r["score"] < 0 for r in rows)


def test_awkward_texts_have_an_end(spark):
    rows = [r for r in awkward() if not _tokens(r[1])]
    out = hmm.score_texts(frame(spark)).collect()
    ends = [r for r in out if r["n_tokens"] == 1]
    assert len(ends) >= len(rows) > 2 and len({round(r["score"], 9) for r in ends}) == 1
