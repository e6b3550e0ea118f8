from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorespan.llm import text as T
from lorespan.llm.tokens import encoder, proven, vocabulary
from lorespan.llm.transducer import CHUNK, Counter, Merges, Table, character_classes, token_counts
from tests.llm.helpers import SCHEMA, awkward, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "'", "'s", "'re", "'ll", "'S", "1", "!", "é", "漢", "🙂", "\t", " ", "　", "<|endoftext|>", "ing", "aaaa", "...", "\r\n", "ſ", "Ᲊ"])


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH, character_classes())


def _counts(counter, texts):
    return counter(*T.buffers(pa.array(texts, pa.string()))).tolist()


def _expected(texts):
    return [len(e.ids) for e in TOKENIZER.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_ids_and_counts_equal_the_library(text):
    expected = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert encoder(PATH, True).ids(text).tolist() == expected
    assert _counts(_shared(), [text]) == [len(expected)]


_kept: list = []


def _shared():
    if not _kept:
        _kept.append(Counter(PATH, character_classes()))
    return _kept[0]


def test_every_character(counter):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40000):
        texts = [f"a{chr(c)}b 1{chr(c)} !{chr(c)}" for c in points[at : at + 40000 : 3]]
        exact = TOKENIZER.encode_batch(texts, add_special_tokens=False)
        assert _counts(counter, texts) == [len(e.ids) for e in exact]
        assert all(encoder(PATH, True).ids(t).tolist() == e.ids for t, e in zip(texts[::20], exact[::20], strict=True))


def test_which_files_may_use_the_faster_library():
    assert proven(PATH) and not proven(public_tokenizers.path("word_bpe_49k.json"))
    assert vocabulary(PATH) == 50257
    text = "word and more, ça " * 70_000
    assert np.array_equal(encoder(PATH, True).ids(text), encoder(PATH, False).ids(text))


def test_long_pre_tokens_go_through_chunk_maps(counter):
    rng = random.Random(3)
    texts = ["a" * 50_000, "abc" * 4000, " " * (CHUNK * 5), "".join(rng.choice("etaoin") for _ in range(20_000)), "é" * 3000, "-=" * 900, "ab" * 128, "x" * CHUNK, "x" * (CHUNK + 1)]
    assert _counts(counter, texts) == _expected(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=1, max_size=4), st.integers(1, 9))
def test_chunks_may_be_cut_anywhere(texts, chunk):
    texts = [t.replace("<|endoftext|>", "<|end|>") for t in texts]
    points = np.array([ord(c) for c in "".join(texts)], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert _shared().machine.counts(points, first, chunk).tolist() == _expected(texts)


def test_ordinary_documents_go_through_the_scan(counter):
    rng = random.Random(8)
    texts = [prose(rng, 400) for _ in range(20)]
    before = counter.machine.compositions
    assert _counts(counter, texts) == _expected(texts)
    assert counter.machine.compositions - before >= sum(len(t) // CHUNK for t in texts)


def test_forgetting_changes_nothing(counter, monkeypatch):
    import lorespan.llm.transducer as module

    monkeypatch.setattr(module, "MAX_MOVES", 10)
    monkeypatch.setattr(module, "MAX_PAIRS", 10)
    texts = ["some words and numbers 1234", "und noch mehr Wörter", "some words"]
    assert [n for t in texts for n in _counts(counter, [t])] == _expected(texts)


def test_table_grows_and_finds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 60, 5000))
    table = Table((np.int32,), bits=4)
    for part in np.array_split(keys, 7):
        table.put(part, (part % 1000).astype(np.int32))
    at = table.find(keys)
    assert (table.keys[at] == keys).all() and (table.values[0][at] == keys % 1000).all()
    assert (table.keys[table.find(np.setdiff1d(keys + 1, keys))] == -1).all()


def test_pairs_of_tokens(counter):
    machine = Merges(PATH)
    ids = TOKENIZER.get_vocab()
    rng = random.Random(5)
    plain = [t for t in ids if t.isascii() and t.isalpha()]
    for _ in range(2000):
        x, y = rng.choice(plain), rng.choice(plain)
        stays = TOKENIZER.encode(x + y, add_special_tokens=False).ids == [ids[x], ids[y]]
        assert (machine._joins(ids[x], ids[y]) == 0) == stays


def test_query_rows(spark):
    rows = awkward()
    out = token_counts(frame(spark, rows, clash=True), PATH, limit=20).collect()
    expected = {r[0]: (len((r[1] or "").encode()), n) for r, n in zip(rows, _expected([r[1] for r in rows]), strict=True)}
    assert len(out) == len(rows) + 2
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_tokens"]) == expected[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 20)
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json"))
