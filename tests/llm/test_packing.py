from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorespan.llm.packed_output import CapacityTree, best_fit, packed_ids, write_packed
from lorespan.llm.queries import PACKING
from lorespan.llm.vector_packing import Limits, _by_dot_product, loss_of, pack_examples, place
from tests.llm.helpers import SCHEMA, awkward, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _ids(texts):
    return [[*e.ids, 0] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), min_size=1, max_size=40), st.integers(2, 9), st.integers(10, 64))
def test_place_keeps_every_token_and_limit(docs, segments, loss):
    limits = Limits(64, segments, loss)
    lengths, starts = np.array([n for n, _ in docs]), np.array([s for _, s in docs])
    seen = [np.zeros(n, int) for n in lengths]
    for sequence in place(lengths, starts, limits):
        assert 0 < sum(n for _, _, n in sequence) <= 64 and len(sequence) <= segments
        assert sum(loss_of(at, n, int(starts[d])) for d, at, n in sequence) <= loss
        for d, at, n in sequence:
            seen[d][at : at + n] += 1
    assert all((s == 1).all() for s in seen)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 63), st.integers(0, 63)), min_size=1, max_size=30), st.integers(1, 6), st.integers(5, 64))
def test_placement_equals_brute_force(docs, segments, loss):
    limits = Limits(64, segments, loss)
    starts = np.array([s for _, s in docs])
    pieces = sorted(((d, 0, n) for d, (n, s) in enumerate(docs) if n - min(n, s) <= loss), key=lambda p: (-p[2], p[0]))
    need = {p: (p[2] / 64, 1 / segments, max(0, p[2] - docs[p[0]][1]) / loss) for p in pieces}
    weight = [np.mean([n[k] for n in need.values()]) for k in range(3)] if pieces else []
    left, expected = [*pieces], []
    while left:
        own, free = [], (64, segments, loss)
        while fits := [p for p in left if p[2] <= free[0] and free[1] and max(0, p[2] - docs[p[0]][1]) <= free[2]]:
            score = [free[0] / 64 * (need[p][0] * weight[0]) + free[1] / segments * (need[p][1] * weight[1]) + free[2] / loss * (need[p][2] * weight[2]) for p in fits]
            best = fits[int(np.argmax(score))]
            own.append(best)
            left.remove(best)
            free = free[0] - best[2], free[1] - 1, free[2] - max(0, best[2] - docs[best[0]][1])
        expected.append(own)
    assert [s.pieces for s in _by_dot_product(pieces, starts, limits)] == expected


def test_all_three_limits_bind_in_the_query(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, rng.choice([3, 8, 20, 60, 150, 200, 300, 400, 1500]))) for i in range(250)], "doc_id long, text string").coalesce(1)
    out = pack_examples(docs, PATH, **PACKING).toPandas().groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "size"), loss=("loss_tokens", "sum"))
    limits = PACKING["limits"]
    assert out.tokens.max() == limits.tokens and out.segments.max() == limits.segments and out.loss.max() == limits.loss_tokens
    assert out.tokens[out.tokens == 1024].sum() > 0.6 * out.tokens.sum()


def test_text_ids_and_quoted_columns(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "`the id` string, `a text` string")
    assert sorted((r["doc_id"], r["length"]) for r in pack_examples(docs, PATH, id_col="the id", text_col="a text").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted(x for r in packed_ids(docs, PATH, id_col="the id", text_col="a text").collect() for x in r["doc_ids"]) == ["a", "b"]


def test_ids_are_as_wide_as_the_tokenizer_needs(spark, monkeypatch):
    import lorespan.llm.packed_output as module

    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    assert packed_ids(docs, PATH, context=8).first()["ids_dtype"] == "<u2"
    monkeypatch.setattr(module, "vocabulary", lambda path: 70_000)
    assert packed_ids(docs, PATH, context=8).first()["ids_dtype"] == "<u4"


def test_pieces_hold_all_ids_without_padding(spark):
    rows = awkward()
    out = pack_examples(frame(spark, rows, clash=True), PATH).toPandas()
    own = out[out.doc_id.notna()]
    expected = dict(zip([r[0] for r in rows], _ids([r[1] for r in rows]), strict=True))
    repeated = rows[5][0]
    for k, ids in expected.items():
        pieces = own[own.doc_id == k].sort_values("start")
        assert pieces.length.sum() == len(ids) * (2 if k == repeated else 1)
        for p in pieces.itertuples():
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        total = int(s.length.sum())
        assert total <= 1024 and total & (total - 1) == 0


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "the question", "an answer of some words"), (2, None, "alone")], "doc_id long, prompt string, text string")
    out = {r["doc_id"]: r["loss_tokens"] for r in pack_examples(docs, PATH, Limits(64, 4, 64), prompt_col="prompt").groupBy("doc_id").agg({"loss_tokens": "sum"}).withColumnRenamed("sum(loss_tokens)", "loss_tokens").collect()}
    assert out == {1: len(_ids(["an answer of some words"])[0]), 2: len(_ids(["alone"])[0])}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pack_examples(none, PATH).count() == 0 and packed_ids(none, PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60))
def test_best_fit_is_best_fit(lengths):
    rows = best_fit(lengths, 32)
    assert sorted((d, at + j) for r in rows for d, at, n in r for j in range(n)) == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    free: list[int] = []
    for n in sorted((n % 32 for n in lengths if n % 32), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(32 - n)
    assert len(rows) == len(free) + sum(n // 32 for n in lengths)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 32), max_size=30), st.integers(0, 32))
def test_capacity_tree(capacities, n):
    tree = CapacityTree(32)
    for i, c in enumerate(capacities):
        tree.add(c, i)
    assert tree.least(n) == min((c for c in capacities if c >= n), default=-1)


def test_matrix_round_trip(spark, tmp_path):
    rows = awkward()
    write_packed(packed_ids(frame(spark, rows, clash=True), PATH, context=256), str(tmp_path / "m"))
    out = spark.read.parquet(str(tmp_path / "m")).collect()
    back: dict = {}
    for r in out:
        ids, places = np.frombuffer(r["input_ids"], r["ids_dtype"]), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(places) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] and not ids[r["n_tokens"] :].any()
        for d, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert places[a:b].tolist() == [*range(b - a)]
            back.setdefault(d, []).append((start, ids[a:b].tolist()))
    for r, ids in zip(rows, _ids([r[1] for r in rows]), strict=True):
        pieces = sorted(back[r[0]])
        if r[0] != rows[5][0]:
            assert [x for _, p in pieces for x in p] == ids
    assert len({r["row_id"] for r in out}) == len(out)
