from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespan.llm import text as T
from lorespan.llm.components import connected_components
from lorespan.llm.parity_join import SKETCH_WORDS, Similarity, block_keys, one_of_each_group, shingle_sets, similar_groups, sketches
from lorespan.llm.store import split_by_ids
from lorespan.llm.substrings import COVER, PERIOD, check_cover, cut_text, removal_digest, remove_repeats
from tests.llm.helpers import BLANK, SCHEMA, awkward, components, frame, gone_words, prose, shingles


@pytest.mark.parametrize("like", [Similarity(3, 9, 10), Similarity(), Similarity(1, 1, 2, growth=2.0)])
def test_groups_equal_brute_force(spark, like):
    rows = awkward()
    out = similar_groups(frame(spark, rows, clash=True), like).collect()
    sets = {r[0]: shingles(r[1], like.shingle) for r in rows}
    group = components(sets, like.num, like.den)
    assert len(out) == len(rows) + 2
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), group[r["doc_id"]])


@pytest.mark.parametrize(("common", "few"), [(0, 2), (25, 2), (60, 16)])
def test_boilerplate_with_own_words_equals_brute_force(spark, monkeypatch, common, few):
    import lorespan.llm.parity_join as module

    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(common)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = base + [f"s{rng.randrange(4)}_{j}" for j in range(common // 4)]
        for _ in range(rng.randrange(0, 7)):
            words.insert(rng.choice([len(words), rng.randrange(len(words))]), f"o{rng.randrange(120)}")
        rows.append((i, " ".join(words)))
    rows += [(3, rows[40][1]), (3, rows[41][1])]  # an id with several texts
    for like in (Similarity(3, 9, 10), Similarity()):
        sets = [shingles(t, like.shingle) for _, t in rows]
        group = components(dict(enumerate(sets)), like.num, like.den)
        same = {x: {group[i] for i, (k, _) in enumerate(rows) if k == x} for x, _ in rows}
        root = {g: g for g in group.values()}
        for own in same.values():  # texts of one id lie in one component
            least = min(root[g] for g in own)
            root = {g: least if r in {root[x] for x in own} else r for g, r in root.items()}
        least = {}
        for i, (k, _) in enumerate(rows):
            least[root[group[i]]] = min(k, least.get(root[group[i]], k))
        out = {r["doc_id"]: r["component_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()}
        assert out == {k: least[root[group[i]]] for i, (k, _) in enumerate(rows)}


def test_unlike_documents_of_one_boilerplate_make_no_pairs(spark, monkeypatch):
    import lorespan.llm.parity_join as module

    compared = []
    monkeypatch.setattr(module, "_verified", lambda pairs, sets, like, real=module._verified: compared.append(pairs.count()) or real(pairs, sets, like))
    base = " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(i, base + "".join(f" o{i}_{j}" for j in range(6))) for i in range(3000)], "doc_id long, text string")
    assert similar_groups(docs, Similarity(3, 9, 10)).filter("component_id <> doc_id").count() == 0
    assert sum(compared) < 2 * 3000


def test_members_of_many_keys_are_dealt_once_a_shingle(spark):
    """pipeline of round 3: what a member is dealt again by does not grow with the keys that it was open under."""
    from pyspark.sql import functions as F

    from lorespan.llm.parity_join import _dealt_again

    sets = spark.createDataFrame([(k, [*range(20), 100 + k]) for k in range(6)], "k long, tokens array<long>")
    members = sets.select("k", F.xxhash64("tokens").alias("s"), F.col("k").alias("c"))
    one, many = (members.withColumn("key", F.explode(F.array(*map(F.lit, range(n))))) for n in (1, 7))
    found = [sorted((r["token"], r["k"], r["place"]) for r in _dealt_again(m, sets, Similarity()).collect()) for m in (one, many)]
    assert found[0] == found[1] and {k for _, k, _ in found[0]} == set(range(6))


def test_one_of_each_group_keeps_columns(spark):
    rows = awkward()
    docs = frame(spark, rows, clash=True)
    out = one_of_each_group(docs)
    group = components({r[0]: shingles(r[1], 5) for r in rows}, 8, 10)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(set(ids) - {None}) == sorted(k for k, g in group.items() if k == g) and None in ids


def test_columns_of_any_name_keep_their_values(spark):
    rows = [r for r in awkward() if r[0] is not None]
    names = ("word_", "bit_", "bits_", "doc_id_word", "a name", "a name_word", "b.c", "Word_2")
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"doc_id * {i + 2} AS `{c}`" for i, c in enumerate(names))).withColumnRenamed("doc_id", "the id")
    out = one_of_each_group(docs, id_col="the id")
    found = out.collect()
    group = components({r[0]: shingles(r[1], 5) for r in rows}, 8, 10)
    assert out.columns == docs.columns and sorted(r["the id"] for r in found) == sorted(k for k, g in group.items() if k == g)
    assert all(r[c] == r["the id"] * (i + 2) for r in found for i, c in enumerate(names))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert similar_groups(none).count() == 0 and one_of_each_group(none).count() == 0
    assert removal_digest(none).count() == 0 and remove_repeats(none).count() == 0


def test_rows_that_share_an_id(spark):
    a, b = prose(random.Random(1), 120), prose(random.Random(2), 120)
    docs = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (11, "x")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in similar_groups(docs).collect()} == {(5, 5), (7, 5), (9, 5), (11, 11)}
    out = sorted((r["doc_id"], r["n_words_removed"]) for r in remove_repeats(docs).collect())
    assert out == [(5, 0), (5, 0), (7, 120), (9, 120), (11, 0)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([(9, 10), (8, 10), (1, 2)]))
def test_linked_sets_share_a_key_and_near_sketches(common, only_a, only_b, seed, level):
    like = Similarity(3, *level, growth=2.0)
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, common + only_a + only_b, dtype=np.uint64))
    rng.shuffle(pool)
    shared, a, b = np.split(pool, [common, common + only_a])
    a, b = np.concatenate([shared, a]), np.concatenate([shared, b])
    if like.den * len(shared) < like.num * len(pool):
        return
    counts = np.array([len(a), len(b)])
    for every in (False, True):
        keys = block_keys(np.concatenate([a, b]), counts, like, every)
        assert np.intersect1d(keys.key[keys.text == 0], keys.key[keys.text == 1]).size
    x, y = sketches(np.concatenate([a, b]), counts)
    assert x.shape == (SKETCH_WORDS,) and sum(int(v).bit_count() for v in x ^ y) <= len(pool) - len(shared)


def test_shingles_of_short_texts():
    texts = ["", None, "A b", "a  B", "a", "a b c", "a b c a b c"]
    raw, offsets = T.buffers(pa.array(texts, pa.string()))
    _, counts = shingle_sets(raw, offsets, 3)
    assert counts.tolist() == [len(shingles(t, 3)) for t in texts]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    root = {k: k for p in pairs for k in p}
    for _ in range(40):
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    out = connected_components(spark.createDataFrame(pairs, "x long, y long"))
    assert {(r["node"], r["component"]) for r in out.collect()} == {(k, c) for k, c in root.items() if k != c}


def test_long_chain_of_links(spark):
    out = connected_components(spark.range(200).selectExpr("id x", "id + 1 y")).collect()
    assert len(out) == 200 and {r["component"] for r in out} == {0}


def test_split_by_ids_misses_nothing(spark):
    rows = spark.range(500).selectExpr("id k", "id * 2 word_")
    likely, others = split_by_ids(rows, "k", rows.filter("k % 7 = 0").select("k"), bits=8)
    assert {r["k"] for r in likely.collect()} >= set(range(0, 500, 7)) and likely.columns == rows.columns
    assert likely.count() + others.count() == 500


def test_cover():
    check_cover(PERIOD, COVER)
    with pytest.raises(ValueError):
        check_cover(31, (1, 2, 3))


def test_removal_equals_brute_force(spark):
    rows = awkward()
    docs = frame(spark, rows, clash=True)
    expected = gone_words([(r[0], r[1]) for r in rows])
    for r in removal_digest(docs).collect():
        w, gone = expected.get(r["doc_id"], ("a null id has text".split(), [False] * 5))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    cut = remove_repeats(docs)
    assert cut.columns == [*docs.columns, "n_words_before", "n_words_removed"]
    texts = {r[0]: r[1] for r in rows}
    for r in cut.collect():
        if r["doc_id"] is not None:
            w, gone = expected[r["doc_id"]]
            assert BLANK.findall(r["text"] or "") == [x for x, g in zip(w, gone, strict=True) if not g]
            assert any(gone) or r["text"] == texts[r["doc_id"]]


@pytest.mark.parametrize("shift", range(0, 31, 3))
def test_every_shift_of_a_passage_is_found(spark, shift):
    rng = random.Random(shift)
    passage = prose(rng, 50)
    docs = spark.createDataFrame([(1, prose(rng, 40) + " " + passage + " " + prose(rng, 10)), (2, prose(rng, shift) + " " + passage + " end")], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_words_removed"] for r in remove_repeats(docs).collect()}
    assert removed[1] == 0 and removed[2] >= 50


def test_cut_text_keeps_other_space():
    text = "  a b\n\nc  d e ".encode()
    starts = np.array([2, 4, 7, 10, 12])
    assert cut_text(text, starts, np.array([0, 1, 0, 0, 1], bool)) == b"  a c  d "
    assert cut_text(text, starts, np.array([1, 0, 0, 1, 0], bool)) == b"b\n\nc  e "
    assert cut_text(text, starts, np.ones(5, bool)) == b""
