from __future__ import annotations

import random

import corpus_pipeline
import pytest
from lorespan.llm import queries
from lorespan.llm.language import fit, identify
from tests.llm.helpers import ALNUM, BLANK, SCHEMA, awkward, components, edited, frame, gone_words, prose, shingles
from tests.llm.test_scans import _hits

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, prose(rng, 20)) for i in range(3)]
    rows = [r for r in awkward(seed=9, n=48) if r[1] != "x" * 3000]
    rows += [(500 + i, f"{prose(rng, 30)} {items[i % 3][1]} {prose(rng, 10 if i < 4 else 900)}", "en", "s0", 1) for i in range(8)]
    rows += [(600 + i, edited(rng, rows[-1][1], 0.02), "en", "s0", 1) for i in range(3)]
    base = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(base / "benchmark.parquet"))
    spark.createDataFrame([(i // 4, i % 4, "user", f"Turn {i}.") for i in range(40)], "conv_id long, turn long, role string, text string").write.parquet(str(base / "conversations.parquet"))
    return rows, items, str(base)


def test_every_stage_against_brute_force(spark, corpus):
    rows, items, sf_dir = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns

    model = fit(docs)
    rejected = {r["doc_id"] for r in identify(docs, model, ["doc_id"]).filter("rejected").collect()}
    assert rejected >= {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    docs = STAGES["language ID"](spark, docs, sf_dir).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and set(texts) == {r[0] for r in rows} - rejected

    group = components({k: shingles(t, 5) for k, t in texts.items()}, 8, 10)
    docs = STAGES["near duplicates"](spark, docs, sf_dir).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {k for k, g in group.items() if k == g}

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    gone = gone_words(list(texts.items()))
    docs = STAGES["repeated passages"](spark, docs, sf_dir).cache()
    left = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns and set(left) == {k for k, (w, g) in gone.items() if not w or not all(g)}
    for k, r in left.items():
        w, g = gone[k]
        assert BLANK.findall(r["text"]) == [x for x, y in zip(w, g, strict=True) if not y]
        assert not any(g) or r["n_chars"] == len(r["text"])

    docs = STAGES["decontamination"](spark, docs, sf_dir).cache()
    clean = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns and set(clean) == {k for k, r in left.items() if not _hits(items, r["text"])[4]}
    cut = 0
    for k, r in clean.items():
        before = _hits(items, left[k]["text"])
        assert len(ALNUM.findall(r["text"])) == before[0] - before[1] and (before[1] or r == left[k])
        assert not before[1] or r["n_chars"] == len(r["text"])
        cut += before[1] > 0
    assert cut

    packed = STAGES["packing"](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "doc_tokens").groupBy("doc_id").agg({"doc_tokens": "max"}).collect())) == sorted({(r["doc_id"], r["doc_tokens"]) for r in packed})


def test_registered_queries_run(spark, corpus):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    n = len(corpus[0])
    for name, f in queries.QUERIES.items():
        out = f(spark, corpus[2])
        if name.split("_")[0] in ("op2", "op5", "op6", "op7", "op8", "op9", "op10", "op11"):
            assert out.count() == n
        else:
            assert out.columns


def test_other_columns_and_repeated_rows_pass_through(spark, tmp_path):
    rng = random.Random(3)
    shared = prose(rng, 70)
    rows = [(i, f"{prose(rng, 90)} {shared if i % 2 else ''}", "en") for i in range(1, 9)]
    names = ("n_words_removed", "n_words_before", "n_words", "spans", "row", "copy", "rejected", "c0_", "k0", "t", "word_", "bit_", "bits_", "two words", "a.dot")
    docs = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string").selectExpr("*", *(f"doc_id * 10 AS `{c}`" for c in names))
    spark.createDataFrame([(1, prose(rng, 15))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(r[c] == r["doc_id"] * 10 for r in found for c in names), name
        assert sorted(r["doc_id"] for r in found) == sorted([*range(1, 9), 3]), name


def test_null_ids_stay_out_of_comparisons(spark):
    docs = frame(spark, awkward(n=12))
    for name in ("near duplicates", "repeated passages"):
        assert STAGES[name](spark, docs, "").filter("doc_id is null").count() == 1


def test_nothing_to_learn_a_language_from(spark, tmp_path):
    rows = [(1, "some words here", None, "s0", 15), (2, None, "en", "s0", 0)]
    for name, data in (("none", []), ("unlabelled", rows)):
        base = str(tmp_path / name)
        docs = spark.createDataFrame(data, SCHEMA)
        docs.write.parquet(f"{base}/documents.parquet")
        out = queries.QUERIES["op2_nearest_centroid"](spark, base).collect()
        assert [(r["lang_pred"], r["score"], r["rejected"]) for r in out] == [("und", 0.0, True)] * len(data)
        assert STAGES["language ID"](spark, docs, base).count() == 0
