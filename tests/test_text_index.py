from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorespan.operators import retrieval as r


def _docs(rng, n, vocabulary=60):
    words = [f"w{i}" for i in range(vocabulary)]
    return [(f"d{i}", " ".join(rng.choices(words, [1 / (j + 1) for j in range(vocabulary)], k=rng.randrange(0, 40)))) for i in range(n)]


QUERIES = [(0, "w0 w9"), (1, "w30"), (2, "w1 w2 w3"), (3, "w3_w1 w0"), (4, "w5*"), (5, "nowhere"), (6, "w0")]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = _docs(random.Random(4), 400)
    return rows, r.text_index(spark.createDataFrame(rows, "id string, text string"), block_docs=16)


def _rows(hits):
    return sorted((x["qid"], x["rank"], x["id"], round(x["score"], 9)) for x in hits.collect())


@pytest.mark.parametrize("mode", ["and", "or"])
def test_skipping_blocks_loses_nothing(spark, corpus, mode):
    queries = spark.createDataFrame(QUERIES, "qid int, query string")
    expected = _rows(r.top_hits(r.bm25(corpus[1], queries, mode), 5))
    assert _rows(r.bm25_top(corpus[1], queries, 5, mode)) == expected


def test_blocks_below_the_bound_stay_closed(spark, monkeypatch):
    """400 documents hold a word once, five hold it twenty times: only the blocks of these are opened."""
    rows = [(f"d{i}", "common " * (20 if i % 80 == 0 else 1) + " ".join(f"u{i}_{j}" for j in range(20 if i % 80 == 0 else 39))) for i in range(400)]
    index = r.text_index(spark.createDataFrame(rows, "id string, text string"), block_docs=8)
    opened = []
    monkeypatch.setattr(r, "top_hits", lambda scores, k, real=r.top_hits: opened.append(scores.count()) or real(scores, k))
    out = r.bm25_top(index, spark.createDataFrame([(0, "common")], "qid int, query string"), 3).collect()
    assert {x["id"] for x in out} <= {f"d{80 * i}" for i in range(5)} and len(out) == 3
    assert max(opened) < 100  # of 400


def test_a_changed_document_is_posted_with_its_block_alone(spark, corpus):
    rows, index = corpus
    changed = [("d7", "w1 w30 w30 fresh"), ("new", "fresh w9")]
    renewal = index.renewed(spark.createDataFrame(changed, "id string, text string"), spark.createDataFrame([("d8",)], "id string"))
    now, touched, posted = renewal.index(), renewal.touched, renewal.rows
    whole = [x for x in rows if x[0] not in ("d7", "d8")] + changed
    again = r.text_index(spark.createDataFrame(whole, "id string, text string"), block_docs=16)
    queries = spark.createDataFrame([*QUERIES, (9, "fresh")], "qid int, query string")
    assert _rows(r.top_hits(r.bm25(now, queries, "or"), 9)) == _rows(r.top_hits(r.bm25(again, queries, "or"), 9))
    assert touched.count() <= 3 and posted.select("block").distinct().count() <= 3 and posted.count() < 0.3 * index.table.count()
    assert (now.number, now.mean) == (again.number, again.mean)


def test_an_empty_index(spark):
    index = r.text_index(spark.createDataFrame([], "id string, text string"))
    assert r.bm25_top(index, spark.createDataFrame(QUERIES, "qid int, query string"), 3).count() == 0


def test_texts_of_an_index_are_made_once(spark):
    """F16, F17: counting the documents made them a second time."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return True

    docs = spark.createDataFrame([(n, f"b a b {n}") for n in range(40)], "id int, text string").filter(F.udf(seen, "boolean")("text"))
    index = r.text_index(docs, block_docs=8)
    rows = index.table.filter("term = 'b'").select(F.inline("docs")).collect()
    assert made.value == 40 and index.blocks == 5 and len(rows) == 40 and {tuple(x["at"]) for x in rows} == {(0, 2)}
