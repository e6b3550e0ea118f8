from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from lorespan.llm import lexical
from tests.llm.helpers import ALNUM, LOWER, SCHEMA, awkward, frame, prose


def _terms(text):
    return ALNUM.findall((text or "").translate(LOWER))


def _ranked(docs, items, k=20):
    """The contract's rules one after another: {item row: [(doc_id, score)]}."""
    counted = [(d, Counter(_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    many, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 100 - 25 + (25 * n * many) // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in _terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def _items(rng):
    texts = [prose(rng, n) for n in (1, 4, 12, 40)] + ["w1 W1, w1. w2é", "", "nothing here ZZZ", "the THE x" + "x" * 2999, "!! ??"]
    return [(i % 7, t) for i, t in enumerate(texts)] + [(50, None), (None, "w3 w4")]


@pytest.mark.parametrize("block_words", [1, 1 << 18])
def test_ranks_equal_brute_force(spark, block_words):
    rng = random.Random(6)
    docs = frame(spark, clash=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = _items(rng)
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS k", "7 AS i", "7 AS t")
    out = lexical.search(lexical.build_index(docs), table, block_words=block_words)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect()), key=repr) == _ranked(rows, items)


def test_ties_of_many_copies_go_by_id(spark):
    copies = [(1000 - i, "alpha beta gamma") for i in range(300)] + [(i, f"alpha u{i} v{i}") for i in range(40)]
    out = lexical.ranked_documents(spark.createDataFrame(copies, "doc_id long, text string").repartition(5), spark.createDataFrame([(1, "beta gamma")], "item_id long, text string"))
    rows = sorted(out.collect(), key=lambda r: r["rank"])
    assert [r["doc_id"] for r in rows] == list(range(701, 721)) and len({r["score"] for r in rows}) == 1


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked_documents(none, items).count() == 0
    assert lexical.ranked_documents(frame(spark), items.limit(0)).count() == 0
    assert lexical.ranked_documents(spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", "en", "s", 0)], SCHEMA), items).count() == 0


def test_bytes_bound_impacts():
    rng = np.random.default_rng(1)
    tf, n = rng.integers(1, 5000, 20000), rng.integers(1, 10**7, 20000)
    exact = lexical.impacts(tf, n, 1000, 550_000)
    level = -(-exact // lexical.UNIT)
    assert level.max() <= 255 and (level * lexical.UNIT >= exact).all()
    assert (((level - 1) * lexical.UNIT + 1 <= exact) | (level == 0)).all()


def test_only_documents_that_reach_the_bound_are_rescored(spark, monkeypatch):
    """Of a thousand documents that hold the term, few are looked at again."""
    rng = random.Random(2)
    docs = [(i, " ".join(["rare"] * (1 + i % 9)) + " " + prose(rng, 20 + i % 200)) for i in range(1000)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    seen = []
    real = lexical._Shard.scores
    monkeypatch.setattr(lexical._Shard, "scores", lambda self, queries, q, documents, size: seen.append(len(documents)) or real(self, queries, q, documents, size))
    queries = lexical._queries([0], ["rare"], 20)
    batches = lambda columns: iter(index.shards.select(*columns).toArrow().to_batches())
    queries.weights = np.array([lexical.weight(index.documents, 1000)])

    class Shared:
        value = queries

    bounds = [b.column("bound").to_numpy() for b in lexical._best_bounds(Shared)(batches(["terms", "starts", "places", "impacts"]))]
    queries.weights = np.array([1000])
    bounds = np.sort(np.concatenate([b.column("bound").to_numpy() for b in lexical._best_bounds(Shared)(batches(["terms", "starts", "places", "impacts"]))]))
    queries.least = bounds[-20:][:1]
    found = list(lexical._rescored(Shared, (index.documents, index.terms), index.shards.toArrow().schema.field("ids").type.value_type)(batches(index.shards.columns)))
    assert sum(b.num_rows for b in found) == 20 and 20 <= sum(seen) < 120


def test_awkward_rows_are_all_indexed(spark):
    index = lexical.build_index(frame(spark))
    rows = [t for _, t, *_ in awkward()] + [awkward()[5][1], "a null id has text"]
    assert (index.documents, index.terms) == (sum(bool(_terms(t)) for t in rows), sum(len(_terms(t)) for t in rows))
