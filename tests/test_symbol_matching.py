"""Matching of large groups in bands against the walk over all pairs."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespan.operators import graph as g

COLUMNS = "file string, {0}_id int, {0}_name string, {0}_signature string, {0}_checksum string, {0}_neighbours array<string>, {0}_file_path string"
SAME = "old_file_path = new_file_path"


def table(spark, rows, side):
    return spark.createDataFrame(rows, COLUMNS.format(side))


def scored(spark, old, new):
    pairs = table(spark, old, "old").join(table(spark, new, "new"), "file")
    return g.symbol_similarity(pairs.withColumn("same_file", F.expr(SAME).cast("double"))).filter("score > 0.6")


def symbol(rng, n):
    name = rng.choice(["load", "store", "read_all", "x", "parse_line"]) + rng.choice(["", "_two", "s", "Now"])
    given = ", ".join(rng.sample(["a: int", "b", "self", "path: str", "n"], rng.randint(0, 3)))
    back = rng.choice(["", " -> int", " -> str"])
    near = rng.sample(["log", "open", "close", "h1", "h2", "h3"], rng.randint(0, 3))
    return rng.choice(["f", "f", "g", None]), n, name, f"def {name}({given}){back}", rng.choice(["c1", "c2", f"own{n}", None]), near, rng.choice(["here", "there"])


def test_bands_equal_the_walk_over_all_pairs(spark):
    rng = random.Random(5)
    old, new = ([symbol(rng, n) for n in range(70)] for _ in range(2))
    old.append(("f", 900, "same", "def same(a: int)", "o", [], "here"))
    new.append(("f", 901, "same", "def same(a: str)", "n", [], "here"))  # over 0.6 by name and signature alone
    want = {tuple(r) for r in g.greedy_matching(scored(spark, old, new), ["file"]).collect()}
    sides = table(spark, old, "old"), table(spark, new, "new")
    got = g.matched_symbols(*sides, ["file"], F.expr(SAME), plain=0)
    assert len(want) > 20 and ("f", 900, 901) in {w[:3] for w in want}
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in g.matched_symbols(*sides, ["file"], F.expr(SAME)).collect()} == want


def test_candidates_hold_every_pair_over_a_floor(spark):
    rng = random.Random(6)
    old, new = ([symbol(rng, n) for n in range(60)] for _ in range(2))
    all_pairs = scored(spark, old, new).cache()
    for floor in (0.9, 0.7, 0.6):
        want = {(r["old_id"], r["new_id"]) for r in all_pairs.filter(F.col("score") > floor).collect()}
        found = {(r["old_id"], r["new_id"]) for r in g.similar_candidates(table(spark, old, "old"), table(spark, new, "new"), ["file"], floor).collect()}
        assert want <= found
    all_pairs.unpersist()


def test_many_renamed_symbols_of_a_file_make_few_pairs(spark):
    size = 20_000
    rows = lambda side, word, body: [("f", n, f"{word}_{n}", f"def {word}_{n}(item_{n}: int, at)", f"{body}{n}", ["log", f"helper_{n}"], "here") for n in range(size)]
    old, new = rows("old", "fetch_row", "a"), rows("new", "fetch_rows", "b")
    sides = table(spark, old, "old"), table(spark, new, "new")
    assert g.similar_candidates(*sides, ["file"], 0.7).count() <= 2 * size
    got = g.matched_symbols(*sides, ["file"], F.expr(SAME))
    assert got.count() == size and got.filter("old_id <> new_id").isEmpty()


def test_nothing_to_match(spark):
    none = table(spark, [], "old"), table(spark, [], "new")
    assert g.matched_symbols(*none, ["file"], F.expr(SAME)).columns == ["file", "old_id", "new_id", "score"]
    assert g.matched_symbols(*none, ["file"], F.expr(SAME)).isEmpty()


def test_all_pairs_are_scored_from_distinct_texts(spark):
    """F1: the same scores as pair by pair, nulls too; 300 symbols of one name and shape make one comparison of each."""
    rng = random.Random(8)
    old, new = ([symbol(rng, n) for n in range(80)] for _ in range(2))
    old += [("f", 500 + n, None if n == 0 else "only", "def only(a)", "o", [f"s{n}"] * 2, "here") for n in range(300)]
    sides = table(spark, old, "old"), table(spark, new, "new")
    pairs = sides[0].join(sides[1], "file").withColumn("same_file", F.expr(SAME).cast("double"))
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.select("file", "old_id", "new_id", F.round("score", 9)).collect())))
    assert rows(g.group_similarity(*sides, ["file"], F.expr(SAME).cast("double"))) == rows(g.symbol_similarity(pairs))
    named = {"old": sides[0].filter("old_id >= 500"), "new": sides[1].filter("new_name = 'x'")}
    assert g._alike(named, ["file"], "name", "name", g.jaro_winkler).count() == 2


def test_all_pairs_of_large_groups_are_made_in_slices(spark, monkeypatch):
    """F1 (r04): pairs as arrays, by slices of both sides, equal those of the joins; nulls, doubled rows and shared nulls too."""
    rng = random.Random(9)
    old, new = ([symbol(rng, n) for n in range(90)] for _ in range(2))
    odd = [("f", 700, None, "def x(a)", "c1", ["log"], "here"), ("f", 701, "x", None, "c1", [None, "log"], "there"), ("f", 702, "x", "plain", None, None, None), ("f", 703, "x", "", "c2", [None, "zz"], "here"), ("h", 704, "x", "x", "c2", [], "here")]
    sides = table(spark, [*old, *odd, odd[0]], "old"), table(spark, [*new, *odd], "new")
    own = F.expr(SAME).cast("double")
    pairs = sides[0].join(sides[1], "file").withColumn("same_file", own)
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.select("file", "old_id", "new_id", F.round("score", 9)).collect())))
    want = rows(g.symbol_similarity(pairs))
    monkeypatch.setattr(g, "_SLICE", 16)
    for joined in (0, 400, 1 << 20):  # none, the small groups, all
        monkeypatch.setattr(g, "_JOINED", joined)
        assert rows(g.group_similarity(*sides, ["file"], own)) == want


def test_large_groups_deal_symbols_and_no_pairs(spark):
    """F1 (r04): 600 x 600 symbols of a group were 360,000 joined rows, each with two lists of neighbours."""
    rows = lambda side: [("f", n, f"{side}{n % 7}", f"def x(a, b{n % 3})", "o", [f"s{n}"], "here") for n in range(600)]
    got = g.group_similarity(table(spark, rows("old"), "old"), table(spark, rows("new"), "new"), ["file"], F.expr(SAME).cast("double"), digits=6, named=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan and got.columns == ["old_id", "new_id", "score"]
    assert got.count() == 360_000 and got.distinct().count() == 360_000


def test_checksums_of_unlike_types_are_compared():
    one = lambda side, checksum: pa.table({f"{side}_{c}": pa.array([x]) for c, x in (("name", "x"), ("shape", '{"p":["a"]}'), ("checksum", checksum), ("file_path", ""), ("neighbours", ["n"]))})
    old = one("old", b"k").append_column("_homes", pa.array([None], pa.list_(pa.null())))
    assert [s.tolist() for _, s in g._scores(old, one("new", "k"), lambda x: x.round(6))] == [[[0.95]]]
    assert [s.tolist() for _, s in g._scores(old, one("new", "other"), lambda x: x.round(6))] == [[[0.7]]]


def test_scores_round_as_the_sql_does():
    """F1 (r04): 16 of 4,502,880 rows at six times sf0.1 were rounded otherwise."""
    duck = duckdb.connect()
    for x in (0.5156875, 0.9428124999999999, 0.5046875, 0.25, 1.0, 0.0, 1 / 3):
        assert g._half_up(np.array([x]), 6).tolist() == [duck.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0]]


def test_copies_of_a_symbol_are_walked_in_one_task(spark, monkeypatch):
    """2,100 copies that share no neighbours made 4.4 million pairs in the bands."""
    monkeypatch.setattr(g, "similar_candidates", lambda *_: pytest.fail("copies went to the bands"))
    rows = lambda side: [("f", n, "only", "def only(a)", "o", [f"{side}{n}"], "here") for n in range(2100)]
    got = g.matched_symbols(table(spark, rows("old"), "old"), table(spark, rows("new"), "new"), ["file"], F.expr(SAME), digits=9)
    assert got.count() == 2100 and got.filter("old_id <> new_id or score <> 0.85").isEmpty()


def test_scores_are_rounded_as_spark_rounds(spark):
    given = [0.15 / 256, 0.85 + 0.15 / 1024, 0.6000000005, 0.7000000015, 0.1234567885, 0.85, 1 / 3]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x double").select(F.round("x", 9)).collect()]
    assert g._rounded(np.array(given), 9).tolist() == want
