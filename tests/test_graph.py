from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespan.functions import jaro_winkler, jaro_winkler_pairs
from lorespan.operators import graph as g

EDGES = "src string, dst string, weight double"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], EDGES)


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start string")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node string")


def found(rows):
    return {(r["node"], r["depth"]) for r in rows.collect()}


def test_bfs_cases(spark):
    chain = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"))
    assert found(g.bfs(chain, start(spark, "a"), 2)) == {("b", 1), ("c", 2)}
    star = edges(spark, *[("a", f"n{i:02d}") for i in range(20)])
    assert found(g.bfs(star, start(spark, "a"), 3, budget=5)) == {(f"n{i:02d}", 1) for i in range(5)}
    assert len(found(g.bfs(star, start(spark, "a"), 1, budget=0))) == 1
    hub = edges(spark, *[("hub", f"s{i}") for i in range(60)], ("s0", "deep"))
    assert found(g.bfs(hub, start(spark, "hub"), 3, degree_cap=50)) == set()
    both = edges(spark, ("caller", "target"), ("target", "callee"))
    assert found(g.bfs_both(both, start(spark, "target"), 1)) == {("caller", 1), ("callee", 1)}
    assert found(g.bfs(edges(spark, ("a", "unwrap"), ("unwrap", "x")), start(spark, "a"), 3, blocked=nodes(spark, "unwrap"))) == set()
    assert found(g.bfs(edges(spark), start(spark, "a"), 3)) == set()


@settings(max_examples=5, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
def test_bfs_is_shortest_reachability(spark, pairs):
    near = {0: 0}
    for depth in range(1, 4):
        for a, b in pairs:
            if near.get(a) == depth - 1 and b not in near:
                near[b] = depth
    out = g.bfs(edges(spark, *[(str(a), str(b)) for a, b in pairs]), start(spark, "0"), 3)
    assert found(out) == {(str(n), d) for n, d in near.items() if d}


def _recurrence(pairs, n, rounds, damping=0.85):
    """The quoted O(n**2) step, node by node."""
    degree = np.zeros(n)
    times = np.zeros((n, n))
    for a, b in pairs:
        degree[a] += 1
        times[a, b] += 1
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = np.zeros(n)
        for v in range(n):
            for w in range(n):
                if times[w, v]:
                    new[v] += damping * rank[w] * times[w, v] / degree[w]
                elif not degree[w]:
                    new[v] += damping * rank[w] / n
                else:
                    new[v] += (1 - damping) * rank[w] / n
        # a linked node gives no jump share, a dangling one gives the damped share only
        rank = new / new.sum()
    return rank


@pytest.mark.parametrize("variant", ["reference", "standard"])
def test_pagerank(spark, variant):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 9, (25, 2)) if a not in (2, 7)]
    pairs += pairs[:3]
    out = g.pagerank(edges(spark, *[(str(a), str(b)) for a, b in pairs]), nodes(spark, *map(str, range(9))), rounds=12, variant=variant)
    rank = {int(r["node"]): r["rank"] for r in out.collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9
    if variant == "reference":
        assert np.allclose([rank[i] for i in range(9)], _recurrence(pairs, 9, 12), atol=1e-9)


def test_fan_in_and_reverse_index(spark):
    e = edges(spark, ("a", "c"), ("b", "c"))
    rank = {r["node"]: r["rank"] for r in g.pagerank(e, nodes(spark, "a", "b", "c")).collect()}
    assert rank["c"] > rank["a"]
    files = spark.createDataFrame([("a", "a.rs"), ("b", "b.rs"), ("c", "c.rs")], "node string, file_path string")
    assert sorted((r["dst"], r["file_path"]) for r in g.reverse_index(e, files).collect()) == [("c", "a.rs"), ("c", "b.rs")]
    assert {r["file_path"] for r in g.affected_files(e, files, spark.createDataFrame([("c.rs",)], "file_path string")).collect()} == {"a.rs", "b.rs"}
    assert g.pagerank(edges(spark), nodes(spark)).count() == 0


def test_detectors(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), *[(f"x{i}", "c") for i in range(25)])
    added = spark.createDataFrame([("c", "a"), ("a", "c"), ("d", "d")], "src string, dst string")
    assert {(r["src"], r["dst"]) for r in g.closes_cycle(e, added, 5).collect()} == {("c", "a"), ("d", "d")}
    out = {r["start"]: (r["callers"], r["visited"], r["large"]) for r in g.blast_radius(e, start(spark, "c", "b", "a")).collect()}
    assert out == {"c": (26, 28, True), "b": (1, 2, False), "a": (0, 1, False)}
    alone = g.without_callers(nodes(spark, "a", "b", "c"), e, nodes(spark, "x1", "a"))
    assert {r["node"] for r in alone.collect()} == {"a"}


def test_detectors_follow_paths_of_any_depth(spark):
    """A chain of 60 is left after as many hops as the verdict needs; a ring of 10 closes."""
    n = 60
    chain = edges(spark, *[(f"n{i + 1}", f"n{i}") for i in range(n)], *[(f"m{i + 1}", f"m{i}") for i in range(9)], ("m0", "m9"))
    out = {r["start"]: (r["callers"], r["visited"], r["large"]) for r in g.blast_radius(chain, start(spark, "n0", "n53", "m3"), reach=12).collect()}
    assert out == {"n0": (1, 13, True), "n53": (1, 8, False), "m3": (1, 10, False)}
    added = spark.createDataFrame([("n0", "n14"), ("n9", "m1"), ("m5", "m6")], "src string, dst string")
    assert {(r["src"], r["dst"]) for r in g.closes_cycle(chain, added).collect()} == {("n0", "n14"), ("m5", "m6")}


def test_reach_stops_where_the_verdict_stands(spark, monkeypatch):
    """A hub of 300 callers, a ring of 8 and a clique: no hop keeps more than 51 new nodes a start (a chain: below)."""
    pairs = [(f"h{i}", "hub") for i in range(300)] + [(f"g{i}", f"h{i}") for i in range(300)]
    pairs += [(f"r{(i + 1) % 8}", f"r{i}") for i in range(8)] + [(f"k{i}", f"k{j}") for i in range(60) for j in range(60) if i != j]
    back = g.reversed_edges(edges(spark, *pairs))
    sizes = []
    monkeypatch.setattr(g, "cut", lambda rows, real=g.cut: sizes.append((out := real(rows)).count()) or out)
    seen = {r["start"]: r["visited"] for r in g.saturated_reach(back, start(spark, "hub", "r3", "k0", "alone", "h7"), 50).collect()}
    assert seen == {"hub": 51, "r3": 8, "k0": 51, "alone": 1, "h7": 2} and max(sizes) <= 2 * 51 + 10


def test_blast_radius_counts_all_that_leads_to_a_symbol(spark):
    """a tree of 5 hops, a hub of 300 callers and a ring of 8 are counted to their ends; a loop is no further node."""
    pairs = [(f"n{i}", f"n{(i - 1) // 3}") for i in range(1, 200)] + [(f"h{i}", "hub") for i in range(300)] + [(f"r{(i + 1) % 8}", f"r{i}") for i in range(8)] + [("n0", "n0")]
    out = g.blast_radius(edges(spark, *pairs), start(spark, "n0", "n60", "hub", "r3", "alone"), count_all=True)
    assert {r["start"]: (r["callers"], r["visited"], r["large"]) for r in out.collect()} == {"n0": (4, 200, True), "n60": (3, 4, False), "hub": (300, 301, True), "r3": (1, 8, False), "alone": (0, 1, False)}


def test_cycles_from_both_ends_equal_plain_reach(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(11)] + [(20, 21), (21, 22), (22, 23)]
    added = [(a, b) for a in [*range(9), 20, 23] for b in [*range(9), 20, 23]]
    e = edges(spark, *((str(a), str(b)) for a, b in pairs))
    asked = spark.createDataFrame([(str(a), str(b)) for a, b in added], "src string, dst string")
    for most in (2, None):
        reach = {a: {a} for a, _ in added}
        for _ in range(9 if most is None else most):
            reach = {a: r | {b for x, b in pairs if x in r} for a, r in reach.items()}
        found = {(int(r["src"]), int(r["dst"])) for r in g.closes_cycle(e, asked, most).collect()}
        assert found == {(a, b) for a, b in added if a in reach[b]}


def test_matching_ends_on_ties_and_chains(spark):
    """60 ties, a chain of 60 in which each pair waits for the one before, and heads smaller than a group."""
    ties = [("tie", f"o{i:02}", f"n{j:02}", 0.9) for i in range(60) for j in range(60)]
    chain = [("chain", f"o{i:02}", f"n{i + d:02}", 0.9 - (2 * i + d) / 1000) for i in range(60) for d in (0, 1)]
    scored = spark.createDataFrame([*ties, *chain, (None, "x", "y", 0.9)], "file string, old_id string, new_id string, score double")
    expected = {("tie", f"o{i:02}", f"n{i:02}") for i in range(60)} | {("chain", f"o{i:02}", f"n{i:02}") for i in range(60)}
    for head in (7, 1 << 16):
        out = g.greedy_matching(scored, ["file"], head)
        assert {(r["file"], r["old_id"], r["new_id"]) for r in out.collect()} == expected and out.columns == scored.columns


def _similar(spark, *rows):
    cols = "old_id string, new_id string, old_name string, new_name string, old_signature string, new_signature string, old_checksum string, new_checksum string, old_neighbours array<string>, new_neighbours array<string>, same_file double"
    return g.symbol_similarity(spark.createDataFrame(list(rows), cols).withColumn("file", F.lit("f")))


def test_symbol_similarity(spark):
    sig = "fn foo(x: i32) -> bool"
    rows = _similar(
        spark,
        ("1", "1", "foo", "foo", sig, sig, "k", "k", [], [], 1.0),
        ("2", "2", "get_user", "fetch_user", "fn get_user(id: u64) -> User", "fn fetch_user(id: u64) -> User", "k", "k", [], [], 1.0),
        ("3", "3", "parse_json", "render_html", "fn parse_json(s: &str) -> Value", "fn render_html(t: Template)", "a", "b", [], [], 1.0),
        ("4", "4", "foo", "foo", sig, sig, "k", "k", ["n"], ["n"], 1.0),
    )
    score = {r["old_id"]: r["score"] for r in rows.collect()}
    assert score["1"] > 0.8 and score["2"] > 0.6 and score["3"] < 0.6 and score["4"] > score["1"]
    names = spark.createDataFrame([("fn foo(x: i32, y: String) -> bool",), ("def f(self, a, b=1)",), ("plain",)], "s string").select(g.parameters("s").alias("p"), g.returned("s").alias("r")).collect()
    assert [set(r["p"]) for r in names] == [{"x", "y"}, {"a", "b=1"}, set()] and [r["r"] for r in names] == ["bool", None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 3)), max_size=18, unique_by=lambda x: x[:2]))
def test_matching_equals_the_greedy_order(spark, rows):
    taken, old, new = set(), set(), set()
    for o, n, s in sorted(rows, key=lambda x: (-x[2], str(x[0]), str(x[1]))):
        if o not in old and n not in new:
            taken.add((str(o), str(n)))
            old.add(o)
            new.add(n)
    scored = spark.createDataFrame([("f", str(o), str(n), float(s)) for o, n, s in rows], "file string, old_id string, new_id string, score double")
    assert {(r["old_id"], r["new_id"]) for r in g.greedy_matching(scored, ["file"]).collect()} == taken


def test_jaro_winkler(spark):
    assert jaro_winkler_pairs(["martha", "dixon", "", "same", ""], ["marhta", "dicksonx", "a", "same", ""]).round(4).tolist() == [0.9611, 0.8133, 0, 1, 1]
    rows = spark.sql("select * from values ('same', 'same'), (null, 'a'), ('', 'a'), ('same', 'same') as t(a, b)").select(jaro_winkler("a", "b").alias("s")).collect()
    assert sorted((r["s"] is None, r["s"] or 0) for r in rows) == [(False, 0), (False, 1), (False, 1), (True, 0)]


def _plain_jaro_winkler(a, b):
    """One character after another takes the first free equal one within reach."""
    if not a or not b:
        return float(a == b)
    reach, free, left = max(0, max(len(a), len(b)) // 2 - 1), list(b), []
    for i, c in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] == c), None)
        if at is not None:
            free[at] = None
            left.append(c)
    right = [c for c, f in zip(b, free, strict=True) if f is None]
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) // 2) / m) / 3 if m else 0.0
    same = len(os.path.commonprefix([a[:4], b[:4]]))
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abé ", max_size=9), st.text("abé ", max_size=9)), min_size=1, max_size=20))
def test_jaro_winkler_equals_brute_force(pairs):
    found = jaro_winkler_pairs([a for a, _ in pairs], [b for _, b in pairs])
    assert [round(x, 12) for x in found] == [round(_plain_jaro_winkler(a, b), 12) for a, b in pairs]


def test_stored_tables_follow_their_files(spark, tmp_path):
    """A table replaced under the same path: edges, turned edges and ranks are made anew."""
    import shutil

    from lorespan.adapters import Tables

    base = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", base)
    before = Tables(spark, str(base))
    counts = before.edges.count(), before.edges_back.count(), before.links.count()
    assert Tables(spark, str(base)).edges.inputFiles() == before.edges.inputFiles()  # stored once
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500)
    lines.coalesce(1).write.parquet(str(tmp_path / "lines"))
    (base / "lineitem.parquet").chmod(0o644)
    base.chmod(0o755)
    shutil.copy(next((tmp_path / "lines").glob("part-*")), base / "lineitem.parquet")
    for crc in base.glob(".*.crc"):
        crc.unlink()
    after = Tables(spark, str(base))
    assert after.edges.count() == after.edges_back.count() == after.links.count() < counts[0] == counts[1] == counts[2]


def test_rounds_deal_edges_between_linked_nodes_only(spark, monkeypatch):
    """F5-F13: equal to the quoted step with quiet sources, leaves, a ring and lone nodes; without a live edge no round stores ranks."""
    rng = random.Random(11)
    star = [(i, 20 + rng.randrange(6)) for i in range(20) for _ in range(3)]
    ring = [(20, 21), (21, 22), (22, 20), (22, 25), (0, 0)]
    for pairs, stored in ((star, 3), (star + ring, 3 + 8)):
        asked, cuts = edges(spark, *((str(a), str(b)) for a, b in pairs)), []
        monkeypatch.setattr(g, "cut", lambda rows, real=g.cut, cuts=cuts: cuts.append(1) or real(rows))
        out = {int(r["node"]): r["rank"] for r in g.pagerank(asked, nodes(spark, *map(str, range(28))), rounds=8).collect()}
        monkeypatch.undo()
        assert np.allclose([out[i] for i in range(28)], _recurrence(pairs, 28, 8), atol=1e-12) and len(cuts) == stored


def test_reverse_index_deals_edges_by_their_size(spark, monkeypatch):
    """larger files are dealt among more tasks, so that no task's share grows with them."""
    from lorespan.operators import storage

    asked = storage.cut(edges(spark, *((f"a{i}", f"b{i % 7}") for i in range(500))))
    files = spark.createDataFrame([(f"a{i}", f"f{i % 3}") for i in range(500)], "node string, file_path string")
    monkeypatch.setattr(storage, "TASK_BYTES", 200)
    out = g.reverse_index(asked, files)
    assert out.rdd.getNumPartitions() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r["dst"], r["file_path"]) for r in out.collect()} == {(f"b{i % 7}", f"f{i % 3}") for i in range(500)} and out.count() == 21


def test_ranks_deal_edges_by_the_size_of_their_files(spark, monkeypatch):
    """a task's pairs grew with the edges, as their number of tasks stayed."""
    asked = []
    monkeypatch.setattr(g, "tasks", lambda rows: asked.append(rows.columns) or 3)
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    ranks = g.pagerank(edges, spark.createDataFrame([("a",), ("b",), ("c",)], "node string"))
    assert asked == [["src", "dst"]] and {round(x["rank"], 9) for x in ranks.collect()} == {round(1 / 3, 9)}


@pytest.mark.parametrize("variant", ["reference", "standard"])
def test_pagerank_of_distinct_pairs_needs_no_grouping(spark, variant, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2))} | {(20 + a, b) for a in range(6) for b in (a, 30, 31)} | {(99, 3)}
    rows, known = edges(spark, *[(str(a), str(b)) for a, b in sorted(pairs)]), nodes(spark, *map(str, range(34)))
    ranks = lambda **more: {r["node"]: r["rank"] for r in g.pagerank(rows, known, rounds=10, variant=variant, **more).collect()}
    want, lone = ranks(), ranks(parallel=False)
    assert len(want) == 34 and lone == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(g, "_FEW", 0)
    assert ranks(parallel=False) == pytest.approx(want, abs=1e-12)
    if variant == "reference":  # the edge of 99, which is no node, counts for nothing
        inside = [(a, b) for a, b in pairs if a != 99]
        assert np.allclose([want[str(i)] for i in range(34)], _recurrence(inside, 34, 10), atol=1e-9)
