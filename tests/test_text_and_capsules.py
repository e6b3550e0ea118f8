from __future__ import annotations

import random

import numpy as np
import pytest

from lorespan import functions as fn
from lorespan.config import Settings
from lorespan.functions import jaro_winkler_pairs
from lorespan.operators import capsule as cap
from lorespan.operators.graph import INTENT_HOPS
from lorespan.operators.signals import WEIGHTS
from lorespan.operators import retrieval as r
from lorespan.operators.extract import index, resolved, symbols, symbols_of
from pyspark.sql import functions as F


def _chunks(spark, text):
    return [(c["heading"], c["start_line"], c["end_line"], c["content"]) for c in r.chunk_markdown(spark.createDataFrame([("a.md", text)], "file_path string, content string")).orderBy("chunk_index").collect()]


def test_markdown_chunks(spark):
    assert [c[0] for c in _chunks(spark, "# Title\ntext\n\n## Section\nmore\n")] == ["Title", "Section"]
    assert [c[0] for c in _chunks(spark, "no headings\nat all")] == [None]
    assert len(_chunks(spark, "# H\n" + "line\n" * 150)) == 1
    long = _chunks(spark, "intro\n# H\n" + "line\n" * 250)
    assert [c[1:3] for c in long] == [(1, 1), (2, 101), (102, 201), (202, 252)] and {c[0] for c in long[1:]} == {"H"}
    assert _chunks(spark, "") == [] and _chunks(spark, "\n \n") == []
    text = "\n".join(random.Random(1).choice(["# a", "x", "y z", "## b c", "```"]) for _ in range(120))
    assert "\n".join(c[3] for c in _chunks(spark, text)) == text


NODES = ["user_authentication", "user_profile", "render_template", "database_connection", "parse_json_request", "authenticate_user", "validate_token"]


def _search(spark, query, mode="and"):
    docs = spark.createDataFrame([(n, f"{n} fn {n}()") for n in NODES], "id string, text string")
    out = r.top_hits(r.bm25(docs, spark.createDataFrame([(1, query)], "qid int, query string"), mode), 10)
    return [x["id"] for x in out.orderBy("rank").collect()]


def test_bm25_cases(spark):
    assert _search(spark, "user_authentication")[0] == "user_authentication"
    assert len(_search(spark, "auth*")) >= 2 and len(_search(spark, "user*")) >= 2
    assert _search(spark, "validate_token") == ["validate_token"]
    assert _search(spark, "zzznonsense") == [] and _search(spark, "") == [] and _search(spark, "user zzz") == []
    assert set(_search(spark, "user zzz", "or")) == {n for n in NODES if "user" in n.split("_")}


def test_small_functions(spark):
    row = spark.range(1).select(
        fn.sanitise(F.lit("fn(x: i32)")).alias("a"), fn.sanitise(F.lit("***")).alias("b"), fn.identifier_words(F.lit("getUserById")).alias("c"), fn.identifier_words(F.lit("simple")).alias("d"),
        fn.token_estimate(F.lit("é" * 4)).alias("e"), fn.nearest_rank(F.array(*[F.lit(float(i)) for i in range(1, 101)]), 50).alias("f"), fn.nearest_rank(F.array().cast("array<double>"), 50).alias("g"),
        fn.normalised_levenshtein(F.lit("abcd"), F.lit("abce")).alias("h"), fn.language(F.lit("a/b.hxx")).alias("i"), fn.route(F.lit("x.markdown")).alias("j"), fn.route(F.lit(".py")).alias("k"),
        fn.one_star_glob(F.lit("src/a.rs"), "src/*.rs").alias("l"), fn.one_star_glob(F.lit("ab"), "ab*b").alias("m"), fn.branch_name(F.lit("a/b:c")).alias("n"), fn.is_test_path(F.lit("__tests__/foo.ts")).alias("o"),
        fn.note_hash(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("Hello  World")).alias("p"), fn.note_hash(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("hello world")).alias("q"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == ("fn x i32", "", "getUserById get user by id", "simple", 2)
    assert 49 <= row["f"] <= 52 and row["g"] == 0 and row["h"] == 0.75
    assert (row["i"], row["j"], row["k"], row["l"], row["m"], row["n"], row["o"]) == ("cpp", "doc", "skip", True, False, "a_b_c", True)
    assert row["p"] == row["q"]


@pytest.mark.parametrize(("query", "primary", "secondary"), [("", "understand", None), ("error handling in parser", "debug", None), ("simplify this function", "refactor", None), ("where is the config loaded", "understand", None), ("implement rate limiting", "extend", None), ("the code has a bug so rename it", "debug", "refactor"), ("how does greet work", "understand", None)])
def test_intents(spark, query, primary, secondary):
    out = r.intents(spark.createDataFrame([(1, query)], "qid int, query string")).first()
    assert (out["primary"], out["secondary"]) == (primary, secondary)
    assert out["primary_weight"] + out["secondary_weight"] == 1.0


def test_intents_compare_where_the_texts_are(spark):
    """Likeness equals that of all pairs, long texts and odd letters included, and no text or word is dealt."""
    rng = np.random.default_rng(7)
    words = [w for ws in r.KEYWORDS.values() for w in ws]
    texts = ["", "x", "é", "\U0001f600bug", "walk me thrugh", "a" * 400, "bug " * 90]
    texts += ["".join(rng.permutation([*w, *rng.choice([*"abeirst \u0161"], 2)])[rng.integers(0, 3) :]) for w in words for _ in range(20)] + [w[:-1] + "zz" for w in words]
    want = [[max(s) if (s := [x for x in jaro_winkler_pairs([t] * len(ws), list(ws)) if x > 0.7]) else 0.0 for ws in r.KEYWORDS.values()] for t in texts]
    assert r._likeness(texts).tolist() == want and sum(map(any, want)) > 100
    asked = spark.createDataFrame([(1, "creat a thing"), (2, None), (3, "\tcreat\n " + "qqq " * 200), (4, "fix it"), (5, "xyzzy")], "qid int, query string")
    out = r.intents(asked)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(x["qid"], x["primary"]) for x in out.orderBy("qid").collect()] == [(1, "extend"), (2, "understand"), (3, "extend"), (4, "debug"), (5, "understand")]


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id int, source string, item string, tokens long, score double, pinned boolean, content string, place int")


def test_trim_skips_what_does_not_fit(spark):
    rows = _rows(spark, (1, "doc", "a", 5, 0.9, False, "", 0), (1, "doc", "b", 9, 0.8, False, "", 0), (1, "doc", "c", 4, 0.7, False, "", 0))
    budget = spark.createDataFrame([(1, 10)], "request_id int, budget int")
    assert {r["item"] for r in cap.trimmed(rows, budget).collect()} == {"a", "c"}
    rows = _rows(spark, (1, "target", "t", 100, 1.0, True, "", 0), *[(1, "node", str(i), 200, 0.5, False, "", 0) for i in range(3)])
    out = cap.trimmed(rows, spark.createDataFrame([(1, 400)], "request_id int, budget int")).collect()
    assert sum(r["tokens"] for r in out) <= 400 and len(out) == 2
    out = cap.trimmed(rows, spark.createDataFrame([(1, 50)], "request_id int, budget int")).collect()
    assert [r["item"] for r in out] == ["t"]


def test_sections_in_order(spark):
    rows = _rows(spark, (1, "caller", "c", 1, 0.1, True, "calls it", 1), (1, "target", "t", 1, 1.0, True, "the target", 0), (1, "signal", "s", 1, 1.0, True, "careful", 0))
    assert cap.rendered(rows).first()["capsule"] == "[!]\ncareful\n\n[TARGET]\nthe target\n\n[CALLERS]\ncalls it"


def test_notes_are_distilled(spark):
    notes = lambda n: spark.createDataFrame([(1, "n1", f"a{i}", "text", i / 10) for i in range(n)], "request_id int, label string, id string, content string, quality double")
    few = cap.distilled(notes(4), ["request_id"]).collect()
    many = cap.distilled(notes(8), ["request_id"]).collect()
    assert len(few) == 4 and sorted(r["content"] for r in many) == ["[+5 more notes on n1]", "text", "text", "text"]
    assert {r["id"] for r in many} == {"a7", "a6", "a5", None}


def test_levels(spark):
    assert cap.LEVELS["standard"] == cap.Level(10, 10, 5) and cap.LEVELS["detailed"].body and cap.LEVELS["minimal"].notes == 0
    row = spark.createDataFrame([("f1\nf2\nf3\nf4",)], "c string").select(cap.lines_of(F.col("c"), F.lit(2), F.lit(3)).alias("x")).first()
    assert row["x"] == "f2\nf3"


def test_fixed_values():
    """Written out here, so that the queries' twins, which take the engine's own, are not the only check."""
    fields = ("callers", "callees", "notes", "file_notes", "project_notes", "docs", "history", "extended", "body")
    levels = {k: tuple(getattr(v, f) for f in fields) for k, v in cap.LEVELS.items()}
    assert levels == {"minimal": (5, 5, 0, 0, 0, 0, 0, 0, False), "standard": (10, 10, 5, 0, 0, 0, 0, 0, False), "detailed": (20, 20, 10, 3, 3, 3, 3, 50, True)}
    assert r.KIND_WEIGHT == {"pitfall": 1.2, "strategy": 1.1, "context": 0.8}
    assert {k: v[:2] for k, v in INTENT_HOPS.items()} == {"debug": (3, 2), "refactor": (0, 5), "understand": (2, 2), "review": (2, 2), "extend": (0, 2)}
    assert (r.SPLIT_OVER, r.PIECE, cap.SIGNALS_MOST) == (200, 100, 5)
    assert {k: WEIGHTS[k] for k in ("THRASHING", "EMPTY_CAPSULE", "FAILED_SEARCH")} == dict.fromkeys(("THRASHING", "EMPTY_CAPSULE", "FAILED_SEARCH"), 2.0) and WEIGHTS["CHURN"] == WEIGHTS["HOTSPOT"] == 1.0
    assert (Settings().budget, Settings().degree_cap) == (8000, 50)


def test_scores(spark):
    lit = F.lit
    score = lambda kind, quality=0.5, stale=False: r.note_score(lit(None).cast("double"), lit(1.0), lit(0.5), lit(quality), lit(stale), lit(kind))
    p = lambda a, t, n: r.proximity(lit(a), lit(t), lit(n))
    x = spark.range(1).select(score("pitfall"), score("fact"), score("context"), score("fact", 0.9), score("fact", 0.5, True), p("node", True, True), p("node", False, True), p("file", True, False), p(None, False, False)).first()
    assert x[0] > x[1] > x[2] and x[3] > x[1] > x[4] and list(x)[5:] == [1.0, 0.7, 0.8, 0.3]


CASES = {
    "rs": ("fn hello() {}\nstruct Point { x: f64, y: f64 }\nenum Color { Red, Blue }\nimpl Point { fn new() -> Self { make(1) } }", {"hello", "Point", "Color", "impl Point", "new"}),
    "py": ("def greet(name):\n    pass\n\nclass Animal:\n    def speak(self):\n        pass", {"greet", "Animal", "speak"}),
    "ts": ("interface Shape { area(): number }\nfunction draw(s: Shape) {}\nclass Circle implements Shape { area() { return 0; } }\ntype Id = number;\nenum E { A }", {"Shape", "draw", "Circle", "area", "Id", "E"}),
    "js": ("function add(a, b) { return a + b; }\nclass Calculator { multiply(a, b) { return a * b; } }", {"add", "Calculator", "multiply"}),
    "go": ("package main\ntype Point struct { X float64; Y float64 }\nfunc NewPoint(x, y float64) Point { return Point{x, y} }\nfunc (p Point) Len() int { return 1 }", {"Point", "NewPoint", "Len"}),
    "java": ("class Greeter { Greeter() {} public void greet(String name) {} }\nenum Day { MON, TUE }", {"Greeter", "greet", "Day"}),
    "cpp": ("class Vector { public: int x, y; };\nvoid draw(Vector v) {}", {"Vector", "draw(Vector v)"}),
    "c": ("struct Point { int x; int y; };\nvoid draw(struct Point p) {}", {"Point", "draw(struct Point p)"}),
    "rb": ("class Dog\n  def bark\n    puts 'woof'\n  end\nend\ndef greet(name)\n  puts name\nend", {"Dog", "bark", "greet"}),
    "php": ("<?php\nclass User { public function getName() { return ''; } }\nfunction hello() {}", {"User", "getName", "hello"}),
    "cs": ("class Widget { void Render() {} }\nenum Size { Small, Large }", {"Widget", "Render", "Size"}),
    "swift": ("class Vehicle { func drive() {} }\nfunc park(v: Vehicle) {}", {"Vehicle", "drive", "park"}),
    "sh": ("# says hi\ngreet() {\n  echo hi\n}", {"greet"}),
    "kt": ("class Person(val name: String)", set()), "scala": ("class Animal {}", set()), "tf": ('resource "a" "b" {}', set()),
}


@pytest.mark.parametrize("ending", sorted(CASES))
def test_symbols(ending):
    text, names = CASES[ending]
    assert {s["name"] for s in symbols_of(f"src/t.{ending}", text)} == names


def test_symbol_details():
    text = "/// Says hello.\nfn hello(x: i32) -> bool {\n    // not_called()\n    greet(\"a(b)\"); s.run(); A::f(); true\n}\n"
    (s,) = symbols_of("a.rs", text)
    assert (s["kind"], s["signature"], s["docstring"], s["line_start"], s["line_end"], s["calls"]) == ("Function", "fn hello(x: i32) -> bool", "Says hello.", 2, 5, ["greet", "run", "A::f"])
    twice = symbols_of("a.py", "@dec\ndef f(a):\n    '''Doc.'''\n    return g.h(a)\n")
    assert [(x["signature"], x["docstring"], x["calls"]) for x in twice] == [("@dec", "Doc.", ["h"]), ("def f(a):", "Doc.", ["h"])]
    assert symbols_of("a.rs", "") == [] and symbols_of("a.py", "def broken(:") == [] and symbols_of(".py", "def f(): pass") == []


def test_index_and_resolution(spark):
    files = spark.createDataFrame([("a.py", "def main():\n    helper()\n    gone()\n"), ("b.py", "def helper():\n    pass\n"), ("c.md", "# x"), (None, "def f(): pass"), ("d.py", None)], "file_path string, content string")
    nodes, raw = index(files)
    edges = resolved(raw, nodes)
    names = {r["id"]: r["name"] for r in nodes.collect()}
    assert sorted(names.values()) == ["helper", "main"] and raw.count() == 2
    assert [(names[r["from_id"]], names[r["to_id"]]) for r in edges.collect()] == [("main", "helper")]
    assert symbols(files.limit(0)).count() == 0
