from __future__ import annotations

import datetime as dt
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespan import config, schema, sources, sql, streaming
from lorespan.api import Engine, follow_log
from lorespan.operators import memory as m
from lorespan.operators import tables as ops
from lorespan.operators import windows as win
from lorespan.operators.indexing import bulk_index

NOTE = "id string, anchor_type string, anchor_value string, text string, quality double, content_hash string"


def notes(spark, *rows):
    return m.with_hash(spark.createDataFrame([(*r, None) for r in rows], NOTE))


def test_upserting_notes(spark):
    old = notes(spark, ("a", "node", "n", "Hello  World", 0.5))
    new = notes(spark, ("b", "node", "n", "hello world", 0.5), ("c", "node", "n", "other", 0.5), ("d", "node", "n", "other", 0.5), ("a", "file", "f", "third", 0.5)).withColumn("at", F.col("id"))
    out = {r["id"]: (r["text"], round(r["quality"], 6)) for r in m.upsert_notes(old.select(*old.columns), new, "at").collect()}
    assert out == {"c": ("other", 0.6), "a": ("third", 0.5)}
    many = notes(spark, *[(f"x{i}", None, None, "same", 0.5) for i in range(20)]).withColumn("at", F.col("id"))
    assert [(r["id"], r["quality"]) for r in m.upsert_notes(old.limit(0), many, "at").collect()] == [("x0", 1.0)]


def test_merge_cases(spark):
    target = notes(spark, ("t", "node", "n1", "known", 0.5))
    nodes = spark.createDataFrame([("n1",)], "key string")
    ids = lambda *rows: {r["id"] for r in m.merge(notes(spark, *rows), target, nodes).collect()}
    assert ids(("s", "node", "n1", "known", 0.5)) == {"t"}
    assert ids(("s", "node", "n1", "new", 0.5)) == {"t", "s"}
    assert ids(("s", "node", "gone", "new", 0.5)) == {"t"}
    assert len(ids(("t", "node", "n1", "new", 0.5))) == 2
    merged = m.merge(notes(spark, ("t", None, None, "new", 0.5)), target, nodes)
    assert m.merge(notes(spark, ("t", None, None, "new", 0.5)), merged, nodes).count() == merged.count() == 2


def test_counts_and_edges(spark):
    base = spark.createDataFrame([("a1", 0), ("a2", 0)], "id string, retrieval_count int")
    hits = spark.createDataFrame([("a1",), ("a2",), ("a1",)], "id string")
    assert {r["id"]: r["retrieval_count"] for r in m.retrieved(base, hits).collect()} == {"a1": 2, "a2": 1}
    e = "from_id string, to_id string, relation string, weight double, created_at long"
    a, b = spark.createDataFrame([("x", "y", "r", 1.0, 5)], e), spark.createDataFrame([("x", "y", "r", 0.5, 9)], e)
    assert ops.accumulate(a, b, ["from_id", "to_id", "relation"], "weight", "created_at").first()[3:] == (1.5, 5)
    signals = spark.createDataFrame([("CHURN", "s"), ("DEAD_END", "s")], "kind string, session_id string")
    assert [r["kind"] for r in m.valid_signals(signals).collect()] == ["CHURN"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 900)), max_size=15), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 900)), max_size=15))
def test_interval_join(spark, left, right):
    a = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "i int, k int, at long")
    b = spark.createDataFrame([(j, k, t) for j, (k, t) in enumerate(right)], "j int, k int, later long")
    out = sorted((r["i"], r["j"]) for r in win.within_seconds(a, b, "k", "at", "later", 300).collect())
    assert out == sorted((i, j) for i, (k, t) in enumerate(left) for j, (q, u) in enumerate(right) if k == q and t <= u <= t + 300)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    once = ops.upsert(old, new, ["k"], F.col("v"))
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "e")] == sorted(map(tuple, ops.upsert(once, new, ["k"], F.col("v")).collect()))


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("budget = 500000\ndegree_cap = 7\n[scope_aliases]\nui = 'src/ui'\n")
    found = config.load(str(path), {"LORESPAN__DEGREE_CAP": "9", "OTHER__BUDGET": "1"})
    assert (found.budget, found.degree_cap, found.node_budget, found.scope_aliases) == (100_000, 9, 100, {"ui": ("src/ui",)})


def test_store_versions_and_branches(spark, tmp_path):
    store = sources.Store(spark, str(tmp_path / "db"))
    rows = lambda *ids: spark.createDataFrame([(i, "user") for i in ids], "key string, value string")
    assert store.read("daemon_meta").count() == 0
    store.write("daemon_meta", rows("a"))
    store.write("daemon_meta", rows("b", "c"), branch="dev")
    store.write("daemon_meta", rows("d"))
    assert [r["key"] for r in store.read("daemon_meta").collect()] == ["d"]
    assert sorted(r["key"] for r in store.read("daemon_meta", "dev").collect()) == ["b", "c"]
    store.append("daemon_meta", rows("e"))
    assert sorted(r["key"] for r in store.read("daemon_meta").collect()) == ["d", "e"]
    both = sources.federated({"x": store, "y": store}, "daemon_meta", "dev")
    assert sorted((r["repo"], r["key"]) for r in both.collect()) == [("x", "b"), ("x", "c"), ("y", "b"), ("y", "c")]
    with pytest.raises(ValueError):
        schema.conform(rows("a"), "daemon_meta", version=99)
    old = schema.conform(spark.createDataFrame([("a", "text")], "id string, text string"), "annotations").first()
    assert (old["kind"], old["quality"], old["retrieval_count"]) == ("fact", 0.5, 0)


def test_two_writers_and_a_dead_one(spark, tmp_path, monkeypatch):
    a, b = (sources.Store(spark, str(tmp_path / "db")) for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i, "v") for i in ids], "key string, value string")
    a.write("daemon_meta", rows("a"))
    seen = a._newest
    stale = [seen(a._folder("daemon_meta", "main"))]
    monkeypatch.setattr(a, "_newest", lambda folder: stale.pop() if stale else seen(folder))  # a looked before b committed
    b.append("daemon_meta", rows("b"))
    assert a.append("daemon_meta", rows("c")) == 3
    assert sorted(r["key"] for r in b.read("daemon_meta").collect()) == ["a", "b", "c"]
    rows("x").write.parquet(str(tmp_path / "db/daemon_meta/main/data-dead"))  # never committed
    assert b.read("daemon_meta").count() == 3


def test_branches_and_registry(spark, tmp_path):
    store = sources.Store(spark, str(tmp_path / "db"))
    node = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    store.write("nodes", node("a"))
    assert store.switch_branch("main") == "same" and store.switch_branch("dev/x") == "cold" and store.get_meta("current_branch") == "dev/x"
    assert [r["id"] for r in store.read("nodes", "dev/x").collect()] == ["a"]
    store.write("nodes", node("b"), "dev/x")
    assert store.switch_branch("main") == "warm" and [r["id"] for r in store.read("nodes").collect()] == ["a"]
    other = sources.Store(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        store.federate(other.root, 5)
    other.write("nodes", node("z"))
    store.federate(other.root, 5)
    store.federate(other.root, 7)
    assert [(r["path"], r["added_at"], r["last_seen"]) for r in store.federated_repos().collect()] == [(other.root, 7, 7)]
    assert [tuple(r) for r in store.verified_repos().collect()] == [(other.root, True)]
    shutil.rmtree(other.root)
    assert [tuple(r) for r in store.verified_repos().collect()] == [(other.root, False)]
    store.unfederate(other.root)
    assert store.federated_repos().count() == 0


def test_changes_reindex_after_the_lock(spark, tmp_path):
    engine = Engine(sources.Store(spark, str(tmp_path / "db")), as_of=50)
    text = {"/p/a.py": "def main():\n    helper(1)\n", "/p/b.py": "def helper(x):\n    return x\n"}
    files = lambda names, at: spark.createDataFrame([(n, text[n], at) for n in names], "file_path string, content string, mtime long")
    engine.save_index(bulk_index(files(text, 10), rounds=3))
    text["/p/b.py"] = "def helper(x, y):\n    return x\n"
    live, _ = _stream(spark, tmp_path, [("/p/b.py", "write"), ("/p/b.py", "write"), ("/p/out/c.py", "write"), ("/p/x.min.js", "write"), ("/p/outer/d.py", "access")], "path string, change string")
    waits = [True, True, False]
    q = streaming.reindexing(streaming.changes(live, ignored=("out", "*.min.js")), engine, lambda paths: files([r["path"] for r in paths.collect()], 20), str(tmp_path / "ck"), available_now=True, locked=lambda: waits.pop(0), poll=0.01)
    q.awaitTermination(120)
    assert not waits
    now = {r["name"]: (r["id"], r["signature"]) for r in engine._read("nodes").collect()}
    assert now["helper"][1] == "def helper(x, y):"
    assert [(r["from_id"], r["to_id"]) for r in engine._read("edges").collect()] == [(now["main"][0], now["helper"][0])]


def test_failed_searches_fire_once(spark, tmp_path):
    rows = [("s", T0 + dt.timedelta(hours=2 * i), q) for i, q in enumerate((" Foo", "foo", "FOO ", "foo", "foo", "bar"))]
    live, still = _stream(spark, tmp_path, rows, "session_id string, at timestamp, query string")
    out = [tuple(r) for r in _drain(spark, streaming.failed_searches(live), "failed").collect()]
    assert out == [("s", "foo", 3)] == [tuple(r) for r in streaming.failed_searches(still).collect()]


def test_retention_and_orphans(spark):
    rows = spark.createDataFrame([(T0,), (T0 + dt.timedelta(hours=30),)], "start timestamp")
    assert streaming.retained(rows, int((T0 + dt.timedelta(hours=31)).timestamp())).count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "src" / ".hidden").mkdir(parents=True)
    for name in ("a.py", "b.md", "c.txt", ".hidden/d.py", "gen.py"):
        (tmp_path / "src" / name).write_text("def f(): pass\n")
    found = sources.source_files(spark, str(tmp_path / "src"), ["**/gen.py"]).collect()
    assert [r["file_path"].rsplit("/", 1)[-1] for r in found] == ["a.py"] and found[0]["content"].startswith("def")
    assert sources.source_files(spark, str(tmp_path / "src"), docs=True).count() == 1
    (tmp_path / "m.jsonl").write_text('{"event": "read", "input_bytes": 4}\nbroken\n{"event": "edit"}\n')
    assert sorted(r["event"] for r in sources.json_lines(spark, str(tmp_path / "m.jsonl")).collect()) == ["edit", "read"]
    (tmp_path / "run.ndjson").write_text('{"type": "assistant", "session_id": "s", "message": {"usage": {"input_tokens": 5, "output_tokens": 2}, "content": [{"type": "tool_use", "name": "Read"}, {"type": "text"}]}}\nno json\n{"type": "result", "session_id": "s", "duration_ms": 9}\n{"type": "assistant", "session_id": "s", "message": {"content": [{"type": "tool_use", "name": "mcp__notes__add"}, {"type": "tool_use", "name": "Read"}]}}\n{"type": "result", "session_id": "s", "duration_ms": 30}\n{"type": "system", "session_id": "t"}\n')
    total, quiet = sources.run_metrics(sources.run_events(spark, str(tmp_path / "run.ndjson"))).orderBy("session_id").collect()
    assert (total["input_tokens"], total["output_tokens"], total["tool_calls"], total["turns"], total["duration_ms"]) == (5, 2, 3, 2, 39)
    assert total["by_tool"] == {"Read": 2, "mcp__notes__add": 1} and total["by_service"] == {"notes__add": 1}
    assert (quiet["turns"], quiet["duration_ms"], quiet["tool_calls"], quiet["by_tool"], quiet["by_service"]) == (0, 0, 0, {}, {})
    (tmp_path / "log").write_text("".join(f'{{"timestamp": "2024-01-0{i}", "level": "{lv}", "message": "x", "method": "m"}}\n' for i, lv in enumerate(("DEBUG", "INFO", "ERROR"), 1)))
    assert [r["level"] for r in sources.log_lines(spark, str(tmp_path / "log"), "info").collect()] == ["ERROR", "INFO"]
    (tmp_path / "t.toml").write_text("[relevance]\nrecall = 0.8\n[[cases]]\nname = 'a'\nexpected = ['x']\n")
    assert sources.thresholds(str(tmp_path / "t.toml")) == {"relevance.recall": 0.8}
    assert sources.cases(spark, str(tmp_path / "t.toml")).first().asDict() == {"expected": '["x"]', "name": "a"}
    assert sources.as_text(spark.createDataFrame([("abcdef",)], "c string"), {"c": 4}).first()["c"] == "abc…"


def test_sql_guard():
    for good in ("select 1", "WITH x AS (SELECT 1) SELECT * FROM x;", "explain select 1", "(select 1) union (select 2)", "select 'drop table x'", "describe t"):
        assert sql.read_only(good)
    for bad in ("drop table x", "insert into x values (1)", "select 1; drop table x", "with a as (select 1) insert into x select * from a", "create view v as select 1", ""):
        assert not sql.read_only(bad)


T0 = dt.datetime(2024, 1, 1)


def _stream(spark, tmp_path, rows, ddl):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(ddl).parquet(path), spark.read.parquet(path)


def _drain(spark, rows, name, mode="append"):
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.sql(f"select * from {name}")


def test_streams_equal_batches(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=37 * i), f"s{i % 3}", float(i)) for i in range(60)]
    live, still = _stream(spark, tmp_path, rows, "at timestamp, session string, value double")
    for name, f in (("snap", lambda x: streaming.snapshots(x)), ("slide", lambda x: streaming.sliding_counts(x, ["session"])), ("sess", lambda x: streaming.sessions(x, "session", "3 minutes"))):
        out = _drain(spark, f(live), name, "append" if name == "sess" else "complete")
        batch = set(map(tuple, f(still).collect()))
        got = set(map(tuple, out.collect()))
        assert got == batch if name != "sess" else got <= batch


def test_thrashing_stream(spark, tmp_path):
    a, b = "a" * 31 + "0", "a" * 31 + "1"
    rows = [("n1", T0 + dt.timedelta(seconds=60 * i), a if i % 2 else b) for i in range(4)] + [("n2", T0 + dt.timedelta(seconds=400 * i), a) for i in range(4)] + [("n3", T0, a), ("n3", T0 + dt.timedelta(seconds=1), "b" * 32), ("n3", T0 + dt.timedelta(seconds=2), "c" * 32)]
    live, _ = _stream(spark, tmp_path, rows, "node string, at timestamp, checksum string")
    assert [(r["node"], r["at"]) for r in _drain(spark, streaming.thrashing(live), "thrash").collect()] == [("n1", T0 + dt.timedelta(seconds=120))]


def test_batches_of_changes(spark, tmp_path):
    rows = [("/p/a.py", "write"), ("/p/a.py", "write"), ("/p/.index/x", "write"), ("/p/b.py", "access")]
    live, _ = _stream(spark, tmp_path, rows, "path string, change string")
    seen: list = []
    q = streaming.each_batch(streaming.changes(live), lambda df, n: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(60)
    assert seen == ["/p/a.py"]


def test_follow_ups(spark, tmp_path):
    served = spark.createDataFrame([(1, "s", T0, "f1")], "capsule_id int, session_id string, at timestamp, file string")
    acts = spark.createDataFrame([("s", T0 + dt.timedelta(seconds=t), "edit", f) for t, f in ((0, "f1"), (300, "src/f1"), (301, "f1"), (5, "g"))], "session_id string, at timestamp, event_type string, file_path string")
    assert streaming.follow_ups(served, acts).count() == 2
    fails = spark.createDataFrame([("s", T0, q) for q in ("  FooBar  ", "foobar", "FOOBAR", "x")], "session_id string, at timestamp, query string")
    assert [tuple(r) for r in streaming.failed_searches(fails).collect()] == [("s", "foobar", 3)]


def test_a_followed_log_gives_each_line_once(spark, tmp_path):
    logs, line = tmp_path / "logs", '{{"timestamp": "{0}", "level": "{1}", "message": "x", "method": "{2}"}}\n'.format
    logs.mkdir()

    def follow() -> list[str]:
        stream = follow_log(spark, str(logs), "warn", "search")
        stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(r["timestamp"] for r in spark.read.schema("timestamp string").json(str(tmp_path / "out")).collect())

    (logs / "1").write_text(line("1", "ERROR", "search_docs") + line("2", "INFO", "search_docs") + "broken\n" + line("3", "WARN", "status"))
    assert follow() == ["1"]
    (logs / "2").write_text(line("4", "warn", "search_symbols"))
    assert follow() == ["1", "4"] and follow() == ["1", "4"]
