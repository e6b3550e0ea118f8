"""GROUPS frames with exclusions and JSON trees against DuckDB's own."""

from __future__ import annotations

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lorespan import sql
from lorespan.operators import documents, windows

C = F.col


@pytest.mark.parametrize("exclude", [None, "current row", "group", "ties"])
def test_frames(spark, exclude):
    rng = random.Random(3)
    rows = [(n, rng.choice("ab"), rng.choice([None, 1, 2, 2, 5]), rng.choice([None, 1, 2, 3])) for n in range(60)]
    df = spark.createDataFrame(rows, "n int, p string, k int, v int").repartition(3).cache()
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (n int, p varchar, k int, v int)")
    duck.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    edge = lambda x, way: f"UNBOUNDED {way}" if x is None else "CURRENT ROW" if x == 0 else f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"
    out, picks = df, []
    for i, (start, end) in enumerate([(-1, 1), (None, 0), (0, None), (1, 2), (-2, -1), (0, 0), (None, None)]):
        frame = f"GROUPS BETWEEN {edge(start, 'PRECEDING')} AND {edge(end, 'FOLLOWING')}" + (f" EXCLUDE {exclude.upper()}" if exclude else "")
        for what in ("sum", "count", "min", "max"):
            out = windows.framed(out, f"{what}_{i}", what, "v", ["p"], [C("k").asc_nulls_first()], start, end, exclude)
            picks.append(f"{what}(v) OVER (PARTITION BY p ORDER BY k NULLS FIRST {frame})")
    want = {r[0]: tuple(r[1:]) for r in duck.execute(f"SELECT n, {', '.join(picks)} FROM t").fetchall()}
    got = {r["n"]: tuple(r)[4:] for r in out.collect()}
    assert got == want


def test_frames_that_are_not(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        windows.framed(df, "x", "avg", "v", ["k"], [C("k")], 0, 0)
    assert windows.framed(df, "x", "count", "v", ["k"], [C("k")], 0, 0, "group").collect()[0]["x"] == 0


DEEP = {"a": {"b c": [1, -2.5, None, True, "x"]}, "e": {}, "s": 'q"uote', "z": [[[{"k": False}]]]}


def test_trees(spark):
    texts = [json.dumps(DEEP), "[]", "7", "null", '"t"', "{broken", "", None, '{"a": 1}', '{"a": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
    got = documents.json_tree(df, "doc", ["id"]).collect()
    duck = duckdb.connect()
    want = []
    for n, text in enumerate(texts):
        if text and text != "{broken":
            found = duck.execute("SELECT key, type, json_extract_string(value, '$'), fullkey, path FROM json_tree(?::JSON)", [text]).fetchall()
            kinds = {"VARCHAR": "text", "UBIGINT": "integer", "BIGINT": "integer", "DOUBLE": "real"}
            for key, kind, value, full, path in found:
                kind = value if kind == "BOOLEAN" else kinds.get(kind, kind.lower())
                want.append((n, key, kind, value if kind not in ("object", "array", "null") else None, full, path))
    assert sorted(map(str, want)) == sorted(str((r["id"], r["key"], r["type"], r["atom"], r["fullkey"], r["path"])) for r in got)
    whole = next(r["value"] for r in got if r["id"] == 0 and r["fullkey"] == "$")
    assert json.loads(whole) == DEEP
    each = documents.json_each(df, "doc", ["id"]).collect()
    assert {(r["id"], r["fullkey"]) for r in each} == {(0, "$.a"), (0, "$.e"), (0, "$.s"), (0, "$.z"), (2, "$"), (3, "$"), (4, "$"), (8, "$.a"), (9, "$.a")}


def test_tree_refuses_clashing_names(spark):
    with pytest.raises(ValueError):
        documents.json_tree(spark.createDataFrame([("k", "{}")], "key string, doc string"), "doc", ["key"])


def test_json_each_in_guarded_sql(spark):
    out = sql.run(spark, """SELECT t.n, j.key, j.value FROM VALUES (1, '{"a": 1, "b": [2]}'), (2, '[true]'), (3, 'no') AS t(n, doc), LATERAL json_each(t.doc) j""")
    assert {tuple(r) for r in out.collect()} == {(1, "a", "1"), (1, "b", "[2]"), (2, "0", "true")}


def test_runs_end_at_a_gap_of_their_full_length(spark):
    """seconds on the edge, equal times and rows without a time, against DuckDB."""
    rows = [("a", 0, 1), ("a", 7199, 2), ("a", 14399, 3), ("a", 21598, 4), ("a", None, 5), ("a", None, 6), ("b", 7200, 7), ("b", 0, 8), ("c", 5, 9), ("c", 5, 10), (None, 1, 11)]
    out = windows.session_runs(spark.createDataFrame(rows, "session_id string, timestamp long, event_id long"), "session_id", "timestamp", "event_id", 7200)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE sessions (session_id varchar, timestamp bigint, event_id bigint)")
    duck.executemany("INSERT INTO sessions VALUES (?, ?, ?)", rows)
    wanted = duck.execute("""WITH g AS (SELECT session_id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER w < 7200 THEN 0 ELSE 1 END AS fresh, event_id FROM sessions WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS run FROM g) SELECT session_id, min(timestamp), max(timestamp) + 7200, count(*) FROM r GROUP BY session_id, run""").fetchall()
    assert sorted(map(str, (tuple(r) for r in out.select("session_id", "first_at", "ends_at", "n").collect()))) == sorted(map(str, wanted)) and len(wanted) == 8
