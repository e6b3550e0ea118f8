from __future__ import annotations

import pytest

from lorespan.__main__ import arguments, run
from lorespan.api import Engine, estimate_without_index
from lorespan.config import Settings
from lorespan.operators.capsule import with_caps
from lorespan.operators.indexing import bulk_index, reindex
from lorespan.operators.retrieval import bm25, chunk_markdown
from lorespan.sources import Store
from pyspark.sql import functions as F

FILES = "file_path string, content string, mtime long"
NOTE = "id string, anchor_type string, anchor_value string, text string, tags string, kind string"


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([("src/a.py", "def main():\n    helper(1)\n", 10), ("src/b.py", "def helper(x):\n    return g(x)\n\ndef other(y):\n    return helper(y)\n", 10)], FILES)
    return bulk_index(files, rounds=5)


def test_reindexing_moves_notes_and_keeps_edges(spark, index):
    ids = {r["name"]: r["id"] for r in index.nodes.collect()}
    notes = spark.createDataFrame([("n1", "node", ids["helper"], False), ("n2", "node", ids["other"], False), ("n3", "node", ids["main"], False)], "id string, anchor_type string, anchor_value string, stale boolean")
    seen = spark.createDataFrame([("src/a.py", "def main():\n    helper(1)\n", 99), ("src/b.py", "def helper(x, z):\n    return g(x)\n", 20)], FILES)
    new, moved = reindex(index, seen, notes, rounds=5)
    now = {r["name"]: r["id"] for r in new.nodes.collect()}
    assert set(now) == {"main", "helper"} and now["main"] == ids["main"] and now["helper"] != ids["helper"]
    assert {(r["from_id"], r["to_id"]) for r in new.edges.collect()} == {(now["main"], now["helper"])}
    assert {r["id"]: (r["anchor_value"], r["stale"]) for r in moved.collect()} == {"n1": (now["helper"], False), "n2": (ids["other"], True), "n3": (ids["main"], False)}
    assert {r["file_path"]: r["last_indexed"] for r in new.files.collect()} == {"src/a.py": 10, "src/b.py": 20}


def test_engine(spark, index, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    engine = Engine(store, as_of=1000)
    store.write("nodes", index.nodes.withColumn("checksum", F.col("checksum").cast("binary")))
    store.write("edges", index.edges)
    store.write("files", index.files)
    chunks = chunk_markdown(spark.createDataFrame([("d.md", "# Helper\nhow the helper works\n# Other\nnothing")], "file_path string, content string"))
    store.write("doc_chunks", chunks)
    helper = index.nodes.filter("name = 'helper'").first()["id"]
    engine.write_annotations(spark.createDataFrame([("a", "node", helper, "mind the gap", "x,y", "pitfall"), ("b", "node", helper, "Mind  the gap", None, "odd"), ("c", None, None, "for all", "z", "odd")], NOTE))
    assert [(r["id"], r["kind"], round(r["quality"], 1)) for r in engine.read_annotations().orderBy("id").collect()] == [("a", "pitfall", 0.6), ("c", "fact", 0.5)]
    assert [r["id"] for r in engine.read_annotations(anchor_type="project").collect()] == ["c"]
    assert [r["id"] for r in engine.read_annotations(query="gap").collect()] == ["a"] and engine.read_annotations(tags="y").count() == 1
    asked = spark.createDataFrame([(1, "b.py", "helper", "helper", 4000, "detailed"), (2, "src/a.py", None, "", 4000, "standard"), (3, "no.py", "helper", "", 9, "standard")], "request_id int, file string, symbol string, query string, budget int, detail string")
    text = {r["request_id"]: r["capsule"] for r in engine.get_capsules(asked).collect()}
    assert set(text) == {1, 2}
    assert text[1].startswith("[TARGET]\ndef helper(x):\n\n[CALLERS]\n") and "[CONTEXT]\n[PITFALL] mind the gap\n[NOTE] for all" in text[1] and "[DOCUMENTATION]\n[doc: d.md > Helper]\n# Helper" in text[1]
    assert {r["id"]: r["retrieval_count"] for r in engine.read_annotations().collect()} == {"a": 1, "c": 1}
    assert text[2] == "[TARGET]\ndef main():\n\n[CALLEES]\ndef helper(x):"
    assert [r["heading"] for r in engine.search_docs(spark.createDataFrame([(0, "helper works")], "qid int, query string")).collect()] == ["Helper"]
    engine.delete_annotations(spark.createDataFrame([("a",)], "id string"))
    assert [r["id"] for r in engine.read_annotations().collect()] == ["c"]
    assert {r["table"]: r["rows"] for r in engine.status().collect()}["nodes"] == 3
    store.append("session_log", spark.createDataFrame([("abc1",), ("abd2",)], "session_id string"))
    assert engine.resolve_session("abc") == "abc1"
    with pytest.raises(ValueError):
        engine.resolve_session("ab")


def _sizes(folder) -> dict[str, int]:
    return {t: sum(1 for _ in (folder / t / "main").glob("data-*")) for t in ("nodes", "raw_edges", "edges", "ranks", "postings", "files")}


def test_reindexing_one_file_writes_its_rows_only(spark, tmp_path):
    """20 files that call each other; one changes: the store equals a new index, and the new folders hold that file's rows."""
    body = lambda i, extra="": f"def f{i}(x):\n    return f{i // 4}(x) + g(x)\n\ndef h{i}():\n    f{i // 2}(1)\n{extra}" if i else f"def f0(x):\n    return x\n\ndef h0():\n    g(1)\n{extra}"
    rows = [(f"s/{i}.py", body(i), 10) for i in range(20)]
    store = Store(spark, str(tmp_path / "db"))
    engine = Engine(store, as_of=1, settings=Settings(block_docs=4))
    engine.save_index(bulk_index(spark.createDataFrame(rows, FILES), rounds=2))
    engine.write_annotations(spark.createDataFrame([("a", "node", "none", "stays", None, "fact")], NOTE))
    touch = lambda i, text, at: engine.apply_changes(spark.createDataFrame([(f"s/{i}.py", text, at)], FILES))
    touch(3, body(3, "\ndef added(y):\n    h5()\n"), 20)  # makes ranks of all, once
    folders = {p.name for p in (tmp_path / "db").glob("*/main/data-*")}
    second = body(5, "\ndef g(x):\n    return x\n")
    touch(5, second, 30)
    new = [p for p in (tmp_path / "db").glob("*/main/data-*") if p.name not in folders]
    written = {p.parent.parent.name: spark.read.parquet(str(p)).count() for p in new}
    assert written["nodes"] == 3 and written["files"] == 1 and written["raw_edges"] <= 4 and "annotations" not in written
    assert written["edges"] <= 4 + 2 * 20  # its own, and all that call the g it brings
    rows[3], rows[5] = ("s/3.py", body(3, "\ndef added(y):\n    h5()\n"), 20), ("s/5.py", second, 30)
    whole = bulk_index(spark.createDataFrame(rows, FILES), rounds=2)
    for table, right in (("nodes", whole.nodes), ("raw_edges", whole.raw), ("edges", whole.edges), ("files", whole.files)):
        columns = [c for c in store.read(table).columns if c in right.columns and c not in ("centrality", "checksum")]
        left, right = (sorted(map(tuple, x.select(*columns).collect()), key=repr) for x in (store.read(table), right))
        assert left == right, table
    # ranks kept up equal those made from nothing
    pairs = [(r["from_id"], r["to_id"]) for r in whole.edges.collect()]
    ids = [r["id"] for r in whole.nodes.collect()]
    out = {i: [b for a, b in pairs if a == i] for i in ids}
    weight = dict.fromkeys(ids, 0.0)
    for _ in range(400):
        into = dict.fromkeys(ids, 1.0)
        for a, targets in out.items():
            for b in targets:
                into[b] += 0.85 * weight[a] / len(targets)
        weight = into
    found = {r["id"]: r["weight"] for r in store.read("ranks").collect()}
    assert set(found) == set(ids) and max(abs(found[i] - weight[i]) for i in ids) < 1e-9
    assert abs(sum(r["centrality"] for r in engine._nodes().collect()) - 1) < 1e-9
    assert written["postings"] < 0.6 * store.read("postings").count() and written["indexed"] == 3
    queries = spark.createDataFrame([(0, "f5"), (1, "added"), (2, "g x"), (3, "h*"), (4, "f3_x")], "qid int, query string")
    texts = whole.nodes.select("id", F.concat_ws(" ", "name", "signature", "docstring").alias("text"))
    scores = lambda docs: {(r["qid"], r["id"]): round(r["score"], 9) for r in bm25(docs, queries).collect()}
    assert scores(engine.symbol_index()) == scores(texts) and {q for q, _ in scores(texts)} == {0, 1, 2, 3, 4}
    best = engine.search_symbols(spark.createDataFrame([(0, "g"), (1, "absent")], "qid int, query string"), 5).collect()
    assert {r["qid"] for r in best} == {0} and [r["name"] for r in best] == ["g"]
    before = _sizes(tmp_path / "db")
    touch(5, second, 40)  # same content: nothing is written
    assert _sizes(tmp_path / "db") == before


def test_a_second_writer_of_notes_loses_nothing(spark, tmp_path, monkeypatch):
    a, b = (Engine(Store(spark, str(tmp_path / "db")), as_of=5) for _ in range(2))
    note = lambda i: spark.createDataFrame([(i, "file", "f", f"text {i}", None, "fact")], NOTE)
    a.write_annotations(note("first"))
    read, between = a.store.versioned, [lambda: b.write_annotations(note("from b"))]

    def versioned(table, branch="main"):
        found = read(table, branch)
        if between:
            between.pop()()  # b writes after a looked
        return found

    monkeypatch.setattr(a.store, "versioned", versioned)
    a.write_annotations(note("from a"))
    assert sorted(r["id"] for r in b.read_annotations().collect()) == ["first", "from a", "from b"]
    between.append(lambda: b.store.set_meta("k", "b"))
    a.store.set_meta("l", "a")
    assert (b.store.get_meta("k"), b.store.get_meta("l")) == ("b", "a")


def test_vacuum_keeps_what_recent_versions_list(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    rows = lambda *ids: spark.createDataFrame([(i, "v") for i in ids], "key string, value string")
    for i in range(4):
        store.write("daemon_meta", rows(f"k{i}"))
    store.swap("daemon_meta", rows("new"), spark.createDataFrame([("k3",)], "key string"))
    assert [r["key"] for r in store.read("daemon_meta").collect()] == ["new"]
    assert store.vacuum("daemon_meta") == 0  # all are young
    assert store.vacuum("daemon_meta", keep=1, hours=0) > 0
    assert [r["key"] for r in store.read("daemon_meta").collect()] == ["new"]


def test_command_line(spark, tmp_path):
    source = tmp_path / "src"
    (source / "out").mkdir(parents=True)
    (source / ".gitignore").write_text("# made\nout/\n*.gen.py\n")
    (source / "a.py").write_text("def main():\n    helper(1)\n")
    for name in ("out/b.py", "c.gen.py"):
        (source / name).write_text("def unseen():\n    return 1\n")
    (source / "b.py").write_text("def helper(x):\n    return x\n")
    call = lambda *words: run(spark, arguments([str(tmp_path / "db"), *words]))
    call("index", str(source))
    assert {r["table"]: r["rows"] for r in call("status").collect()}["nodes"] == 2
    capsule = call("capsule", "b.py", "--symbol", "helper", "--detail", "minimal").first()["capsule"]
    assert capsule == "[TARGET]\ndef helper(x):\n\n[CALLERS]\ndef main():"
    assert sorted(r["name"] for r in call("sql", "select name from nodes").collect()) == ["helper", "main"]
    assert [r["name"] for r in call("search", "helper").collect()] == ["helper"]
    assert [r["name"] for r in call("sql", "select name from search_symbols('help*') s join nodes using (id)").collect()] == ["helper"]
    with pytest.raises(ValueError):
        call("sql", "drop table nodes")
    assert call("switch", "dev").first()["start"] == "cold" and call("switch", "main").first()["start"] == "warm"
    call("federate", "add", "--path", str(tmp_path / "db"))
    other = Engine(Store(spark, str(tmp_path / "db2")), as_of=1)
    other.save_index(bulk_index(spark.createDataFrame([("x.py", "def helper(a, b):\n    return b\n", 5)], FILES), rounds=2))
    call("federate", "add", "--path", str(tmp_path / "db2"))
    call("federate", "remove", "--path", str(tmp_path / "db"))
    found = Engine(Store(spark, str(tmp_path / "db")), as_of=1).federated_symbols(spark.createDataFrame([(7, "helper")], "qid int, query string"), 1).collect()
    assert sorted((r["repo"].rsplit("/", 1)[-1], r["signature"]) for r in found) == [("", "def helper(x):"), ("db2", "def helper(a, b):")]
    assert call("federate", "verify").first()["reachable"] and call("federate", "list").count() == 1
    assert call("metrics").first()["capsules"] == 0 and call("docs", "helper").count() == 0 and call("effectiveness").count() == 0


def test_caps_of_a_request(spark):
    rows = spark.createDataFrame([(1, "minimal", None), (2, "detailed", 2), (3, "odd", 7)], "request_id int, detail string, max_notes int")
    out = {r["request_id"]: r["detail"] for r in with_caps(rows).collect()}
    assert (out[1]["notes"], out[2]["notes"], out[3]["notes"]) == (0, 2, 7) and (out[2]["callers"], out[3]["callers"]) == (20, 10)
    assert out[2]["body"] and not out[1]["body"]


def test_estimate(spark):
    files = spark.createDataFrame([("a", 5), ("b", 7), ("c", 11)], "file_path string, raw_token_estimate int")
    ends = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "from_file string, to_file string")
    out = estimate_without_index(files, ends, spark.createDataFrame([("a",), ("c",)], "file_path string"))
    assert {r["seed"]: r["tokens"] for r in out.collect()} == {"a": 12, "c": 18}


def test_documents_are_searched_as_last_written(spark, tmp_path):
    engine = Engine(Store(spark, str(tmp_path / "db")), as_of=1)
    asked = spark.createDataFrame([(0, "apples")], "qid int, query string")
    write = lambda *names: engine.store.write("doc_chunks", chunk_markdown(spark.createDataFrame([(n, f"# {n}\napples of {n}") for n in names], "file_path string, content string")))
    found = lambda: sorted(r["file_path"] for r in engine.search_docs(asked).collect())
    assert found() == []
    write("a.md", "b.md", "c.md")
    assert found() == ["a.md", "b.md", "c.md"]
    write("c.md", "d.md")
    assert found() == ["c.md", "d.md"]
