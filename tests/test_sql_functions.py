from __future__ import annotations

import duckdb
import pytest

from lorespan import sql
from lorespan.operators.retrieval import bm25, text_index

VALUES = ["abc", "a.c", "abbc", "src/main.rs", "a\nc", "", "x^y", "a+b", "A", "m-n", "[q]", "$1", "back\\slash"]
PATTERNS = ["*", "a*c", "a?c", "a.c", "*.rs", "[a-m]*", "[!a-m]*", "src/*", "", "x^y", "a+b", "$?", "(a)", "m-n"]


def test_glob_equals_the_other_engine(spark):
    pairs = [(p, v) for p in PATTERNS for v in VALUES]
    spark.createDataFrame(pairs, "p string, v string").createOrReplaceTempView("pairs")
    found = {(r["p"], r["v"]): r["g"] for r in sql.run(spark, "SELECT p, v, glob(p, v) AS g FROM pairs").collect()}
    con = duckdb.connect()
    assert found == {(p, v): con.execute("SELECT ? GLOB ?", [v, p]).fetchone()[0] for p, v in pairs}


def test_writes_are_refused(spark):
    with pytest.raises(ValueError):
        sql.run(spark, "CREATE TEMPORARY FUNCTION f() RETURNS INT RETURN 1")


def test_full_text_in_sql_equals_the_operator(spark):
    texts = [(1, "red widget, small ring"), (2, "Réd ring"), (3, "widget red"), (4, ""), (5, None), (6, "ring " * 40 + "redder"), (7, "small small widget"), (8, "blue"), (9, "green"), (10, "grey")]
    index = text_index(spark.createDataFrame(texts, "id long, text string"), block_docs=3)
    asked = ["red", "red widget", "red_widget", "wid*", "small_ri* red", "absent", "red absent", "", "*", "  RÉD  ", "ring ring", "it's red"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    queries.createOrReplaceTempView("asked_queries")
    sql.full_text(spark, index, "search_texts")
    each = sql.run(spark, "SELECT q.qid, s.id, s.score FROM asked_queries q, LATERAL search_texts(q.query) s").collect()
    expected = {(r["qid"], r["id"]): pytest.approx(r["score"]) for r in bm25(index, queries).collect()}
    assert {(r["qid"], r["id"]): r["score"] for r in each} == expected and len(each) == len(expected) > 10
    alone = sql.run(spark, "SELECT id, score FROM search_texts('red_widget') ORDER BY score DESC").collect()
    assert [r["id"] for r in alone] == [1]
    assert not sql.run(spark, "SELECT * FROM search_texts(CAST(NULL AS STRING))").collect()


def test_full_text_names_are_checked(spark):
    index = text_index(spark.createDataFrame([], "id long, text string"))
    with pytest.raises(ValueError):
        sql.full_text(spark, index, "f() RETURNS INT")
    sql.full_text(spark, index, "search_nothing")
    assert not sql.run(spark, "SELECT * FROM search_nothing('red')").collect()
