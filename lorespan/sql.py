"""The engine's tables as views, and a guarded way to run text queries on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lorespan import functions as fn
from lorespan.adapters import Tables
from lorespan.operators.retrieval import B, K1, TextIndex

VIEWS = ("nodes", "links", "sessions", "tokens", "capsules", "notes", "files", "markdown")
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels", "benchmark", "embeddings")
_READS = re.compile(r"^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*|\(\s*)*(select|with|explain|values|describe|show|table)\b", re.I | re.S)
_WRITES = re.compile(r"\b(insert\s+(into|overwrite)|merge\s+into|delete\s+from|truncate\s+table|create\s|drop\s|alter\s|update\s+\w+\s+set)\b", re.I)


#: ``glob(pattern, value)``: * and ? span anything, line ends too; sets in brackets, ``!`` or ``^`` first for all others.
GLOB = r"""CREATE OR REPLACE TEMPORARY FUNCTION glob(pattern STRING, value STRING) RETURNS BOOLEAN RETURN value RLIKE concat('(?s)^',
  replace(replace(replace(regexp_replace(regexp_replace(pattern, r'([.$+(){}|\\])', r'\\$1'), r'(?<!\[)\^', r'\\^'), '[!', '[^'), '*', '.*'), '?', '.'), r'\z')"""

#: ``json_each(text)``: a row for each member of the outermost object or array; none for null or broken texts.
EACH = """CREATE OR REPLACE TEMPORARY FUNCTION json_each(text STRING) RETURNS TABLE (key STRING, value STRING)
  RETURN SELECT coalesce(m.key, CAST(m.pos AS STRING)), CAST(m.value AS STRING) FROM LATERAL variant_explode(try_parse_json(text)) AS m"""


#: ``bm25(query)``: (id, score) of the documents of an index that hold all phrases of a query, as ``retrieval.bm25`` has them.
#: The query is cut by array functions; its words meet the postings' terms by equality, a prefix those of its first letter.
#: Spark puts it in place as a subquery, so that a query may be a literal or, after LATERAL, a column.
_BM25 = r"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING) RETURNS TABLE (id {id}, score DOUBLE) RETURN
WITH parts AS (SELECT filter(transform(filter(split(trim(query), '\\s+'), w -> w <> ''), w -> named_struct('terms', {terms}, 'star', endswith(w, '*'))), p -> size(p.terms) > 0) AS ps),
  each AS (SELECT size(ps) AS phrases, e.pos AS phrase, e.col.terms AS words, e.col.star AS star FROM parts, LATERAL posexplode(ps) AS e),
  asked AS (SELECT phrases, phrase, size(words) AS size, w.pos AS off, w.col AS word, star AND w.pos = size(words) - 1 AS prefix FROM each, LATERAL posexplode(words) AS w),
  met AS (
    SELECT phrases, phrase, size, off, docs FROM {postings} JOIN asked ON term = word WHERE NOT prefix UNION ALL
    SELECT phrases, phrase, size, off, docs FROM {postings} JOIN asked ON left(term, 1) = left(word, 1) AND startswith(term, word) WHERE prefix),
  spots AS (SELECT phrases, phrase, size, off, d.id, d.len, explode(d.at) AS pos FROM met, LATERAL inline(docs) AS d),
  whole AS (SELECT phrases, phrase, id, len, size, pos - off AS begins, count(DISTINCT off) AS have FROM spots GROUP BY ALL),
  freq AS (SELECT phrases, phrase, id, len, count(*) AS f FROM whole WHERE have = size GROUP BY ALL),
  held AS (SELECT phrase AS held, count(*) AS n FROM freq GROUP BY phrase),
  weighed AS (SELECT *, ln(({number} - n + 0.5D) / (n + 0.5D)) AS idf FROM freq JOIN held ON phrase = held)
SELECT id, sum(if(idf <= 0, 1e-6D, idf) * f * {k1}D / (f + {k}D * ({rest}D + {b}D * len / {mean}D))) AS score FROM weighed GROUP BY id, phrases HAVING count(*) = phrases"""


def full_text(spark: SparkSession, index: TextIndex, name: str = "bm25") -> None:
    """Makes an index callable in SQL texts of the session as ``name(query)``."""
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
        raise ValueError(f"{name!r} cannot name a function")
    index.table.createOrReplaceTempView(f"_{name}_postings")
    terms = f"regexp_extract_all(translate(lower(w), '{fn.FOLD_FROM}', '{fn.FOLD_TO}'), '[\\\\p{{L}}\\\\p{{N}}]+', 0)"
    kind = index.documents.schema["id"].dataType.simpleString()
    spark.sql(_BM25.format(name=name, id=kind, terms=terms, postings=f"_{name}_postings", number=index.number, mean=repr(float(index.mean) or 1.0), k1=K1 + 1, k=K1, b=B, rest=1 - B))


def read_only(text: str) -> bool:
    """Whether a text is one reading statement; ``WITH`` may lead to a write, so writes anywhere outside strings do not pass."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", text)
    return bool(_READS.match(bare)) and not _WRITES.search(bare) and ";" not in bare.strip().rstrip(";")


def register(spark: SparkSession, sf_dir: str) -> None:
    tables = Tables(spark, sf_dir)
    for name in VIEWS:
        getattr(tables, name).createOrReplaceTempView(name)
    for name in RAW:
        tables.raw(name).createOrReplaceTempView(name)


def run(spark: SparkSession, text: str) -> DataFrame:
    """Runs a reading statement, which may call ``glob``, ``json_each`` and what ``full_text`` made; ValueError for any other."""
    if not read_only(text):
        raise ValueError("only a single reading statement is run")
    for function in (GLOB, EACH):
        spark.sql(function)
    return spark.sql(text.strip().rstrip(";"))
