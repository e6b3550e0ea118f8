"""Symbol extraction, indexing and re-indexing of source files made from the tables, so that SQL knows what is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.adapters import Tables
from lorespan.operators import extract
from lorespan.operators.indexing import bulk_index, reindex
from lorespan.operators.storage import cut
from lorespan.plans.registry import query

C = F.col


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(rows: DataFrame) -> DataFrame:
    """rows (file_path, place, text): file_path and content, the texts in order."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "text")))
    return rows.groupBy("file_path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("content"))


def _python(t: Tables, changed: bool = False) -> DataFrame:
    """A file for each nation, a function for each supplier. Changed: every third lost a parameter, the next is gone."""
    k = C("s_suppkey")
    rows = t.raw("supplier").filter(k % 3 != 1) if changed else t.raw("supplier")
    arguments = F.when((k % 3 == 0) & F.lit(changed), "nation").otherwise("nation, weight")
    text = _text("def supply_", k, "(", arguments, '):\n    """Deliveries of ', C("s_name"), '."""\n    return helper_', k % 7, "(nation)\n\n")
    return _joined(rows.select(_text("src/nation_", C("s_nationkey"), ".py").alias("file_path"), k.alias("place"), text.alias("text")))


def _rust(t: Tables) -> DataFrame:
    """A file for each brand, a function for each part."""
    text = _text("/// A ", C("p_name"), ".\npub fn part_", C("p_partkey"), "(size: u32) -> u32 {\n    helper_", C("p_size") % 7, "(size)\n}\n\n")
    return _joined(t.raw("part").select(_text("src/", F.lower(F.replace(C("p_brand"), F.lit("#"), F.lit("_"))), ".rs").alias("file_path"), C("p_partkey").alias("place"), text.alias("text")))


def _helpers(t: Tables) -> DataFrame:
    text = _text("def helper_", C("id"), "(x):\n    return x\n\n")
    return _joined(t.spark.range(7).select(F.lit("src/helpers.py").alias("file_path"), C("id").alias("place"), text.alias("text")))


def sources(t: Tables) -> DataFrame:
    return _python(t).unionByName(_rust(t)).unionByName(_helpers(t)).withColumn("mtime", F.lit(10).cast("long"))


_SYMBOLS = """ , sym AS (SELECT 'src/nation_' || s_nationkey || '.py' AS file_path, 'python' AS language, s_suppkey AS k, 'supply_' || s_suppkey AS name, 'def supply_' || s_suppkey || '(nation, weight):' AS signature, 'Deliveries of ' || s_name || '.' AS docstring, 'helper_' || (s_suppkey % 7) AS called, 0 AS above, 2 AS below, 4 AS height FROM supplier
UNION ALL SELECT 'src/' || lower(replace(p_brand, '#', '_')) || '.rs', 'rust', p_partkey, 'part_' || p_partkey, 'pub fn part_' || p_partkey || '(size: u32) -> u32', 'A ' || p_name || '.', 'helper_' || (p_size % 7), 1, 2, 5 FROM part
UNION ALL SELECT 'src/helpers.py', 'python', k, 'helper_' || k, 'def helper_' || k || '(x):', NULL, NULL, 0, 1, 3 FROM range(7) r(k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY k) - 1 AS seq FROM sym)"""


@query("WITH" + _SYMBOLS[2:] + " SELECT file_path, language, seq, 'Function' AS kind, name, signature, docstring, seq * height + above + 1 AS line_start, seq * height + above + 1 + below AS line_end, CASE WHEN called IS NULL THEN '' ELSE called END AS calls FROM placed")
def extracted_symbols(t: Tables) -> DataFrame:
    found = extract.symbols(sources(t)).withColumn("calls", F.array_join("calls", ","))
    return found.select("file_path", "language", C("seq").cast("long").alias("seq"), "kind", "name", "signature", "docstring", C("line_start").cast("long").alias("line_start"), C("line_end").cast("long").alias("line_end"), "calls")


@query("WITH" + _SYMBOLS[2:] + """ SELECT s.file_path, s.name, h.file_path AS to_file, h.name AS to_name, md5(s.file_path || chr(0) || s.name || chr(0) || s.signature) AS from_id FROM sym s JOIN sym h ON h.name = s.called
UNION ALL SELECT 'files', count(DISTINCT file_path)::VARCHAR, 'symbols', count(*)::VARCHAR, '1.0' FROM sym""")
def bulk_indexed(t: Tables) -> DataFrame:
    """Resolved call edges of the whole index, with the numbers of its files and symbols and the sum of its ranks."""
    index = bulk_index(sources(t))
    a = index.nodes.select(C("id").alias("from_id"), "file_path", "name")
    b = index.nodes.select(C("id").alias("to_id"), C("file_path").alias("to_file"), C("name").alias("to_name"))
    edges = index.edges.join(a, "from_id").join(b, "to_id").select("file_path", "name", "to_file", "to_name", "from_id")
    total = index.nodes.agg(F.count("*").cast("string").alias("to_name"), F.round(F.sum("centrality"), 6).cast("string").alias("from_id"))
    files = index.files.agg(F.count("*").cast("string").alias("name"))
    return edges.unionByName(total.crossJoin(files).select(F.lit("files").alias("file_path"), "name", F.lit("symbols").alias("to_file"), "to_name", "from_id"))  # one row each


@query("""SELECT s_suppkey AS supplier, CASE WHEN s_nationkey >= 3 THEN false ELSE s_suppkey % 3 = 1 END AS stale,
  md5('src/nation_' || s_nationkey || '.py' || chr(0) || 'supply_' || s_suppkey || chr(0) || 'def supply_' || s_suppkey || CASE WHEN s_nationkey < 3 AND s_suppkey % 3 = 0 THEN '(nation):' ELSE '(nation, weight):' END) AS anchor_value FROM supplier""")
def reindexed_notes(t: Tables) -> DataFrame:
    """A note on each supplier's function after the files of three nations changed: it follows, goes stale or stays."""
    index = bulk_index(_python(t).unionByName(_helpers(t)).withColumn("mtime", F.lit(10).cast("long")))
    notes = cut(index.nodes.filter(C("name").startswith("supply_")).select(C("name").alias("id"), F.lit("node").alias("anchor_type"), C("id").alias("anchor_value"), F.lit(False).alias("stale")))
    files = C("file_path").isin(*(f"src/nation_{i}.py" for i in range(3)))
    _, moved = reindex(index, _python(t, changed=True).filter(files).withColumn("mtime", F.lit(20).cast("long")), notes)
    return moved.select(F.substring("id", 8, 20).cast("long").alias("supplier"), "stale", "anchor_value")
