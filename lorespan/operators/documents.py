"""JSON texts as rows: each value of a document with its key, kind and path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.operators.storage import cut

C = F.col
_COLUMNS = ("key", "type", "value", "atom", "fullkey", "path")


def _kind(value: Column) -> Column:
    """object, array, text, integer, real, true, false or null."""
    name = F.schema_of_variant(value)
    kind = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "text").when(name == "BIGINT", "integer")
    return kind.when(name == "BOOLEAN", value.cast("string")).when(name == "VOID", "null").otherwise("real")


def _step(key: Column) -> Column:
    return F.when(key.rlike(r"^[A-Za-z][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('."'), key, F.lit('"')))


def _rows(level: DataFrame, keep: list[str]) -> DataFrame:
    text, leaf = C("_v").cast("string"), ~C("type").isin("object", "array")
    return level.select(*keep, "key", "type", F.when(C("type") != "null", text).alias("value"), F.when(leaf & (C("type") != "null"), text).alias("atom"), "fullkey", "path")


def _below(level: DataFrame, keep: list[str]) -> DataFrame:
    """The members of a level's objects and arrays."""
    at = [*keep, C("fullkey").alias("path")]
    members = level.filter("type = 'object'").select(*at, F.explode(C("_v").cast("map<string,variant>")).alias("key", "_v")).withColumn("fullkey", F.concat("path", _step(C("key"))))
    items = level.filter("type = 'array'").select(*at, F.posexplode(C("_v").cast("array<variant>")).alias("_n", "_v"))
    items = items.select(*keep, "path", C("_n").cast("string").alias("key"), "_v", F.concat(C("path"), F.lit("["), C("_n").cast("string"), F.lit("]")).alias("fullkey"))
    return members.unionByName(items).withColumn("type", _kind(C("_v")))


def _roots(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    clash = set(keep) & {*_COLUMNS, "_v", "_n"}
    if clash:
        raise ValueError(f"rename {sorted(clash)} first")
    found = rows.select(*keep, F.try_parse_json(C(text)).alias("_v")).filter(C("_v").isNotNull())
    return found.select(*keep, F.lit(None).cast("string").alias("key"), _kind(C("_v")).alias("type"), "_v", F.lit("$").alias("fullkey"), F.lit("$").alias("path"))


def json_each(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and (key, type, value, atom, fullkey, path) of each member of a document's outermost object or
    array, or of the document itself if it is neither; none for null or broken texts."""
    root = _roots(rows, text, keep)
    return _rows(_below(root, keep), keep).unionByName(_rows(root.filter("type NOT IN ('object', 'array')"), keep))


def json_tree(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """As ``json_each``, of the document and all that is nested in it, at any depth.

    One round a level of the deepest document: its objects and arrays are opened, in place and without a shuffle. Keys of
    an object's ``value`` are in order; ``atom`` is null for objects, arrays and null.
    """
    level, levels = cut(_roots(rows, text, keep)), []
    while not level.isEmpty():
        levels.append(_rows(level, keep))
        level = cut(_below(level, keep))
    return reduce(DataFrame.unionByName, levels) if levels else _rows(level, keep)
