"""Results that later steps read more than once, kept where every executor can read them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one in the warehouse of a local session (tests).

    A cluster without the setting is refused: its executors share no folder that could be guessed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def settle(rows: DataFrame) -> DataFrame:
    """Writes rows as a table in the shared folder and reads it again: the lineage ends there.

    The table goes when the driver ends, or with ``discard``.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/lorespan-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _files(spark, path, lambda files, at: files.deleteOnExit(at))
    out = spark.read.schema(rows.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``settle`` that nothing reads any more; others are left alone."""
    for rows in tables:
        if path := vars(rows).get("settled_at"):
            _files(rows.sparkSession, path, lambda files, at: files.delete(at, True))


def _files(spark: SparkSession, path: str, act: Callable) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)


def split_by_ids(rows: DataFrame, key: str, ids: DataFrame, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ids, rows whose key is not), by a bitmap of ``2**bits`` hashed keys.

    The first holds every row with a listed key, and few others until ids outnumber the bitmap; an exact join
    has to follow. The second never needs one, so its rows need no shuffle. The bitmap is broadcast as at
    most ``2**(bits - 6)`` 64-bit words, whatever the data's size.
    """
    free = max([*rows.columns, key], key=len) + "_"  # no column of rows begins so
    word_at, bit_at, bits_at = (free + n for n in ("word", "bit", "bits"))
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1 << bits))
    word = F.floor(place / 64).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))")
    words = settle(ids.select(word.alias(word_at), bit.alias(bit_at)).groupBy(word_at).agg(F.bit_or(bit_at).alias(bits_at)))
    marked = rows.withColumns({word_at: word, bit_at: bit}).join(F.broadcast(words), word_at, "left")
    hit = F.coalesce(F.col(f"`{bits_at}`").bitwiseAND(F.col(f"`{bit_at}`")) != 0, F.lit(False))
    return tuple(marked.filter(x).select(*(f"`{c}`" for c in rows.columns)) for x in (hit, ~hit))
