"""Intermediate results of iterative operators and stored indexes, in the folder that all executors share."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of stored columns from which one task is dealt its rows.
TASK_BYTES = 2 << 20
_KEPT: dict[tuple[str, ...], tuple[str, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one in the warehouse of a local session, as in tests.

    A cluster without the setting is refused, as its executors share no folder that could be guessed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster, whose executors are processes of their own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(rows: DataFrame) -> DataFrame:
    """rows with their lineage cut: written as a table in the shared folder, once, and read again, sizes known.

    The table goes when the driver ends, or with ``discard``.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/lorespan-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(rows.schema).parquet(path)
    out.cut_at = path
    return out


def discard(rows: DataFrame) -> None:
    """Deletes a table of ``cut`` that nothing reads any more; other rows are left alone."""
    if path := vars(rows).get("cut_at"):
        files, at = _file_system(rows.sparkSession, path)
        files.delete(at, True)


def tasks(rows: DataFrame) -> int:
    """Among how many tasks to deal rows, so that what one holds does not grow with the files that they are read from."""
    spark = rows.sparkSession
    size = sum(files.getFileStatus(at).getLen() for files, at in (_file_system(spark, f) for f in rows.inputFiles()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes whenever a file below the paths is added, removed or written anew: a digest of names, lengths and times."""
    digest = hashlib.sha256()
    for path in paths:
        files, at = _file_system(spark, path)
        found, listed = [], files.listFiles(at, True) if files.exists(at) else None
        while listed is not None and listed.hasNext():
            f = listed.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        digest.update("\n".join([path, *sorted(found), ""]).encode())
    return digest.hexdigest()


def kept(spark: SparkSession, name: tuple[str, ...], make: Callable[[], DataFrame], sources: tuple[str, ...] = ()) -> DataFrame:
    """The table of this name, made and stored at its first use in the application.

    It is made anew if its own files are gone, or if those of ``sources`` are others than when it was made; it is for
    the caller to name every path that ``make`` reads.
    """
    key, state = (spark.sparkContext.applicationId, *name), fingerprint(spark, *sources)
    if key in _KEPT and _KEPT[key][0] == state:
        files, at = _file_system(spark, _KEPT[key][1] + "/_SUCCESS")
        if files.exists(at):
            return spark.read.parquet(_KEPT[key][1])
    out = cut(make())
    _KEPT[key] = state, out.cut_at  # a table before it stays as long as the driver: plans may still read it
    return out
