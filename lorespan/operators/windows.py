"""Interval joins, sliding counts and version history over time-ordered tables."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def within_seconds(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, span: int) -> DataFrame:
    """Pairs of equal ``key`` whose right time is 0 to ``span`` seconds after the left one.

    Times are put in buckets of ``span`` seconds, and a left row looks into its own and the next bucket, so the
    join is on equal keys and buckets and grows with the pairs in reach, not with a key's rows squared.
    """
    a = left.withColumn("_bucket", F.explode(F.array(F.floor(C(left_at) / span), F.floor(C(left_at) / span) + 1)))
    b = right.withColumn("_bucket", F.floor(C(right_at) / span))
    joined = a.join(b, [key, "_bucket"])
    return joined.filter(C(right_at).between(C(left_at), C(left_at) + span)).drop("_bucket")


def session_runs(rows: DataFrame, key: str, at: str, tie: str, gap: int) -> DataFrame:
    """(key, first_at, ends_at, n) of each run of a key's rows, a row less than ``gap`` seconds after the one before it.

    A row exactly ``gap`` seconds later begins a run (``session_window`` would still take it in); a row without a time
    is a run of its own.
    """
    w = Window.partitionBy(key).orderBy(C(at).asc_nulls_last(), C(tie).asc_nulls_last())
    fresh = F.when(C(at) - F.lag(at).over(w) < gap, 0).otherwise(1)
    numbered = rows.select(key, at, tie, fresh.alias("_fresh")).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_run").agg(F.min(at).alias("first_at"), (F.max(at) + gap).alias("ends_at"), F.count("*").alias("n")).drop("_run")


def effectiveness(capsules: DataFrame, follow: DataFrame) -> DataFrame:
    """Each capsule's reads, greps and edits of its file within 300 seconds, and its score.

    capsules: capsule_id, session_id, file, timestamp, tokens_served; follow: session_id, event_type, file_path, at.
    """
    near = within_seconds(capsules, follow.withColumnRenamed("timestamp", "at"), "session_id", "timestamp", "at", 300)
    count = lambda kind: F.count_if(C("event_type") == kind)
    hits = near.filter(C("file_path").contains(C("file"))).groupBy("capsule_id").agg(count("read").alias("reads"), count("grep").alias("greps"), count("edit").alias("edits"))
    zero = lambda c: F.coalesce(C(c), F.lit(0)).alias(c)
    out = capsules.join(hits, "capsule_id", "left").select(*capsules.columns, zero("reads"), zero("greps"), zero("edits"))
    score = F.lit(0.5) - 0.15 * C("reads") - 0.10 * C("greps") + F.when(C("edits") > 0, 0.3).otherwise(0.0)
    return out.withColumn("score", F.when(C("tokens_served") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))


def numbered_versions(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("version_num", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def version_changes(versions: DataFrame, key: str) -> DataFrame:
    """Each version against the one before it: significance 1.0 for another signature, 0.7 for other edges, else 0.4; the
    newest pair has distance 1."""
    w = Window.partitionBy(key).orderBy(C("version_num").desc())
    older = lambda c: F.lead(c).over(w)
    rows = versions.withColumns({"distance": F.row_number().over(w), "_sig": older("signature_hash"), "_edges": older("edges_json"), "_n": older("version_num")})
    change = F.when(C("signature_hash") != C("_sig"), 1.0).when(C("edges_json") != C("_edges"), 0.7).otherwise(0.4)
    return rows.filter(C("_n").isNotNull()).withColumn("significance", change).drop("_sig", "_edges", "_n")


#: How an aggregate of parts of a frame becomes that of the frame; null parts are those without a value.
_MERGED = {"sum": lambda parts: F.when(reduce(or_, [p.isNotNull() for p in parts]), reduce(add, [F.coalesce(p, F.lit(0)) for p in parts])), "count": lambda parts: reduce(add, parts), "min": lambda parts: F.least(*parts) if len(parts) > 1 else parts[0], "max": lambda parts: F.greatest(*parts) if len(parts) > 1 else parts[0]}


def framed(rows: DataFrame, name: str, aggregate: str, value: str, partition: list[str], order: list[Column], start: int | None, end: int | None, exclude: str | None = None) -> DataFrame:
    """Adds ``name``: sum, count, min or max of ``value`` over a GROUPS frame, less what ``exclude`` says.

    The frame goes from ``start`` to ``end`` groups of peers (rows equal in ``order``) around a row's own: negative
    before it, None without end. ``exclude``: ``current row``, ``group`` (own peers) or ``ties`` (own peers but the row).
    A group's number is its dense rank, so groups before and after are range frames over that number, and the own group is
    parted into the row and the peers on either side. Nothing is joined or subtracted, and all parts are windows within the
    partition's one shuffle. Null keys are peers of each other; a frame without a value gives null, a count of it 0.
    """
    if exclude not in (None, "current row", "group", "ties") or aggregate not in _MERGED:
        raise ValueError(f"unknown exclusion {exclude!r} or aggregate {aggregate!r}")
    low, high = Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end
    group, own = "_group_" + name, getattr(F, aggregate)(value)
    by_group = Window.partitionBy(*partition).orderBy(group)
    peers = Window.partitionBy(*partition, group).orderBy(group)
    parts = []
    if low <= 0 <= high and exclude is not None:
        if low < 0:
            parts.append(own.over(by_group.rangeBetween(low, -1)))
        if high > 0:
            parts.append(own.over(by_group.rangeBetween(1, high)))
        if exclude == "current row":
            parts += [own.over(peers.rowsBetween(Window.unboundedPreceding, -1)), own.over(peers.rowsBetween(1, Window.unboundedFollowing))]
        elif exclude == "ties":
            parts.append(F.when(C(value).isNotNull(), 1).otherwise(0).cast("long") if aggregate == "count" else C(value))
    elif low <= high:
        parts.append(own.over(by_group.rangeBetween(low, high)))
    kind = rows.select(own).schema[0].dataType
    empty = F.lit(0 if aggregate == "count" else None)
    numbered = rows.withColumn(group, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    return numbered.withColumn(name, (_MERGED[aggregate](parts) if parts else empty).cast(kind)).drop(group)
