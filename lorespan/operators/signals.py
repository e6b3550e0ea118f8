"""Behavioural signals found in logs of edits: thrashing, churn, hotspots, and the triage of sessions by them.

Windows over time are partitioned by key and time bucket, a row being context for the next bucket too, so that a
key that holds a third of all rows is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.functions import normalised_levenshtein

C = F.col
#: What a signal counts in triage, and the factors of two compounds.
WEIGHTS = {"THRASHING": 2.0, "EMPTY_CAPSULE": 2.0, "FAILED_SEARCH": 2.0, "CHURN": 1.0, "HOTSPOT": 1.0, "LARGE_BLAST_RADIUS": 1.0}
ON_HOTSPOT, WITHOUT_EFFECT = 1.5, 1.3


def _with_context(rows: DataFrame, at: str, seconds: int) -> DataFrame:
    """Each row in its own bucket of ``seconds`` and, as context, in the next."""
    own = F.floor(C(at) / seconds)
    return rows.withColumn("own_", own).withColumn("bucket_", F.explode(F.array(own, own + 1)))


def thrashing(edits: DataFrame, key: str = "node", seconds: int = 300, least: int = 3, alike: float = 0.9, pairs: int = 2) -> DataFrame:
    """The edits (``key``, timestamp, event_id, checksum) at which their key thrashes, with ``n`` and ``pairs``.

    At least ``least`` edits of the key in the last ``seconds``, this one included, and among those at least ``pairs``
    neighbours in (timestamp, event_id) whose checksums are over ``alike`` by normalised Levenshtein similarity.
    """
    rows = _with_context(edits, "timestamp", seconds)
    order = Window.partitionBy(key, "bucket_").orderBy("timestamp", "event_id")
    close = F.coalesce((normalised_levenshtein(F.lag("checksum").over(order), C("checksum")) > alike).cast("int"), F.lit(0))
    recent = Window.partitionBy(key, "bucket_").orderBy("timestamp").rangeBetween(-seconds, 0)
    rows = rows.withColumn("close_", close)
    # the first edit of a window has its neighbour outside
    first = F.min(F.struct("timestamp", "event_id", "close_")).over(recent)["close_"]
    found = rows.withColumns({"n": F.count("*").over(recent), "pairs": F.sum("close_").over(recent) - first})
    return found.filter((C("own_") == C("bucket_")) & (C("n") >= least) & (C("pairs") >= pairs)).drop("own_", "bucket_", "close_")


def crowded(rows: DataFrame, keys: list[str], seconds: int = 300, least: int = 5) -> DataFrame:
    """The rows (keys, timestamp) that are at least the ``least``-th of their keys within ``seconds``, with ``n``."""
    recent = Window.partitionBy(*keys, "bucket_").orderBy("timestamp").rangeBetween(-seconds, 0)
    found = _with_context(rows, "timestamp", seconds).withColumn("n", F.count("*").over(recent))
    return found.filter((C("own_") == C("bucket_")) & (C("n") >= least)).drop("own_", "bucket_")


def most_at_once(rows: DataFrame, key: str, member: str, seconds: int) -> DataFrame:
    """(key, most): the largest number of distinct members with a row (key, member, timestamp) within any ``seconds``.

    A member counts from a row on for ``seconds``; overlapping spans of one member are one. The count at a time is a
    running sum of spans that begin and end, by key and bucket, plus the sums of the buckets before.
    """
    own = Window.partitionBy(key, member).orderBy("timestamp")
    fresh = F.when(C("timestamp") - F.lag("timestamp").over(own) <= seconds, 0).otherwise(1)
    runs = rows.select(key, member, "timestamp").distinct().withColumn("fresh_", fresh).withColumn("run_", F.sum("fresh_").over(own))
    spans = runs.groupBy(key, member, "run_").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    turns = spans.select(key, F.inline(F.array(F.struct(C("a").alias("at"), F.lit(1).alias("by")), F.struct((C("b") + seconds + 1).alias("at"), F.lit(-1).alias("by")))))
    turns = turns.groupBy(key, "at").agg(F.sum("by").alias("by")).withColumn("bucket_", F.floor(C("at") / seconds))
    before = Window.partitionBy(key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    buckets = turns.groupBy(key, "bucket_").agg(F.sum("by").alias("total")).withColumn("held", F.coalesce(F.sum("total").over(before), F.lit(0)))
    inside = F.sum("by").over(Window.partitionBy(key, "bucket_").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("inside", inside).join(buckets.drop("total"), [key, "bucket_"]).groupBy(key).agg(F.max(C("held") + C("inside")).alias("most"))


def hotspots(churn: DataFrame, centrality: DataFrame) -> DataFrame:
    """(file_path, heat) of the files above the median in both churn (file_path, churn) and centrality (file_path, centrality)."""
    both = churn.join(centrality, "file_path")
    mid = both.agg(F.percentile("churn", 0.5).alias("c"), F.percentile("centrality", 0.5).alias("r"))  # one row
    return both.join(F.broadcast(mid), (C("churn") > C("c")) & (C("centrality") > C("r"))).select("file_path", (C("churn") * C("centrality")).alias("heat"))


def weight(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p]), kind)


def triage(found: DataFrame, hot: DataFrame) -> DataFrame:
    """(session_id, signals, triage) of signals (session_id, kind, file_path, effectiveness) and hotspots (file_path)."""
    rows = found.join(hot.select("file_path", F.lit(True).alias("hot")), "file_path", "left")
    factor = F.when((C("kind") == "THRASHING") & C("hot"), ON_HOTSPOT).when((C("kind") == "EMPTY_CAPSULE") & (C("effectiveness") == 0), WITHOUT_EFFECT).otherwise(1.0)
    return rows.groupBy("session_id").agg(F.count("*").alias("signals"), F.sum(weight(C("kind")) * factor).alias("triage"))
