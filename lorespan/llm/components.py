"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combining and joins that AQE may split, so a node with very
many neighbours is no single task's work; the number of rounds is logarithmic. Nothing but two numbers a
round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.store import discard, settle


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """pairs (x, y) in any order, repeats and loops allowed: (node, component), the component being its smallest node.

    Smallest nodes themselves have no row. No pairs give no rows.
    """
    edges = settle(pairs.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, settle(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())
        discard(old)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.settled_at = edges.settled_at
    return out
