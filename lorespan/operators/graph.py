"""Graph operators over node and edge tables: bounded traversal, ranks, detectors.

Edges are (src, dst, weight), best a stored table sorted by src. Traversals are breadth-first loops of at most
``hops`` joins, or until nothing new is found; the frontier is distributed, its lineage is cut each round, each round
reads the frontier's edges only, and hubs over the degree cap are not expanded.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lorespan.functions import jaccard, jaro_winkler, jaro_winkler_pairs, ratio
from lorespan.operators.storage import cut, discard, tasks

C = F.col


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(C("dst").alias("src"), C("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def bfs(edges: DataFrame, starts: DataFrame, hops: int | None, degree_cap: int | None = None, budget: int | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """(start, node, depth) of nodes reached from each start, itself left out; depth is the least.

    ``hops`` of None means any depth.

    A node with more than ``degree_cap`` edges (parallel ones count) is not expanded, the start included. Blocked
    nodes are neither given nor expanded. ``budget`` keeps each start's first nodes by (depth, node), one at least.
    """
    reached = starts.select("start", C("start").alias("node"), F.lit(0).alias("depth"))
    frontier = reached
    for depth in count(1) if hops is None else range(1, hops + 1):
        here = frontier.select(C("node").alias("src")).distinct()
        steps = edges.select("src", "dst").join(here, "src", "left_semi")
        if degree_cap is not None:  # counted first, so that no hub's edges are dealt
            open_ = steps.groupBy("src").agg(F.count("*").alias("degree")).filter(C("degree") <= degree_cap).select("src")
            steps = steps.join(open_, "src", "left_semi")
        steps = steps.distinct()
        if blocked is not None:
            steps = steps.join(blocked.select(C("node").alias("dst")), "dst", "left_anti")
        found = frontier.join(steps.select("src", "dst"), C("node") == C("src")).select("start", C("dst").alias("node")).distinct()
        frontier = cut(found.join(reached, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % 8 == 0:
            reached = cut(reached.repartition("start", "node"))  # a union of few checkpoints, however deep
    out = reached.filter("depth > 0")
    if budget is not None:
        first = F.row_number().over(Window.partitionBy("start").orderBy("depth", "node"))
        out = out.withColumn("_r", first).filter(C("_r") <= max(1, budget)).drop("_r")
    return out


def _ordered_union(into: DataFrame, out: DataFrame, keys: list[str], budget: int | None) -> DataFrame:
    """Nodes of either way once each, those of the way in first; of each key's the first ``budget``."""
    both = into.withColumn("side", F.lit(0)).unionByName(out.withColumn("side", F.lit(1)))
    first = both.groupBy(*keys, "node").agg(F.min(F.struct("side", "depth")).alias("m")).select(*keys, "node", "m.depth", "m.side")
    if budget is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("side", "depth", "node"))
        first = first.withColumn("place", rank).filter(C("place") <= budget)
    return first.drop("side")


def bfs_both(edges: DataFrame, starts: DataFrame, hops: int, degree_cap: int | None = None, budget: int | None = None, blocked: DataFrame | None = None, back: DataFrame | None = None) -> DataFrame:
    """Half of the budget for nodes that lead to a start, the rest for those it leads to; each node once. back: the edges turned round, where they are stored."""
    back = reversed_edges(edges) if back is None else back
    half = None if budget is None else budget // 2
    into = bfs(back, starts, hops, degree_cap, half, blocked)
    return _ordered_union(into, bfs(edges, starts, hops, degree_cap, budget, blocked), ["start"], budget).select("start", "node", "depth")


#: How far each intent looks, as (hops in, hops out, share of the budget for the way in).
INTENT_HOPS = {"debug": (3, 2, 0.5), "refactor": (0, 5, 0.0), "understand": (2, 2, 0.5), "review": (2, 2, 0.5), "extend": (0, 2, 0.0)}


def intent_traversal(edges: DataFrame, back: DataFrame, requests: DataFrame, degree_cap: int = 50, budget: int = 100, blocked: DataFrame | None = None) -> DataFrame:
    """requests (start, intent): (start, intent, node, depth, place), up to ``budget`` nodes each, those that lead to the start first."""
    requests = cut(requests.select("start", "intent"))  # few, and read once an intent
    present = {r["intent"] for r in requests.select("intent").filter(C("intent").isin(*INTENT_HOPS)).distinct().collect()}  # of five names
    none, ways = requests.select("start", F.lit("").alias("node"), F.lit(0).alias("depth"), "intent").limit(0), []
    for i in (0, 1):
        found = none
        for intent, hops in INTENT_HOPS.items():
            if hops[i] and intent in present:
                own = requests.filter(C("intent") == intent).select("start")
                most = int(budget * hops[2]) if i == 0 else budget
                found = found.unionByName(bfs((back, edges)[i], own, hops[i], degree_cap, most, blocked).withColumn("intent", F.lit(intent)))
        ways.append(found)
    return _ordered_union(*ways, ["start", "intent"], budget)


def mixed_intents(edges: DataFrame, back: DataFrame, requests: DataFrame, degree_cap: int = 50, budget: int = 100, blocked: DataFrame | None = None) -> DataFrame:
    """requests (start, primary, secondary): (start, node, place), up to ``budget`` nodes.

    With a secondary intent, six tenths of the budget go to the primary one's nodes, the rest to the others of the secondary.
    """
    requests = cut(requests.select("start", "primary", "secondary"))
    own = lambda rows, intent, most: intent_traversal(edges, back, rows.select("start", C(intent).alias("intent")), degree_cap, most, blocked).select("start", "node", "place")
    one, two = requests.filter("secondary is null"), requests.filter("secondary is not null")
    first = own(two, "primary", int(0.6 * budget))
    rest = own(two, "secondary", budget).join(first, ["start", "node"], "left_anti").withColumn("place", C("place") + budget)
    both = first.unionByName(rest).withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy("place")))
    return both.filter(C("place") <= budget).unionByName(own(one, "primary", budget))


#: Nodes whose table is small enough to be broadcast.
_FEW = 1 << 16


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 30, variant: str = "reference", parallel: bool = True) -> DataFrame:
    """(node, rank), ranks of sum 1. nodes: (node).

    ``standard``: rank = (1 - d)/n + d * (incoming + dangling/n). ``reference``: a node that v is linked from
    gives it no jump share, only every other node does; shares are then scaled to sum 1. Parallel edges count
    for out-degrees and shares; links are by distinct pair, which spares a grouping where edges are such (``parallel`` False).

    Nodes that nothing links to all have one rank, a number a round. What they pass on is added up once by the node that
    gets it, and nodes linked from them alone that link nowhere follow from these sums. A round deals ranks and partial
    sums of the edges between the others only, stores their ranks, and sends two sums to the driver. All edges are dealt
    once, to sum what a node gets if every other had one rank; what linked nodes pass on is taken off again.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    known = cut(nodes.join(degree.select(C("src").alias("node"), "deg"), "node", "left").select("node", "deg"))
    n = known.count()
    if not n or not rounds:
        return nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))

    dealt = edges.select("src", "dst").repartition(tasks(edges), "src")  # so that the pairs a task holds do not grow with the edges

    def pairs(own: DataFrame) -> DataFrame:
        return own.groupBy("src", "dst").agg(F.count("*").alias("times"), F.first("deg").alias("deg")) if parallel else own.select("src", "dst", F.lit(1).cast("long").alias("times"), "deg")

    def passed_on(rows: DataFrame, given: str, links: str) -> DataFrame:
        return rows.groupBy(C("dst").alias("node")).agg(F.sum(C("times") / C("deg")).alias(given), F.count("*").cast("double").alias(links))

    sources = known.filter("deg is not null").select(C("node").alias("src"), "deg").distinct()
    met = cut(known.join(passed_on(pairs(dealt.join(sources.hint("shuffle_hash"), "src")), "given", "links"), "node", "left"))
    discard(known)
    linked = cut(met.filter("deg is not null and links is not null").select(C("node").alias("src"), "deg").distinct())
    few = linked.count() <= _FEW  # then only their edges are dealt
    moving = cut(pairs(edges.select("src", "dst").join(F.broadcast(linked), "src") if few else dealt.join(linked.hint("shuffle_hash"), "src"))).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    ends = moving.select(C("src").alias("node")).union(moving.select(C("dst").alias("node"))).distinct().withColumn("end", F.lit(True))
    rest = lambda c: F.when(C("links") > F.coalesce("moved", F.lit(0.0)), C(c) - F.coalesce({"given": "shifted", "links": "moved"}[c], F.lit(0.0))).otherwise(0.0).alias(c)
    base = cut(met.join(passed_on(moving, "shifted", "moved"), "node", "left").join(ends, "node", "left").select("node", C("deg").isNull().alias("dangling"), C("links").isNull().alias("quiet"), rest("given"), rest("links"), C("end").isNotNull().alias("live")))
    discard(met)
    awake = cut(base.filter("live"))
    alone, leaf = C("quiet"), ~C("quiet") & ~C("live")
    of = base.agg(F.count_if(alone).alias("quiet"), F.count_if(alone & C("dangling")).alias("loose"), F.count_if(leaf).alias("leaves"), F.count_if(C("live")).alias("live"), *(F.coalesce(F.sum(F.when(leaf, C(c))), F.lit(0.0)).alias(c) for c in ("given", "links"))).first()
    ranks = awake.withColumn("raw", F.lit(1.0 / n))
    sums = F.coalesce(F.sum("raw"), F.lit(0.0)).alias("all"), F.coalesce(F.sum(F.when(C("dangling"), C("raw"))), F.lit(0.0)).alias("loose")
    state = ranks.agg(*sums).first().asDict()
    quiet, leaves, total = 1.0 / n, of["leaves"] / n, 1.0

    def raw(given, links, loose: float, tied: float, nodes: int = 1):
        """The new rank, or the sum of those of some nodes, from what they get and the ranks of what they are linked from."""
        jump = nodes * tied - links if variant == "reference" else nodes * (tied + loose)
        return damping * given + damping * loose / n * nodes + (1 - damping) / n * jump

    for _ in range(rounds):
        loose = (of["loose"] * quiet + leaves + state["loose"]) / total
        tied = ((of["quiet"] - of["loose"]) * quiet + state["all"] - state["loose"]) / total
        passed = quiet / total
        if of["live"]:
            share = moving.join(ranks.select(C("node").alias("src"), (C("raw") / total).alias("rank")), "src")
            into = share.groupBy(C("dst").alias("node")).agg(F.sum(C("rank") * C("times") / C("deg")).alias("in"), F.sum("rank").alias("linked"))
            own = raw(C("given") * passed + F.coalesce("in", F.lit(0.0)), C("links") * passed + F.coalesce("linked", F.lit(0.0)), loose, tied)
            seen = Observation()  # the sums come with the writing of the ranks
            old, ranks = ranks, cut(awake.join(into, "node", "left").select("node", "dangling", own.alias("raw")).observe(seen, *sums))
            discard(old)
            state = seen.get
        quiet, leaves = raw(0.0, 0.0, loose, tied), raw(of["given"] * passed, of["links"] * passed, loose, tied, of["leaves"])
        total = of["quiet"] * quiet + leaves + state["all"] if variant == "reference" else 1.0
    moving.unpersist()
    still = base.filter("not live").select("node", (raw(C("given") * passed, C("links") * passed, loose, tied) / total).alias("rank"))
    return still.unionByName(ranks.select("node", (C("raw") / total).alias("rank")))


def _shares(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, share): of each of the sources (src), what part of its rank an edge passes on; parallel edges count."""
    own = edges.select("src", "dst").join(sources, "src", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("times"))
    return own.join(own.groupBy("src").agg(F.sum("times").alias("deg")), "src").select("src", "dst", (C("times") / C("deg")).alias("share"))


def pushed_ranks(edges: DataFrame, ranks: DataFrame, touched: DataFrame, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """(node, weight) of the nodes whose weight differs after the edges changed; the others keep theirs.

    ranks (node, weight): of every node that exists, its weight so far, 0 if it is new. touched (node): those that are new
    or whose incoming edges, or these edges' sources' out-degrees, changed. Weights solve w = 1 + damping * (shares of
    the weights of callers), so that w over their sum is PageRank with the rank of dangling nodes given to all alike.

    Only residuals move: a touched node's is computed from its own callers, and a round adds to weights what is above
    ``tolerance`` * (1 - damping) / n and passes its damped shares on. The sum of absolute errors stays below the tolerance.
    """
    n = ranks.count()
    least = tolerance * (1 - damping) / max(n, 1)
    into = edges.select("src", "dst").join(touched.select(C("node").alias("dst")).distinct(), "dst", "left_semi")
    shares = _shares(edges, into.select("src").distinct()).join(touched.select(C("node").alias("dst")).distinct(), "dst", "left_semi")
    given = shares.join(ranks.select(C("node").alias("src"), "weight"), "src").groupBy(C("dst").alias("node")).agg(F.sum(C("share") * C("weight")).alias("given"))
    own = ranks.join(touched.select("node").distinct(), "node", "left_semi").join(given, "node", "left")
    left = cut(own.select("node", (1 + damping * F.coalesce("given", F.lit(0.0)) - C("weight")).alias("r")))
    added: list[DataFrame] = []
    total = lambda rows: rows.groupBy("node").agg(F.sum("r").alias("r"))
    while not (moving := left.filter(F.abs("r") > least)).isEmpty():
        added.append(moving)
        passed = _shares(edges, moving.select(C("node").alias("src"))).join(moving.select(C("node").alias("src"), "r"), "src")
        passed = passed.join(ranks.select(C("node").alias("dst")), "dst", "left_semi").select(C("dst").alias("node"), (damping * C("r") * C("share")).alias("r"))
        left = cut(total(left.filter(F.abs("r") <= least).unionByName(passed)))
        if len(added) == 16:
            added = [cut(total(reduce(DataFrame.unionByName, added)))]
    if not added:
        return ranks.limit(0)
    return ranks.join(total(reduce(DataFrame.unionByName, added)), "node").select("node", (C("weight") + C("r")).alias("weight"))


def reverse_index(edges: DataFrame, files: DataFrame) -> DataFrame:
    """files (node, file_path): (dst, file_path), the distinct files that hold callers of each node, a row each.

    Edges are dealt among as many tasks as their files ask for, so that a task's memory stays what it is as they grow.
    """
    n = tasks(edges)
    callers = edges.select("src", "dst").repartition(n, "src").join(files.repartition(n, "node"), C("src") == C("node"))
    return callers.select("dst", "file_path").repartition(n, "dst").distinct()


def dead_ends(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """nodes (node, ...) without a caller that is not a test (tests: node)."""
    called = edges.join(tests.select(C("node").alias("src")), "src", "left_anti").select(C("dst").alias("node"))
    return nodes.join(called, "node", "left_anti")


def neighbourhood(nodes: DataFrame, edges: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """Of each name (names: name) the first symbol by file and key, with up to ``most`` callers and callees by name and key.

    nodes: key, name, file_path. Gives name, key, side (``caller`` or ``callee``), place, other, other_name.
    """
    first = nodes.join(names, "name", "left_semi").groupBy("name").agg(F.min(F.struct("file_path", "key")).alias("m")).select("name", C("m.key").alias("key"))
    out = None
    for side, mine, other in (("caller", "dst", "src"), ("callee", "src", "dst")):
        near = first.join(edges.select(C(mine).alias("key"), C(other).alias("other")).distinct(), "key")
        near = near.join(nodes.select(C("key").alias("other"), C("name").alias("other_name")), "other")
        place = F.row_number().over(Window.partitionBy("name").orderBy("other_name", "other"))
        near = near.withColumn("place", place).filter(C("place") <= most).select("name", "key", F.lit(side).alias("side"), "place", "other", "other_name")
        out = near if out is None else out.unionByName(near)
    return out


def with_edges(edges: DataFrame, added: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges and those ``added`` whose ends are both nodes (node); equal pairs of a kind become one with the later weight."""
    for end in ("src", "dst"):
        added = added.join(nodes.select(C("node").alias(end)), end, "left_semi")
    keys = [c for c in edges.columns if c in ("src", "dst", "kind")]
    return edges.join(added.select(*keys).distinct(), keys, "left_anti").unionByName(added.select(*edges.columns))


def without_nodes(edges: DataFrame, gone: DataFrame, out_edges_only: bool = False) -> DataFrame:
    """edges less those of the nodes ``gone`` (node): all of them, or only those that leave them."""
    left = edges.join(gone.select(C("node").alias("src")), "src", "left_anti")
    return (left if out_edges_only else left.join(gone.select(C("node").alias("dst")), "dst", "left_anti")).select(*edges.columns)


def affected_files(edges: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """Other files with a caller of a node of each changed file: (changed, file_path)."""
    own = files.join(changed, "file_path", "left_semi").select(C("file_path").alias("changed"), C("node").alias("dst"))
    return edges.select("src", "dst").join(own, "dst").join(files, C("src") == C("node")).filter("file_path <> changed").select("changed", "file_path").distinct()


def closes_cycle(edges: DataFrame, added: DataFrame, hops: int | None = None, back: DataFrame | None = None) -> DataFrame:
    """added (src, dst): those whose dst already leads back to src, within ``hops`` if given.

    Searched from both ends, forwards from dst and backwards from src, at each hop where the frontiers together are the
    smaller. An edge leaves the search when its two reaches meet or one of them is exhausted, so the rows of a hop are
    those of undecided edges only.
    """
    back = reversed_edges(edges) if back is None else back
    pairs = cut(added.select("src", "dst").distinct())
    sides, key = {"dst": edges, "src": back}, ["src", "dst"]
    reached = {s: pairs.filter("src <> dst").select(*key, C(s).alias("node")) for s in sides}
    frontier, size, closed = dict(reached), dict.fromkeys(sides, 0), pairs.filter("src = dst")
    for walked in count() if hops is None else range(hops):
        side = min(size, key=size.get)
        other = "src" if side == "dst" else "dst"
        here = frontier[side].select(C("node").alias("_at")).distinct()
        steps = sides[side].select(C("src").alias("_at"), C("dst").alias("_next")).join(here, "_at", "left_semi").distinct()
        found = frontier[side].join(steps, C("node") == C("_at")).select(*key, C("_next").alias("node")).distinct()
        found = cut(found.join(reached[side], [*key, "node"], "left_anti"))
        size[side] = found.count()
        if not size[side]:
            break
        met = cut(found.join(reached[other], [*key, "node"], "left_semi").select(*key).distinct())
        open_ = found.select(*key).distinct().join(met, key, "left_anti")  # the others met, or have nothing new on this side
        closed = closed.unionByName(met)
        reached[side] = reached[side].unionByName(found)
        frontier = {side: found.join(met, key, "left_anti"), other: frontier[other].join(open_, key, "left_semi")}
        if walked % 8 == 7:  # plans stay short, and hold undecided edges only
            frontier = {s: cut(rows) for s, rows in frontier.items()}
            reached = {s: cut(rows.join(open_, key, "left_semi")) for s, rows in reached.items()}
    return added.join(cut(closed.distinct()), key, "left_semi").distinct()


def saturated_reach(edges: DataFrame, starts: DataFrame, most: int, hops: int | None = None) -> DataFrame:
    """(start, visited): nodes reached from each start, itself counted, or ``most`` + 1 where there are more.

    A start with more than ``most`` nodes leaves the search within four hops, and a hop keeps at most ``most`` + 1 new ones
    and as many neighbours of a node: these already tell. So the rows of a hop are bounded by the number of starts.
    """
    reached = cut(starts.select("start", C("start").alias("node")).distinct())
    frontier, done = reached, starts.select("start").limit(0)
    first = lambda by, order: F.row_number().over(Window.partitionBy(by).orderBy(order)) <= most + 1
    for depth in count(1) if hops is None else range(1, hops + 1):
        here = frontier.select(C("node").alias("src")).distinct()
        steps = edges.select("src", "dst").join(here, "src", "left_semi").distinct().withColumn("_f", first("src", "dst")).filter("_f")
        found = frontier.join(steps, C("node") == C("src")).select("start", C("dst").alias("node")).distinct().join(reached, ["start", "node"], "left_anti")
        frontier = cut(found.withColumn("_f", first("start", "node")).filter("_f").drop("_f"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % 4 == 0 or depth == 1:
            full = cut(reached.groupBy("start").count().filter(C("count") > most).select("start"))
            done = done.unionByName(full)
            reached = cut(reached.join(full, "start", "left_anti"))
            frontier = frontier.join(full, "start", "left_anti")
    out = reached.groupBy("start").agg(F.least(F.count("*"), F.lit(most + 1).cast("long")).alias("visited"))
    return out.unionByName(done.select("start", F.lit(most + 1).cast("long").alias("visited")))


def blast_radius(edges: DataFrame, starts: DataFrame, direct: int = 20, reach: int = 50, hops: int | None = None, back: DataFrame | None = None, count_all: bool = False) -> DataFrame:
    """(start, callers, visited, large): more than ``direct`` callers, or more than ``reach`` nodes lead to it, itself counted.

    At any depth unless ``hops`` is given. ``count_all``: ``visited`` counts every such node; without, no further than
    ``reach`` + 1, where the verdict stands.
    """
    own = edges.select("src", C("dst").alias("start")).join(starts.select("start").distinct(), "start", "left_semi")
    callers = own.distinct().groupBy("start").agg(F.count("*").alias("callers"))
    back = reversed_edges(edges) if back is None else back
    if count_all:
        seen = bfs(back, starts.select("start").distinct(), hops).groupBy("start").agg((F.count("*") + 1).alias("visited"))
    else:
        seen = saturated_reach(back, starts, reach, hops)
    out = starts.join(callers, "start", "left").join(seen, "start", "left").na.fill({"callers": 0, "visited": 1})
    return out.withColumn("large", (C("callers") > direct) | (C("visited") > reach))


def without_callers(nodes: DataFrame, edges: DataFrame, callers: DataFrame) -> DataFrame:
    """nodes (node, ...) that none of ``callers`` (node) calls."""
    called = edges.join(callers.select(C("node").alias("src")), "src", "left_semi").select(C("dst").alias("node"))
    return nodes.join(called, "node", "left_anti")


def symbol_similarity(pairs: DataFrame) -> DataFrame:
    """Adds ``score`` to pairs with old_/new_ name, signature, checksum, neighbours (arrays) and same_file (0/1)."""
    rows = pairs.withColumns({"_jw": jaro_winkler("old_name", "new_name"), "_sig": signature_similarity("old_signature", "new_signature")})
    body = F.when(C("old_checksum") == C("new_checksum"), 1.0).otherwise(0.0)
    score = C("_jw") * 0.3 + C("_sig") * 0.25 + body * 0.25 + jaccard(C("old_neighbours"), C("new_neighbours")) * 0.15 + C("same_file") * 0.05
    return rows.withColumn("score", score).drop("_jw", "_sig")


def _shape(signature: str) -> Column:
    """All of a signature that ``signature_similarity`` looks at: the text itself counts only without parameters."""
    given = parameters(signature)
    return F.to_json(F.struct(given.alias("p"), returned(signature).alias("r"), F.when(F.size(given) == 0, C(signature)).alias("t")))


def _alike(sides: dict[str, DataFrame], group: list[str], text: str, key: str, score) -> DataFrame:
    """(old_key, new_key, score) of each two distinct keys that meet in a group, from a text of each."""
    own = {s: rows.groupBy(*group, f"{s}_{key}").agg(F.min(f"{s}_{text}").alias(f"_{s}")) for s, rows in sides.items()}
    met = own["old"].join(own["new"], group).groupBy(f"old_{key}", f"new_{key}").agg(F.min("_old").alias("_old"), F.min("_new").alias("_new"))
    return cut(met.select(f"old_{key}", f"new_{key}", score("_old", "_new").alias(f"_{key}_score")))


#: Groups of up to this many pairs are joined; of larger ones, so many symbols of either side are dealt to a task at once.
_JOINED, _SLICE = 1 << 11, 1 << 11
#: Pairs that one task makes, of several groups or parts of them.
_TASK_PAIRS = 1 << 26


def group_similarity(old: DataFrame, new: DataFrame, group: list[str], same_file: Column, digits: int | None = None, named: bool = True) -> DataFrame:
    """(group, old_id, new_id, score): ``symbol_similarity`` of all old with all new symbols of a group.

    old, new: group columns and those of ``symbol_similarity`` with old_ or new_ before them. ``same_file`` looks at
    old_file_path and new_file_path alone. ``digits`` rounds scores as ``_half_up``; without ``named`` the group's columns are
    left out.
    Small groups are joined. In larger ones a task takes a slice of either side and makes their pairs as arrays: symbols are
    dealt once for each slice that they meet, pairs never, and what a task holds does not grow with a group.
    """

    def prepared(rows: DataFrame, side: str) -> DataFrame:
        near, path = f"{side}_neighbours", f"{side}_file_path"
        rows = rows.dropna(subset=group).withColumns({f"{side}_shape": _shape(f"{side}_signature")})
        return cut(rows if path in rows.columns else rows.withColumn(path, F.lit("")))

    sides = {"old": prepared(old, "old"), "new": prepared(new, "new")}
    many = [rows.groupBy(*group).agg(F.count("*").alias(f"_{s}s")) for s, rows in sides.items()]
    pairs = C("_olds").cast("double") * C("_news")
    sizes = cut(many[0].join(many[1], group).select(*group, "_olds", "_news", (pairs > _JOINED).alias("_large")))
    joined, made = sizes.agg(F.count_if(~C("_large")), F.sum(F.when(C("_large"), pairs))).first()
    columns, out = [*(group if named else []), "old_id", "new_id", "score"], []
    if joined or not made:
        own = {s: rows.join(sizes.filter("not _large").select(*group), group, "left_semi") for s, rows in sides.items()} if made else sides
        scored = _joined(own, group, same_file)
        scaled = C("score") * 10.0 ** (digits or 0)
        up = F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)
        out.append((scored if digits is None else scored.withColumn("score", up / F.lit(10.0**digits))).select(columns))
    if made:
        out.append(_sliced(sides, sizes.filter("_large").drop("_large"), group, same_file, digits, named, math.ceil(made / _TASK_PAIRS)))
    return reduce(DataFrame.unionByName, out)


def _joined(sides: dict[str, DataFrame], group: list[str], same_file: Column) -> DataFrame:
    """Scores of all pairs by joins.

    Each two names and each two kinds of signature are compared once, in tables that are small where symbols are alike and
    then broadcast. What is left for each pair is to look them up and to count its common neighbours, if the ranges of both
    lists overlap at all.
    """

    def ranged(rows: DataFrame, side: str) -> DataFrame:
        near = f"{side}_neighbours"
        low, high = (F.when(~F.exists(near, F.isnull), f(near)) for f in (F.array_min, F.array_max))  # a null may be common, too
        return rows.drop(f"{side}_signature").withColumns({f"{side}_size": F.size(F.array_distinct(near)), f"{side}_low": low, f"{side}_high": high})

    pairs = ranged(sides["old"], "old").join(ranged(sides["new"], "new"), group)
    for key, table in (("name", _alike(sides, group, "name", "name", jaro_winkler)), ("shape", _alike(sides, group, "signature", "shape", signature_similarity))):
        a, b = (table[f"{s}_{key}"] for s in ("old", "new"))
        pairs = pairs.join(table, pairs[f"old_{key}"].eqNullSafe(a) & pairs[f"new_{key}"].eqNullSafe(b)).drop(a, b)
    apart = (C("old_high") < C("new_low")) | (C("new_high") < C("old_low"))
    common = F.when(apart, 0).otherwise(F.size(F.array_intersect("old_neighbours", "new_neighbours")))
    near = F.when(common == 0, 0.0).otherwise(ratio(common, C("old_size") + C("new_size") - common))
    body = F.when(C("old_checksum") == C("new_checksum"), 1.0).otherwise(0.0)
    score = C("_name_score") * NAME + C("_shape_score") * SIGNATURE + body * BODY + near * NEAR + same_file * 0.05
    return pairs.select(*group, "old_id", "new_id", score.alias("score"))


def _sliced(sides: dict[str, DataFrame], sizes: DataFrame, group: list[str], same_file: Column, digits: int | None, named: bool, least_tasks: int) -> DataFrame:
    """Scores of all pairs of the groups in sizes (group, _olds, _news), a slice of old symbols against one of new ones at a time."""
    slices = {s: F.ceil(C(f"_{s}s") / _SLICE).cast("int") for s in sides}
    keys, dealt = {"old": "_old_slice", "new": "_new_slice"}, {}
    for side, other in (("old", "new"), ("new", "old")):
        own = F.pmod(F.xxhash64(f"{side}_id"), slices[side]).cast("int")
        met = F.explode(F.sequence(F.lit(0), slices[other] - 1))
        dealt[side] = sides[side].join(sizes, group).withColumn(keys[side], own).withColumn(keys[other], met)
    both, old, new = _dealt(dealt, [*group, *keys.values()], same_file, least_tasks)
    schema = StructType([*(old.schema[c] for c in group if named), old.schema["old_id"], new.schema["new_id"], StructField("score", DoubleType())])
    return both.applyInArrow(_all_scored(group if named else [], schema, digits), schema)


def parameters(signature: str) -> Column:
    """Names between the first opening and the last closing bracket, before their colons; receivers left out."""
    inner = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    name = lambda p: F.regexp_extract(F.trim(F.split_part(F.trim(p), F.lit(":"), F.lit(1))), r"(\S+)$", 1)
    return F.array_distinct(F.filter(F.transform(F.split(inner, ","), name), lambda x: ~x.isin("", "self", "&self")))


def returned(signature: str) -> Column:
    """What follows the last arrow, else a colon after the last bracket; null without either."""
    arrow = F.trim(F.regexp_extract(signature, r"(?s)^.*->(.*)$", 1))
    colon = F.trim(F.regexp_extract(signature, r"(?s)^.*\)\s*:([^)]*)$", 1))
    return F.when(arrow != "", arrow).when(colon != "", colon)


def signature_similarity(old: str, new: str) -> Column:
    a, b = parameters(old), parameters(new)
    x, y = returned(old), returned(new)
    same = F.when(x.isNull() & y.isNull(), 1.0).when(x.isNull() | y.isNull(), 0.0).otherwise(jaro_winkler(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), jaro_winkler(old, new)).otherwise(jaccard(a, b) * 0.6 + same * 0.4)


def _taken_in_order(group: list[str], schema: StructType):
    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        olds, news, keep = set(), set(), []
        for i, (old, new) in enumerate(zip(pairs["old_id"].tolist(), pairs["new_id"].tolist(), strict=True)):
            if old not in olds and new not in news:
                olds.add(old)
                news.add(new)
                keep.append(i)
        return pairs.iloc[keep][schema.names]

    return lambda pairs: run(pairs.sort_values("_place"))


def greedy_matching(scored: DataFrame, group: list[str], head: int = 1 << 16) -> DataFrame:
    """One-to-one pairs, best score first; ties by old, then new id. scored: group columns, old_id, new_id, score.

    A round takes the first ``head`` pairs of every group, in order, one after another, each where both its ends are free:
    what a walk over the whole group would do with them. Their losers conflict with a taken pair, so what is left are
    later pairs of free ends, and no group is gathered beyond its head. Ties and chains of any length end: every round
    settles a group's whole head. Pairs without a group match nothing.
    """
    columns = [*group, "old_id", "new_id", "score"]
    left, taken = cut(scored.select(*columns).dropna(subset=group)), []
    place = F.row_number().over(Window.partitionBy(*group).orderBy(C("score").desc(), "old_id", "new_id"))
    schema = left.schema
    while True:
        more = not left.groupBy(*group).count().filter(C("count") > head).isEmpty()
        first = left.withColumn("_place", place).filter(C("_place") <= head)
        found = cut(first.groupBy(*group).applyInPandas(_taken_in_order(group, schema), schema))
        taken.append(found)
        if not more:
            return reduce(DataFrame.unionByName, taken)
        free = left
        for end in ("old_id", "new_id"):
            free = free.join(found.select(*group, end), [*group, end], "left_anti")
        old, left = left, cut(free.select(*columns))
        discard(old)


#: Scores at which a large matching stops to take pairs; the shares below are those of ``symbol_similarity``.
BANDS = (0.9, 0.8, 0.75, 0.7, 0.65)
NAME, SIGNATURE, BODY, NEAR = 0.3, 0.25, 0.25, 0.15
_SLACK = 1e-9


def _rare_first(rows: DataFrame, counts: DataFrame, group: list[str], side: str) -> DataFrame:
    """A row for each neighbour of each symbol: its place by rarity among the symbol's own, and how many those are."""
    each = rows.select(*group, f"{side}_id", F.explode(F.array_distinct(f"{side}_neighbours")).alias("_token")).join(counts, [*group, "_token"])
    own = Window.partitionBy(*group, f"{side}_id")
    return each.withColumns({"_place": F.row_number().over(own.orderBy("_often", "_token")), "_own": F.count("*").over(own)}).drop("_often")


def _first(size: Column, share: float) -> Column:
    """How many members of a set, in a common order, meet those of any set of at least this Jaccard similarity."""
    return F.least(size, size - F.ceil(size * share - _SLACK) + 1)


def similar_candidates(old: DataFrame, new: DataFrame, group: list[str], floor: float) -> DataFrame:
    """(group, old_id, new_id): all pairs of a group that may score over ``floor``, without comparing all.

    A pair over the floor can lose only so much on names, signatures, bodies and neighbours. Bodies are equal or the loss
    has room for them; likewise either neighbours are shared, as many as the rest of the loss leaves, and then pairs meet at
    their rarest ones, or it has room for none. As far as the signatures bind, pairs also meet at a parameter.
    """
    sides = {"old": old, "new": new}
    each = reduce(DataFrame.unionByName, [rows.select(*group, F.explode(F.array_distinct(f"{s}_neighbours")).alias("_token")) for s, rows in sides.items()])
    counts = each.groupBy(*group, "_token").agg(F.count("*").alias("_often"))
    near = {s: cut(_rare_first(rows, counts, group, s)) for s, rows in sides.items()}
    found = []

    def meet(left: float, same_body: bool, share: float | None) -> None:
        signature, keyed = 1 - left / SIGNATURE, []
        for side, rows in sides.items():
            given = F.array_sort(parameters(f"{side}_signature"))
            some = F.slice(given, 1, F.greatest(F.lit(1), _first(F.size(given), max(0.0, (signature - 0.4) / 0.6)).cast("int")))
            at = F.when(F.size(given) > 0, some).otherwise(F.array(F.lit(""))) if signature > 0.4 else F.array(F.lit(""))
            body = C(f"{side}_checksum") if same_body else F.lit("")
            # without room for any loss on names they are equal: unlike ones of n characters lose 1 / (5 n) or more
            name = C(f"{side}_name") if left < 10 * _SLACK else F.lit("")
            rows = rows.select(*group, f"{side}_id", body.alias("_body"), name.alias("_name"), F.explode(at).alias("_at"))
            if share is not None:
                rows = rows.join(near[side].filter(C("_place") <= _first(C("_own"), share)).select(*group, f"{side}_id", "_token"), [*group, f"{side}_id"])
            keyed.append(rows)
        keys = [*group, "_body", "_name", "_at", *(["_token"] if share is not None else [])]
        found.append(keyed[0].join(keyed[1], keys).select(*group, "old_id", "new_id"))

    for same_body in (True, False):
        left = 1 - floor - (0 if same_body else BODY) + _SLACK
        if left > 0:
            meet(left, same_body, max(0.0, 1 - left / NEAR))
        if left - NEAR > 0:
            meet(left - NEAR, same_body, None)
    return reduce(DataFrame.unionByName, found).distinct()


def _at_most(pairs: DataFrame) -> Column:
    """What a pair can score at most, from lengths and sets alone."""
    short, long = (f(F.length("old_name"), F.length("new_name")) for f in (F.least, F.greatest))
    jaro = (F.coalesce(F.try_divide(short, long), F.lit(1.0)) + 2) / 3
    a, b = parameters("old_signature"), parameters("new_signature")
    one = returned("old_signature").isNull() != returned("new_signature").isNull()
    signature = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(jaccard(a, b) * 0.6 + F.when(one, 0.0).otherwise(0.4))
    body = F.when(C("old_checksum") == C("new_checksum"), BODY).otherwise(0.0)
    return (jaro + (1 - jaro) * 0.4) * NAME + signature * SIGNATURE + body + jaccard(C("old_neighbours"), C("new_neighbours")) * NEAR + C("same_file") * 0.05


#: A group is walked whole in one task up to this many symbols, and this many pairs of distinct names, signatures and files.
_WALKED, _KINDS = 1 << 16, 1 << 22


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: half up in decimals, which the product tells but for the neighbourhood of a half."""
    scaled = x * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    half = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4
    values, of = np.unique(x[half], return_inverse=True)
    out[half] = np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values.tolist()], np.float64)[of]
    return out


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As DuckDB rounds: the product as it is in doubles, a half of it up."""
    scaled = x * 10.0**digits
    low = np.floor(scaled)
    return (low + (scaled - low >= 0.5)) / 10.0**digits


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """(codes, distinct values), null being a value."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _names_alike(old: list, new: list) -> np.ndarray:
    out = np.full((len(old), len(new)), np.nan)
    known = [j for j, b in enumerate(new) if b is not None]
    step = max(1, (1 << 12) // max(1, len(known)))
    rows = [i for i, a in enumerate(old) if a is not None]
    for k in range(0, len(rows) if known else 0, step):
        some = rows[k : k + step]
        out[np.ix_(some, known)] = jaro_winkler_pairs([old[i] for i in some for _ in known], [new[j] for j in known] * len(some)).reshape(len(some), -1)
    return out


def _shapes_alike(old: list[str], new: list[str]) -> np.ndarray:
    """``signature_similarity`` of each two shapes."""
    left, right = [json.loads(a) for a in old], [json.loads(b) for b in new]

    def alike(part: str) -> np.ndarray:
        a, b = ([x.get(part) for x in rows] for rows in (left, right))
        own, others = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        p, q = ({x: i for i, x in enumerate(xs)} for xs in (own, others))
        return _names_alike(own, others)[[p[x] for x in a]][:, [q[x] for x in b]]

    given = [pa.chunked_array([pa.array([x.get("p") for x in rows], pa.list_(pa.string()))]) for rows in (left, right)]
    common, size, sizes = _common(*given)
    shared = np.zeros((len(left), len(right)), np.int64)
    np.put(shared, *common(0, len(left)))
    either = size[:, None] + sizes - shared
    x, y = (np.array([x.get("r") is None for x in rows], bool) for rows in (left, right))
    same = np.where(x[:, None] & y, 1.0, np.where(x[:, None] | y, 0.0, alike("r")))
    out = np.where(either == 0, 0.0, shared / np.maximum(either, 1)) * 0.6 + same * 0.4
    bare = (size == 0)[:, None] & (sizes == 0)
    out = np.where(bare, alike("t"), out) if bare.any() else out
    for rows, axis in ((left, 0), (right, 1)):
        unknown = [i for i, x in enumerate(rows) if "p" not in x]
        out[unknown if axis == 0 else (slice(None), unknown)] = np.nan
    return out


def _tokens_by_row(old: pa.ChunkedArray, new: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of either side (row, code of a neighbour), each distinct pair once, in order."""
    lists = [c.combine_chunks() for c in (old, new)]
    values = pa.chunked_array([x.flatten() for x in lists]).combine_chunks()
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out, at = [], 0
    for x in lists:
        lengths = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = codes[at : at + lengths.sum()]
        at += lengths.sum()
        width = int(codes.max(initial=0)) + 1
        pairs = np.unique(np.repeat(np.arange(len(x)), lengths) * width + own)
        out.append((pairs // width, pairs % width))
    return out


def _common(old: pa.ChunkedArray, new: pa.ChunkedArray):
    """(counts, sizes of the old lists, of the new ones); ``counts(k, n)`` tells of n old lists from k on which pairs share values, and how many."""
    (r, held), (s, token) = _tokens_by_row(old, new)
    m = len(new)
    order = np.argsort(token, kind="stable")
    row, token = s[order], token[order]
    starts, ends = np.searchsorted(token, held, "left"), np.searchsorted(token, held, "right")

    def counts(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(*np.searchsorted(r, (k, k + n)))
        met = ends[own] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(met) + met, met) + np.arange(met.sum())
        pairs = np.repeat(r[own] - k, met) * m + row[at]
        if len(pairs) < n * m >> 4:
            return np.unique(pairs, return_counts=True)
        often = np.bincount(pairs, minlength=n * m)
        found = np.flatnonzero(often)
        return found, often[found]

    return counts, np.bincount(r, minlength=len(old)), np.bincount(s, minlength=m)


def _kinds(*codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of each row's kind, the codes of each kind); rows of the same codes are of a kind."""
    number = np.zeros(len(codes[0]), np.int64)
    for c in codes:
        number = np.unique(number * (int(c.max(initial=0)) + 2) + c + 1, return_inverse=True)[1]
    first = np.unique(number, return_index=True)[1]
    return number, [c[first] for c in codes]


def _scores(old: pa.Table, new: pa.Table, rounded: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rounded scores with all new symbols) of a few old ones at a time; nan where unknown.

    Symbols of equal names, shapes, bodies and files are of a kind. Each two kinds are scored once, and what is left are the
    pairs that share neighbours.
    """
    m = len(new)
    (a, names), (b, others) = _coded(old["old_name"]), _coded(new["new_name"])
    (p, shapes), (q, into) = _coded(old["old_shape"]), _coded(new["new_shape"])
    checksums = [t.select([c]).rename_columns(["checksum"]) for t, c in ((old, "old_checksum"), (new, "new_checksum"))]
    bodies, texts = _coded(pa.concat_tables(checksums, promote_options="permissive")["checksum"])  # one may be binary, one text
    bodies = np.where(np.array([x is None for x in texts])[bodies], -1, bodies)
    (f, _), (h, files) = _coded(old["old_file_path"]), _coded(new["new_file_path"])
    by_file, place = np.zeros((int(f.max()) + 1, len(files))), {x: j for j, x in enumerate(files)}
    for i in np.unique(f, return_index=True)[1].tolist():
        for x in old["_homes"][i].as_py() or []:
            by_file[f[i], place[x["path"]]] = np.nan if x["same"] is None else x["same"]
    left, (a, p, body, f) = _kinds(a, p, bodies[: len(a)], f)
    right, (b, q, like, h) = _kinds(b, q, bodies[len(left) :], h)
    own = _names_alike(names, others)[a][:, b] * NAME + _shapes_alike(shapes, into)[p][:, q] * SIGNATURE + np.where((body[:, None] == like) & (like >= 0), 1.0, 0.0) * BODY
    home = by_file[f][:, h] * 0.05
    apart = rounded(own + home)
    common, size, sizes = _common(old["old_neighbours"], new["new_neighbours"])
    unknown = [t[c].is_null().to_numpy() for t, c in ((old, "old_neighbours"), (new, "new_neighbours"))]
    step = max(1, (1 << 18) // m)
    for k in range(0, len(left), step):
        n = min(step, len(left) - k)
        score = np.take(apart[left[k : k + n]], right, axis=1)
        at, shared = common(k, n)
        i, j = np.divmod(at, m)
        x, y = left[k + i], right[j]
        score[i, j] = rounded(own[x, y] + shared / (size[k + i] + sizes[j] - shared) * NEAR + home[x, y])
        score[unknown[0][k : k + n]] = np.nan
        score[:, unknown[1]] = np.nan
        yield k, score


def _all_scored(group: list[str], schema: StructType, digits: int | None):
    """All pairs of a slice of either side."""
    target = to_arrow_schema(schema)

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        if not old.num_rows or not new.num_rows:
            return target.empty_table()
        found, m = [], new.num_rows
        for k, score in _scores(old, new, lambda x: x if digits is None else _half_up(x, digits)):
            n = len(score)
            left, right, value = pa.array(np.repeat(np.arange(k, k + n), m)), pa.array(np.tile(np.arange(m), n)), score.ravel()
            unknown = np.isnan(value)
            columns = [*(old[c].take(left) for c in (*group, "old_id")), new["new_id"].take(right), pa.array(value, mask=unknown if unknown.any() else None)]
            found.append(pa.Table.from_arrays(columns, names=target.names).cast(target))
        return pa.concat_tables(found)

    return run


def _walk(group: list[str], schema: StructType, least: float, digits: int | None):
    """The whole greedy walk of a group: old symbols by id, a few rows of scores at a time, of which those over ``least`` stay."""
    target = to_arrow_schema(schema)

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        if not old.num_rows or not new.num_rows:
            return target.empty_table()
        old, new = old.sort_by("old_id"), new.sort_by("new_id")
        m, found, scores = new.num_rows, [], []
        for k, score in _scores(old, new, lambda x: x if digits is None else _rounded(x, digits)):
            here = np.flatnonzero(score.ravel() > least)
            found.append(here + k * m)
            scores.append(score.ravel()[here])
        pairs, score = np.concatenate(found), np.concatenate(scores)
        order = np.argsort(-score, kind="stable")
        olds, news, keep = bytearray(old.num_rows), bytearray(m), []
        for part in range(0, len(order), 1 << 16):
            some = pairs[order[part : part + (1 << 16)]]
            for i, (x, y) in enumerate(zip((some // m).tolist(), (some % m).tolist(), strict=True), part):
                if not olds[x] and not news[y]:
                    olds[x] = news[y] = 1
                    keep.append(i)
        won = order[keep] if keep else order[:0]
        left, right = old.take(pa.array(pairs[won] // m)), new.take(pa.array(pairs[won] % m))
        return pa.Table.from_arrays([*(left[c] for c in group), left["old_id"], right["new_id"], pa.array(score[won])], names=target.names).cast(target)

    return run


def _dealt(sides: dict[str, DataFrame], group: list[str], same_file: Column, least_tasks: int = 1) -> tuple[PandasCogroupedOps, DataFrame, DataFrame]:
    """(both sides by group, old, new) with what ``_scores`` reads: each symbol is dealt once.

    Old symbols bring what ``same_file`` says of their file and those of their group, if it is not 0.
    """
    paths = {s: rows.select(*group, f"{s}_file_path").distinct() if f"{s}_file_path" not in group else rows.select(*group).distinct() for s, rows in sides.items()}
    met = paths["old"].join(paths["new"], group).withColumn("_same", same_file.cast("double")).filter("_same is null or _same <> 0")
    homes = met.groupBy(*group, "old_file_path").agg(F.collect_list(F.struct(C("new_file_path").alias("path"), C("_same").alias("same"))).alias("_homes"))
    for c in (*group, "old_file_path"):
        homes = homes.withColumnRenamed(c, f"_at_{c}")
    here = reduce(lambda x, c: x & c, [C(c).eqNullSafe(C(f"_at_{c}")) for c in (*group, "old_file_path")])
    keep = [f"old_{c}" for c in ("id", "name", "shape", "checksum", "file_path", "neighbours")]
    old = sides["old"].join(homes, here, "left").select(*group, *keep, "_homes")
    new = sides["new"].select(*group, *(c.replace("old_", "new_") for c in keep))
    n = max(least_tasks, *(tasks(rows) for rows in sides.values()))
    dealt = (rows.repartition(n, *group).groupBy(*group) for rows in (old, new))
    return next(dealt).cogroup(next(dealt)), old, new


def _walked(sides: dict[str, DataFrame], group: list[str], same_file: Column, least: float, digits: int | None) -> DataFrame:
    """Greedy matches of groups that a task holds: pairs of symbols stay in their task."""
    both, old, new = _dealt(sides, group, same_file)
    schema = StructType([*(old.schema[c] for c in group), old.schema["old_id"], new.schema["new_id"], StructField("score", DoubleType())])
    return both.applyInArrow(_walk(group, schema, least, digits), schema)


def matched_symbols(old: DataFrame, new: DataFrame, group: list[str], same_file: Column, least: float = 0.6, digits: int | None = None, plain: int = 1 << 24) -> DataFrame:
    """``greedy_matching`` of all old with all new symbols of a group that score over ``least``.

    old, new: group columns and those of ``symbol_similarity`` with old_ or new_ before them; ids are unique in a group.
    ``same_file`` looks at old_file_path and new_file_path alone. ``digits`` rounds scores first. A group of up to ``plain``
    pairs is dealt to one task, which walks it. Of larger ones pairs are taken in bands from the best score down: what may
    score over a band's floor is found by its bounds, and matched symbols leave, so that the wide searches of the lower
    bands are left to the few symbols that changed much. The walk is best first anyhow, so the result is the same.
    """

    def prepared(rows: DataFrame, side: str) -> DataFrame:
        path = f"{side}_file_path"
        rows = rows.dropna(subset=group).withColumn(f"{side}_shape", _shape(f"{side}_signature"))
        return cut(rows if path in rows.columns else rows.withColumn(path, F.lit("")))

    sides, taken = {"old": prepared(old, "old"), "new": prepared(new, "new")}, []
    for floor in (*(b for b in BANDS if b > least), least):
        kind = lambda s: F.count_distinct(F.xxhash64(f"{s}_name", f"{s}_shape", f"{s}_file_path"))
        many = [rows.groupBy(*group).agg(F.count("*").alias(s), kind(s).alias(f"{s}_kinds")) for s, rows in sides.items()]
        whole = (C("old").cast("double") * C("new") <= plain) & (C("old") + C("new") <= _WALKED) & (C("old_kinds").cast("double") * C("new_kinds") <= _KINDS)
        sizes = cut(many[0].join(many[1], group).select(*group, whole.alias("_whole")))
        wholes, parts = sizes.agg(F.count_if("_whole"), F.count_if(~C("_whole"))).first()
        if wholes:
            own = {s: rows.join(sizes.filter("_whole").select(*group), group, "left_semi") for s, rows in sides.items()} if parts else sides
            taken.append(cut(_walked(own, group, same_file, least, digits)))
        if not parts:
            break
        if wholes:
            sides = {s: cut(rows.join(sizes.filter("not _whole").select(*group), group, "left_semi")) for s, rows in sides.items()}
        both = similar_candidates(sides["old"], sides["new"], group, floor)
        both = both.join(sides["old"], [*group, "old_id"]).join(sides["new"], [*group, "new_id"])
        both = both.withColumn("same_file", same_file.cast("double"))
        scored = symbol_similarity(both.filter(_at_most(both) > floor - 2 * _SLACK))
        scored = (scored if digits is None else scored.withColumn("score", F.round("score", digits))).filter(C("score") > floor)
        taken.append(greedy_matching(scored, group))
        if floor == least:
            break
        sides = {s: cut(rows.join(taken[-1].select(*group, f"{s}_id"), [*group, f"{s}_id"], "left_anti")) for s, rows in sides.items()}
    empty = sides["old"].join(sides["new"], group).select(*group, "old_id", "new_id", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, taken) if taken else empty
