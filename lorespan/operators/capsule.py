"""Context capsules for batches of requests: gather, score, pin, trim, group, render.

Every stage is one set operation over ``request_id``; requests are data, so a batch of any size is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan.operators import retrieval as r
from lorespan.operators.storage import cut

C = F.col

#: Sections in order, with their headings and the sources they hold.
SECTIONS = (("[!]", ("signal",)), ("[TARGET]", ("target",)), ("[CALLERS]", ("caller",)), ("[CALLEES]", ("callee",)), ("[CONTEXT]", ("note", "history", "activity", "node")), ("[DOCUMENTATION]", ("doc",)))
PINNED = ("target", "signal", "caller", "callee")


@dataclass(frozen=True)
class Level:
    callers: int
    callees: int
    notes: int
    file_notes: int = 0
    project_notes: int = 0
    docs: int = 0
    history: int = 0
    extended: int = 0
    body: bool = False


#: What each level of detail takes of each source.
LEVELS = {"minimal": Level(5, 5, 0), "standard": Level(10, 10, 5), "detailed": Level(20, 20, 10, 3, 3, 3, 3, 50, True)}


def with_caps(requests: DataFrame) -> DataFrame:
    """requests with their level's caps as the struct ``detail``; unknown levels are standard.

    A column ``max_callers``, ``max_notes``, ... (or ``include_body``) overrides its cap where it is not null.
    """
    def own(field: str) -> Column:
        name = "include_body" if field == "body" else f"max_{field}"
        level = F.lit(getattr(LEVELS["standard"], field))
        for known, caps in LEVELS.items():
            level = F.when(C("detail") == known, getattr(caps, field)).otherwise(level)
        return F.coalesce(C(name), level) if name in requests.columns else level

    return requests.withColumn("detail", F.struct(*(own(f.name).alias(f.name) for f in fields(Level))))


def cap(field: str) -> Column:
    """A request's cap for a source."""
    return C("detail")[field]


def tokens(content: Column) -> Column:
    return F.greatest(F.lit(1), fn.token_estimate(content))


def distilled(notes: DataFrame, keys: list[str], over: int = 5, keep: int = 3) -> DataFrame:
    """Of more than ``over`` notes on one anchor, the ``keep`` of best quality and a row that counts the others.

    notes: keys, label, id, content, quality, ... ; ties go by id. The row that counts has no other property.
    """
    own = Window.partitionBy(*keys)
    rows = notes.withColumns({"_n": F.count("*").over(own), "_r": F.row_number().over(own.orderBy(C("quality").desc(), "id"))})
    kept = rows.filter((C("_n") <= over) | (C("_r") <= keep))
    more = rows.filter((C("_n") > over) & (C("_r") == keep + 1))
    text = F.concat(F.lit("[+"), (C("_n") - keep).cast("string"), F.lit(" more notes on "), C("label"), F.lit("]"))
    same = (*keys, "label", "_n", "_r", "detail", "content")
    more = more.withColumn("content", text)
    summary = more.select(*(C(c) if c in same else F.lit(None).cast(more.schema[c].dataType).alias(c) for c in more.columns))
    return kept.unionByName(summary).drop("_n", "_r")


#: What a note's text begins with, by kind; a stale one's with ``[STALE]``.
NOTE_MARKS = {"strategy": "[STRATEGY]", "pitfall": "[PITFALL]", "context": "[CONTEXT NOTE]"}
#: Notes on the whole project that a request may ask for at most.
PROJECT_MOST = 100
#: Signals of a target, and how its changes read.
SIGNALS_MOST, CHANGED, DEPENDENCIES, BODY = 5, "Signature changed: ", "Dependencies changed", "Body modified"
#: What a candidate may carry besides request_id, source, item, content and place.
_MORE = {"anchor_type": "string", "quality": "double", "kind": "string", "stale": "boolean", "updated_at": "long", "bm25": "double", "distance": "int", "significance": "double", "note_id": "string"}


def note_text(kind: Column, stale: Column, text: Column) -> Column:
    mark = F.lit("[NOTE]")
    for k, m in NOTE_MARKS.items():
        mark = F.when(kind == k, m).otherwise(mark)
    return F.concat(F.when(stale, "[STALE]").otherwise(mark), F.lit(" "), text)


def doc_text(file_path: Column, heading: Column, content: Column) -> Column:
    return F.concat(F.lit("[doc: "), file_path, F.lit(" > "), F.coalesce(heading, F.lit("(untitled)")), F.lit("]\n"), content)


def _placed(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))


def _from_notes(asked: DataFrame, nodes: DataFrame, notes: DataFrame, within) -> list[DataFrame]:
    """The notes on targets, on their files, and of the project."""
    text = note_text(C("kind"), F.coalesce("stale", F.lit(False)), C("text"))
    files = asked.join(nodes.select("key", "file_path"), "key")

    def anchored(anchor: str, own: DataFrame, label: str, limit: str) -> DataFrame:
        found = own.join(notes.filter(C("anchor_type") == anchor), C(label) == C("anchor_value"))
        few = distilled(found.select("request_id", "detail", C(label).alias("label"), "id", text.alias("content"), "quality", "kind", "stale", "updated_at"), ["request_id", "label"])
        count = few.filter("id is null").withColumn("place", F.lit(0))  # beside the cap
        rows = _placed(few.filter("id is not null"), C("quality").desc(), "id").filter(within(limit)).unionByName(count)
        return rows.select("request_id", F.lit("note").alias("source"), F.coalesce("id", F.concat(F.lit("more "), "label")).alias("item"), "content", "place", F.lit(anchor).alias("anchor_type"), "quality", "kind", "stale", "updated_at", C("id").alias("note_id"))

    project = notes.filter("anchor_type is null").orderBy(C("quality").desc(), "id").limit(PROJECT_MOST)  # a few rows for all requests
    project = project.select("id", text.alias("content"), "quality", "kind", "stale", "updated_at", F.row_number().over(Window.orderBy(C("quality").desc(), "id")).alias("place"))
    whole = asked.join(F.broadcast(project), C("place") <= cap("project_notes"))
    whole = whole.select("request_id", F.lit("note").alias("source"), C("id").alias("item"), "content", "place", "quality", "kind", "stale", "updated_at", C("id").alias("note_id"))
    return [anchored("node", asked, "key", "notes"), anchored("file", files, "file_path", "file_notes"), whole]


def _history(asked: DataFrame, nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """The changes between a target's newest versions."""
    own = asked.join(nodes.select("key", C("signature_hash").alias("symbol_hash")), "key").join(versions.withColumnRenamed("signature", "was"), "symbol_hash")
    own = _placed(own, C("version_num").desc()).filter(C("place") <= cap("history"))
    w = Window.partitionBy("request_id").orderBy("place")
    own = own.withColumns({"older": F.lead("was").over(w), "older_edges": F.lead("edges_json").over(w)}).filter("older is not null")
    resigned, relinked = C("was") != C("older"), C("edges_json") != C("older_edges")
    reads = F.when(resigned, F.concat(F.lit(CHANGED), "older", F.lit(" → "), "was")).when(relinked, DEPENDENCIES).otherwise(BODY)
    weight = F.when(resigned, 1.0).when(relinked, 0.7).otherwise(0.4)
    return own.select("request_id", F.lit("history").alias("source"), F.concat(F.lit("v"), C("version_num").cast("string")).alias("item"), F.concat(F.lit("[CHANGED] "), reads).alias("content"), "place", C("place").alias("distance"), weight.alias("significance"))


def gather(
    requests: DataFrame, nodes: DataFrame, edges: DataFrame, notes: DataFrame, docs: DataFrame | None = None, strict_caps: bool = True, signals: DataFrame | None = None,
    versions: DataFrame | None = None, reach: DataFrame | None = None, activity: DataFrame | None = None, hits: DataFrame | None = None,
) -> DataFrame:
    """Candidates of requests (request_id, key, budget, detail, and caps as in ``with_caps``) from all sources, each within its cap.

    nodes (key, signature, file_path; for versions also signature_hash), edges (src, dst, weight), notes (id, anchor_type,
    anchor_value, text, kind, quality, stale, updated_at), docs (request_id, id, content, bm25), signals (node_id, kind,
    detail, timestamp), versions (symbol_hash, version_num, signature, edges_json), reach (request_id, item, place: nodes
    that a traversal found), activity (request_id, item, content, updated_at), hits (request_id, item, bm25: the query's
    symbols). With ``strict_caps`` a cap of zero is none; without, zero leaves notes, documents and reached nodes uncapped.
    """
    skeleton = nodes.select(C("key").alias("item"), C("signature").alias("content"))
    asked = with_caps(requests).select("request_id", "key", "detail")
    within = lambda limit: C("place") <= cap(limit) if strict_caps else (cap(limit) == 0) | (C("place") <= cap(limit))

    def neighbours(source: str, mine: str, other: str, limit: str) -> DataFrame:
        found = asked.join(edges, C("key") == C(mine)).select("request_id", "detail", C(other).alias("item"), "weight")
        top = _placed(found, C("weight").desc(), "item").filter(C("place") <= cap(limit))
        return top.join(skeleton, "item").select("request_id", F.lit(source).alias("source"), "item", "content", "place")

    target = asked.withColumnRenamed("key", "item").join(skeleton, "item").select("request_id", F.lit("target").alias("source"), "item", "content", F.lit(0).alias("place"))
    parts = [target, neighbours("caller", "dst", "src", "callers"), neighbours("callee", "src", "dst", "callees")]
    if reach is not None:
        parts = [cut(reduce(DataFrame.unionByName, parts))]  # read again for what they leave
        known = parts[0].select("request_id", "item")
        others = reach.withColumnRenamed("place", "order").join(known, ["request_id", "item"], "left_anti").join(asked.drop("key"), "request_id")
        others = _placed(others, "order", "item").filter(within("extended"))
        parts.append(others.join(skeleton, "item").select("request_id", F.lit("node").alias("source"), "item", "content", "place"))
    parts += _from_notes(asked, nodes, notes, within)
    if versions is not None:
        parts.append(_history(asked, nodes, versions))
    if signals is not None:
        own = asked.join(signals.withColumnsRenamed({"kind": "signal", "detail": "reads"}), C("key") == C("node_id"))
        own = _placed(own, C("timestamp").desc(), "signal", "reads").filter(C("place") <= SIGNALS_MOST)
        content = F.concat(F.lit("[!] "), "signal", F.lit(": "), F.coalesce("reads", F.lit("")))
        parts.append(own.select("request_id", F.lit("signal").alias("source"), F.concat("signal", F.lit(" "), C("place").cast("string")).alias("item"), content.alias("content"), "place"))
    if activity is not None:
        own = _placed(activity.join(asked.select("request_id"), "request_id"), C("updated_at").desc(), "item")
        parts.append(own.select("request_id", F.lit("activity").alias("source"), "item", "content", "place", "updated_at"))
    if docs is not None:
        found = _placed(docs.join(asked.drop("key"), "request_id"), C("bm25").desc(), "id").filter(within("docs"))
        parts.append(found.select("request_id", F.lit("doc").alias("source"), C("id").alias("item"), "content", "place", "bm25"))
    out = None
    for p in parts:
        whole = p.select("request_id", "source", "item", "content", "place", *(C(c).cast(k).alias(c) if c in p.columns else F.lit(None).cast(k).alias(c) for c, k in _MORE.items()))
        out = whole if out is None else out.unionByName(whole)
    if hits is not None:
        own = hits.select("request_id", "item", C("bm25").alias("hit"))
        out = out.join(own, ["request_id", "item"], "left").withColumn("bm25", F.when(C("source").isin("caller", "callee", "node"), C("hit")).otherwise(C("bm25"))).drop("hit")
    return out.withColumn("tokens", tokens(C("content")))


def scored(candidates: DataFrame, centrality: DataFrame, as_of: int) -> DataFrame:
    """Adds ``score`` and ``pinned``; centrality (item, centrality)."""
    rows = candidates.join(centrality, "item", "left")
    graph = C("source").isin("caller", "callee", "node")
    best = F.max(F.when(graph | (C("source") == "target"), F.coalesce("centrality", F.lit(0.0)))).over(Window.partitionBy("request_id"))
    recency = F.when(C("updated_at").isNotNull(), fn.recency(C("updated_at"), F.lit(as_of)))
    near = r.proximity(C("anchor_type"), F.lit(True), F.lit(False))  # gathered notes are the target's, its file's or the project's
    note = r.note_score(F.lit(None).cast("double"), near, recency, C("quality"), F.coalesce("stale", F.lit(False)), C("kind"))
    score = (
        F.when(C("source").isin("target", "signal"), 1.0)
        .when(graph, r.graph_score(F.coalesce("centrality", F.lit(0.0)), best, C("bm25")))
        .when(C("source") == "note", note)
        .when(C("source") == "doc", r.doc_score(C("bm25"), F.lit(False)))
        .when(C("source") == "history", fn.clamp(0.6 * C("significance") + 0.4 / C("distance")))
        .when(C("source") == "activity", r.session_score(F.coalesce(recency, F.lit(0.5))))
    )
    return rows.withColumns({"score": score, "pinned": C("source").isin(*PINNED)})


def trimmed(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows (request_id, item, source, tokens, score, pinned, ...) that fit into budgets (request_id, budget).

    Pinned rows stay. Others are taken by falling score while they fit: one that does not is skipped, and
    smaller ones after it may still fit. Ties go by source and item, which name one row of a request. The fold runs over one request's
    candidates, whose number the caps bound.
    """
    pins = rows.groupBy("request_id").agg(F.coalesce(F.sum(F.when(C("pinned"), C("tokens"))), F.lit(0)).alias("used"))
    left = pins.join(budgets, "request_id").select("request_id", (C("budget") - C("used")).cast("long").alias("left"))
    order = F.sort_array(F.collect_list(F.struct((-C("score")).alias("minus"), "source", "item", C("tokens").cast("long").alias("tokens"))))
    lists = rows.filter("not pinned").groupBy("request_id").agg(order.alias("items")).join(left, "request_id")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<source:string,item:string>>").alias("kept"))

    def take(acc, x):
        fits = acc["used"] + x["tokens"] <= C("left")
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(F.struct(x["source"].alias("source"), x["item"].alias("item"))))).otherwise(acc["kept"]).alias("kept"))

    kept = lists.filter(C("left") > 0).select("request_id", F.explode(F.aggregate("items", start, take)["kept"]).alias("k")).select("request_id", "k.source", "k.item")
    return rows.filter("pinned").unionByName(rows.filter("not pinned").join(kept, ["request_id", "source", "item"], "left_semi").select(*rows.columns))


def rendered(rows: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(request_id, capsule, token_count, items): sections in order, without empty ones.

    bodies (request_id, name, body, budget): the target's source comes last where it fits beside the sections' tokens.
    """
    number = F.lit(None).cast("int")
    for i, (_, sources) in enumerate(SECTIONS):
        number = F.when(C("source").isin(*sources), i).otherwise(number)
    heads = F.array(*[F.lit(h) for h, _ in SECTIONS])
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((~C("pinned")).alias("p"), (-F.when(~C("pinned"), C("score"))).alias("s"), "place", "item", "content"))), lambda x: x["content"]), "\n")
    parts = rows.withColumn("section", number).groupBy("request_id", "section").agg(lines.alias("body"), F.count("*").alias("n"))
    parts = parts.select("request_id", "section", F.concat(F.element_at(heads, C("section") + 1), F.lit("\n"), C("body")).alias("text"), "n")
    if bodies is not None:
        used = parts.groupBy("request_id").agg(F.sum(fn.token_estimate(C("text"))).alias("used"))
        fits = bodies.join(used, "request_id").filter(C("used") + fn.token_estimate(C("body")) <= C("budget"))
        parts = parts.unionByName(fits.select("request_id", F.lit(len(SECTIONS)).alias("section"), F.concat(F.lit("[BODY] "), "name", F.lit("\n"), "body").alias("text"), F.lit(0).cast("long").alias("n")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n\n")
    return parts.groupBy("request_id").agg(whole.alias("capsule"), F.sum("n").alias("items")).withColumn("token_count", fn.token_estimate(C("capsule")))


def kept_candidates(requests: DataFrame, nodes: DataFrame, edges: DataFrame, notes: DataFrame, centrality: DataFrame, as_of: int, docs: DataFrame | None = None, **sources) -> DataFrame:
    """The candidates of requests that fit; a tenth of each budget is kept in reserve. ``sources`` as in ``gather``."""
    rows = cut(scored(gather(requests, nodes, edges, notes, docs, **sources), centrality, as_of))  # few, and read four times
    return trimmed(rows, requests.select("request_id", F.floor(C("budget") * 0.9).alias("budget")))


def served_notes(kept: DataFrame) -> DataFrame:
    """(id), once for each time that a capsule served the note: what raises its retrieval count."""
    return kept.filter("note_id is not null").select(C("note_id").alias("id"))


def target_bodies(requests: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, name, body, budget) of the requests whose level shows it. nodes: also name, line_start, line_end; files (file_path, content)."""
    own = with_caps(requests).filter(cap("body")).join(nodes.select("key", "name", "file_path", "line_start", "line_end"), "key").join(files.select("file_path", C("content").alias("source")), "file_path")
    return own.select("request_id", "name", lines_of(C("source"), C("line_start"), C("line_end")).alias("body"), F.floor(C("budget") * 0.9).alias("budget"))


def assemble(requests: DataFrame, nodes: DataFrame, edges: DataFrame, notes: DataFrame, centrality: DataFrame, as_of: int, docs: DataFrame | None = None, files: DataFrame | None = None, **sources) -> DataFrame:
    """Capsules of requests, with the bodies of targets where ``files`` are given."""
    kept = kept_candidates(requests, nodes, edges, notes, centrality, as_of, docs, **sources)
    return rendered(kept, None if files is None else target_bodies(requests, nodes, files))


def lines_of(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1, of a text."""
    return F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(F.lit(0), end - start + 1)), "\n")
