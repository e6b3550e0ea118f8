"""Annotations and behavioural signals as batch operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan import schema
from lorespan.operators import tables

C = F.col


def with_hash(notes: DataFrame) -> DataFrame:
    return notes.withColumn("content_hash", fn.note_hash(C("anchor_type"), C("anchor_value"), C("text")))


def upsert_notes(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """old: id, content_hash, quality, ...; new rows arrive by ``order``.

    A new note whose content exists already, in the table or earlier in the batch, only adds 0.1 to that note's
    quality (up to 1); another with a known id replaces its content; the rest are added. A hash's row is the
    old one with the smallest id, or the first new one. Repeats are counted per hash, so no hash is walked.
    """
    columns = old.columns
    known = old.groupBy("content_hash").agg(F.min("id").alias("_known"))
    rows = new.join(known, "content_hash", "left").withColumn("_r", F.row_number().over(Window.partitionBy("content_hash").orderBy(order)))
    again = rows.filter(C("_known").isNotNull() | (C("_r") > 1))
    first = rows.filter(C("_known").isNull() & (C("_r") == 1))
    bumps = again.groupBy("content_hash").agg(F.count("*").alias("_n"))
    latest = F.row_number().over(Window.partitionBy("id").orderBy(C(order).desc()))
    added = first.withColumn("_l", latest).filter("_l = 1").select(*columns)
    kept = old.join(added.select("id"), "id", "left_anti").select(*columns)
    both = kept.unionByName(added).join(bumps, "content_hash", "left")
    # of several old rows with one hash only the named one gains
    named = both.join(known.withColumnRenamed("_known", "_id"), "content_hash", "left")
    gain = F.when(C("_id").isNull() | (C("_id") == C("id")), F.coalesce("_n", F.lit(0))).otherwise(0)
    return named.withColumn("quality", fn.clamp(C("quality") + 0.1 * gain)).select(*columns)


def decay(notes: DataFrame, factor: float = 0.9) -> DataFrame:
    return notes.withColumn("quality", C("quality") * factor)


def mark_stale(notes: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes (key, old_sum, new_sum): anchored notes go stale where sums differ; files (file, mtime): where the file is newer."""
    changed = nodes.filter(C("old_sum") != C("new_sum")).select(C("key").alias("_v"), F.lit("node").alias("_t"))
    newer = files.groupBy("file").agg(F.max("mtime").alias("mtime"))
    rows = notes.join(changed, (C("anchor_type") == C("_t")) & (C("anchor_value") == C("_v")), "left")
    rows = rows.join(newer, (C("anchor_type") == "file") & (C("anchor_value") == C("file")), "left")
    return rows.withColumn("stale", C("stale") | C("_v").isNotNull() | F.coalesce(C("updated_at") < C("mtime"), F.lit(False))).select(*notes.columns)


def retrieved(notes: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (id): each occurrence adds one to the note's retrieval count."""
    count = hits.groupBy("id").agg(F.count("*").alias("_n"))
    return notes.join(count, "id", "left").withColumn("retrieval_count", C("retrieval_count") + F.coalesce("_n", F.lit(0))).select(*notes.columns)


def fork(parent: DataFrame, child: DataFrame, key: str = "id") -> DataFrame:
    """child, and the parent's rows whose key it lacks."""
    return child.unionByName(parent.join(child.select(key), key, "left_anti").select(*child.columns))


def merge(source: DataFrame, target: DataFrame, nodes: DataFrame) -> DataFrame:
    """target, and the source's notes of other content whose node, if anchored to one, exists there (key).

    Content is equal by hash, or for notes without one by anchor and text, nulls being equal. A clashing id is
    derived anew from id and content, so that a repeated merge gives the same rows.
    """
    hashed = source.filter(C("content_hash").isNotNull()).join(target.select("content_hash"), "content_hash", "left_anti").select(*target.columns)
    a, b = source.filter(C("content_hash").isNull()).alias("a"), target.alias("b")
    same = C("a.anchor_type").eqNullSafe(C("b.anchor_type")) & C("a.anchor_value").eqNullSafe(C("b.anchor_value")) & (C("a.text") == C("b.text"))
    fresh = hashed.unionByName(a.join(b, same, "left_anti").select(*target.columns))
    ids = nodes.select(C("key").alias("_key"))
    on_node = fresh.filter("anchor_type = 'node' and anchor_value is not null").join(ids, C("anchor_value") == C("_key"), "left_semi")
    other = fresh.filter("anchor_type is null or anchor_type <> 'node' or anchor_value is null")
    clash = target.select(C("id").alias("_id"))
    both = on_node.unionByName(other).join(clash, C("id") == C("_id"), "left")
    renamed = both.withColumn("id", F.when(C("_id").isNull(), C("id")).otherwise(F.md5(F.concat_ws("|", "id", "anchor_value", "text"))))
    return target.unionByName(renamed.select(*target.columns))


def migrate(notes: DataFrame, matches: DataFrame, old_ids: DataFrame) -> DataFrame:
    """Notes follow their symbols: matches (old_id, new_id) move and are fresh; those on other old ids (id) go stale."""
    gone = old_ids.select(C("id").alias("_gone")).distinct()
    rows = notes.join(matches, (C("anchor_type") == "node") & (C("anchor_value") == C("old_id")), "left")
    rows = rows.join(gone, (C("anchor_type") == "node") & (C("anchor_value") == C("_gone")), "left")
    moved = C("new_id").isNotNull()
    return rows.withColumns({"anchor_value": F.when(moved, C("new_id")).otherwise(C("anchor_value")), "stale": F.when(moved, F.lit(False)).otherwise(C("stale") | C("_gone").isNotNull())}).select(*notes.columns)


def pruned(rows: DataFrame, at: str, as_of: int, hours: int = 48) -> DataFrame:
    return rows.filter(C(at) >= as_of - hours * 3600)


def valid_signals(signals: DataFrame) -> DataFrame:
    """Signals of a known kind; the others are not stored."""
    return signals.filter(C("kind").isin(*schema.IMPROVEMENT_SIGNALS, *schema.INSIGHT_SIGNALS))


def session_document(sessions: DataFrame, signals: DataFrame, notes: DataFrame, as_of: int) -> DataFrame:
    """One row per session: totals, its last 20 events, active signals and up to 20 stale notes."""
    order = Window.partitionBy("session_id").orderBy(C("timestamp").desc(), C("event_id").desc())
    recent = sessions.withColumn("_r", F.row_number().over(order))
    events = F.sort_array(F.collect_list(F.when(C("_r") <= 20, F.struct((-C("_r")).alias("place"), "event_type", "file_path", "symbol", "timestamp"))), asc=False)
    totals = recent.groupBy("session_id").agg(F.count("*").alias("total_events"), F.countDistinct("file_path").alias("unique_files"), F.countDistinct("symbol").alias("unique_symbols"), events.alias("recent_events"))
    active = pruned(signals, "timestamp", as_of).groupBy("session_id").agg(F.count("*").alias("active_signals"))
    stale = notes.filter("stale").orderBy("id").limit(20).agg(F.sort_array(F.collect_list("id")).alias("stale_notes"))
    return totals.join(active, "session_id", "left").na.fill({"active_signals": 0}).crossJoin(F.broadcast(stale))  # one row


def merge_edges(source: DataFrame, target: DataFrame, notes: DataFrame, renamed: DataFrame) -> DataFrame:
    """target's relations (from_id, to_id, relation, weight, created_at) and the source's, whose ends are merged notes (id).

    Weights of equal ones add up and the first creation time stays. renamed (old_id, new_id): notes that took another id.
    """
    for end in ("from_id", "to_id"):
        own = renamed.select(C("old_id").alias(end), C("new_id").alias("_new"))
        source = source.join(own, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new").join(notes.select(C("id").alias(end)), end, "left_semi")
    return tables.accumulate(target, source.select(*target.columns), ["from_id", "to_id", "relation"], "weight", "created_at")


def without_orphans(notes: DataFrame, nodes: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """notes less the stale ones on symbols (nodes: key) that are gone, last updated over ``days`` ago."""
    old = notes.filter((C("anchor_type") == "node") & C("stale") & (C("updated_at") < as_of - days * 86400))
    gone = old.join(nodes.select(C("key").alias("anchor_value")), "anchor_value", "left_anti").select("id")
    return notes.join(gone, "id", "left_anti").select(*notes.columns)


def append_versions(versions: DataFrame, changed: DataFrame, edges: DataFrame, keep: int = 5) -> DataFrame:
    """versions (symbol_hash, version_num, signature, edges_json) and the next one of each changed symbol, the newest ``keep``.

    changed (symbol_hash, key, signature); edges (src, dst, kind, weight) go into edges_json, by target and kind.
    """
    own = edges.join(changed.select(C("key").alias("src")), "src", "left_semi").groupBy(C("src").alias("key")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(C("dst").alias("to"), "kind")))).alias("edges_json"))
    last = versions.groupBy("symbol_hash").agg(F.max("version_num").alias("_last"))
    fresh = changed.join(own, "key", "left").join(last, "symbol_hash", "left")
    fresh = fresh.select("symbol_hash", (F.coalesce("_last", F.lit(0)) + 1).cast(versions.schema["version_num"].dataType).alias("version_num"), "signature", F.coalesce("edges_json", F.lit("[]")).alias("edges_json"))
    rank = F.row_number().over(Window.partitionBy("symbol_hash").orderBy(C("version_num").desc()))
    return versions.select(*fresh.columns).unionByName(fresh).withColumn("_r", rank).filter(C("_r") <= keep).drop("_r")
