"""Event streams: batched changes, sliding detectors, follow-ups, snapshots and sessions.

Streams carry ``at`` (timestamp). Rows later than the watermark, ten minutes unless said otherwise, are left
out. Each function gives a streaming DataFrame or starts a query; a batch DataFrame works the same way.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespan.functions import is_ignored

if TYPE_CHECKING:
    from lorespan.api import Engine

C = F.col
LATE = "10 minutes"


def changes(stream: DataFrame, own_folder: str = ".index", ignored: tuple[str, ...] = ()) -> DataFrame:
    """Events (path, change) that matter: content changes outside the own folder, of paths that match none of ``ignored``.

    Patterns are those of ``functions.is_ignored``.
    """
    rows = stream.filter(~C("change").isin("access", "metadata") & ~C("path").contains(f"/{own_folder}/"))
    for pattern in ignored:
        rows = rows.filter(~is_ignored(C("path"), pattern))
    return rows


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, interval: str = "350 milliseconds", locked: Callable[[], bool] | None = None, poll: float = 0.2):
    """Starts a query that hands over each batch's distinct paths, once each; nothing is lost while a handler fails.

    While ``locked`` says so (version control is at work), a batch waits; its offsets are committed only after it was
    handled, so deferred changes are never dropped.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}

    def unique(rows: DataFrame, n: int) -> None:
        while locked is not None and locked():
            time.sleep(poll)
        handle(rows.select("path").distinct(), n)

    return stream.writeStream.foreachBatch(unique).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def reindexing(stream: DataFrame, engine: Engine, load: Callable[[DataFrame], DataFrame], checkpoint: str, **options):
    """Starts a query that re-indexes what changed: symbols, edges, ranks and notes once a batch.

    load: from a batch's paths to files (file_path, content, mtime); options as in ``each_batch``.
    """
    return each_batch(stream, lambda paths, _: engine.apply_changes(load(paths)), checkpoint, **options)


def session_switches(rows: DataFrame, client: str = "client") -> DataFrame:
    """Requests (client, at, session_id) at which a client's session is another than before, with ``previous``.

    State of a batch only: the first request of a client is a switch from none. ``state.session_switches`` keeps it over
    batches. Requests without a session change nothing.
    """
    rows = rows.filter("session_id <> ''")
    before = F.lag("session_id").over(Window.partitionBy(client).orderBy("at", "session_id"))
    return rows.withColumn("previous", before).filter(~C("session_id").eqNullSafe(C("previous")))


def retained(snapshot_rows: DataFrame, as_of: int, hours: int = 24, at: str = "start") -> DataFrame:
    """Snapshots of the last ``hours``."""
    return snapshot_rows.filter(F.unix_timestamp(at) >= as_of - hours * 3600)


def snapshots(stream: DataFrame, seconds: int = 60, late: str = LATE) -> DataFrame:
    """(start, n, total) of tumbling windows."""
    w = F.window("at", f"{seconds} seconds")
    return stream.withWatermark("at", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(C("w.start").alias("start"), "n", "total")


def sliding_counts(stream: DataFrame, keys: list[str], span: str = "5 minutes", step: str = "1 minute", late: str = LATE) -> DataFrame:
    w = F.window("at", span, step)
    return stream.withWatermark("at", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(C("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, key: str, gap: str = "2 hours", late: str = LATE) -> DataFrame:
    w = F.session_window("at", gap)
    return stream.withWatermark("at", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, C("w.start").alias("start"), C("w.end").alias("end"), "n")


def follow_ups(capsules: DataFrame, actions: DataFrame, seconds: int = 300, late: str = LATE) -> DataFrame:
    """Actions (session_id, at, event_type, file_path) within ``seconds`` of a capsule (capsule_id, session_id, at, file) on its file."""
    a = capsules.withWatermark("at", late).select("capsule_id", C("session_id").alias("s"), C("at").alias("served"), "file")
    b = actions.withWatermark("at", late)
    near = (C("s") == C("session_id")) & (C("at") >= C("served")) & (C("at") <= C("served") + F.expr(f"interval {seconds} seconds")) & C("file_path").contains(C("file"))
    return a.join(b, near).select("capsule_id", "session_id", "event_type", "at")


def nearly_equal(a: str, b: str, alike: float = 0.9) -> bool:
    """Whether 1 - edit distance / longer length is over ``alike``; only that many edits on either side are looked at."""
    longest = max(len(a), len(b))
    if a == b or not longest:
        return True
    most = int((1 - alike) * longest) + 1
    far = most + 1
    row = [min(j, far) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        if low > high:
            return False
        before, row[low - 1] = row[low - 1], i if low == 1 and i <= most else far
        for j in range(low, high + 1):
            above = row[j] if j < i + most else far
            before, row[j] = row[j], min(above + 1, row[j - 1] + 1, before + (x != b[j - 1]), far)
        if min(row[low - 1 : high + 1]) >= far:
            return False
    return row[-1] < far and 1 - row[-1] / longest > alike


def thrashing(stream: DataFrame, late: str = LATE) -> DataFrame:
    """(node, at) once for each node whose edits (node, at, checksum) thrash, as state: three in 300 seconds, two near the one before.

    An edit is compared with the one before it once, when it comes; the window keeps times and whether the two were
    nearly equal. State goes when no edit came for 48 hours of event time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fired, times, near, last = state.get if state.exists else (False, [], [], None)
        times, near, found = list(times), list(near), []
        rows = pd.concat(list(batches)).sort_values("at")
        for at, checksum in zip(rows["at"], rows["checksum"], strict=True):
            times.append(at.timestamp())
            near.append(last is not None and checksum is not None and nearly_equal(last, checksum))
            last = checksum
            first = next(i for i, t in enumerate(times) if t >= times[-1] - 300)
            times, near = times[first:], near[first:]
            if not fired and len(times) >= 3 and sum(near[1:]) >= 2:  # the first one's neighbour is out of the window
                fired = True
                found.append((key[0], at))
        state.update((fired, times, near, last))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + 48 * 3600 * 1000)
        if found:
            yield pd.DataFrame(found, columns=["node", "at"])

    keyed = stream.withWatermark("at", late).groupBy("node")
    return keyed.applyInPandasWithState(step, "node string, at timestamp", "fired boolean, times array<double>, near array<boolean>, last string", "append", GroupStateTimeout.EventTimeTimeout)


def failed_searches(stream: DataFrame, least: int = 3, late: str = LATE) -> DataFrame:
    """(session_id, query, misses) once for each search that failed ``least`` times in a session, when it does.

    State goes when the session had no miss of it for 48 hours of event time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches))
        state.update((before + len(rows),))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + 48 * 3600 * 1000)
        if before < least <= before + len(rows):
            yield pd.DataFrame([(*key, least)], columns=["session_id", "query", "misses"])

    misses = stream.withWatermark("at", late).select("session_id", F.lower(F.trim("query")).alias("query"), "at")
    if not stream.isStreaming:
        counts = misses.groupBy("session_id", "query").agg(F.count("*").alias("misses")).filter(C("misses") >= least)
        return counts.select("session_id", "query", F.lit(least).cast("long").alias("misses"))
    return misses.groupBy("session_id", "query").applyInPandasWithState(step, "session_id string, query string, misses long", "n long", "append", GroupStateTimeout.EventTimeTimeout)
