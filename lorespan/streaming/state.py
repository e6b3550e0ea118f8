"""State by key over batches: a client's session, the latest samples of a kind.

State is kept in the checkpoint, so it outlives a restart, and goes some event time after a key's last row. Rows count in
order of arrival: batch after batch, within a batch by their time; those later than the watermark are left out. One key's
rows of one batch meet in a task. Times out by event time: by processing time, an available-now run did not end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_switches(stream: DataFrame, forget: int = 48 * 3600, late: str = "10 minutes") -> DataFrame:
    """(client, at, session_id, previous) of each request at which a client's session is another than at the one before it.

    stream: client, at, session_id; requests without a session change nothing. A client is forgotten ``forget``
    seconds of event time after its last request, and its next request then is a switch from none, as its first is.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(list(batches)).sort_values(["at", "session_id"])
        found["previous"] = found["session_id"].shift(1)
        found.iloc[0, found.columns.get_loc("previous")] = state.get[0] if state.exists else None
        state.update((found["session_id"].iloc[-1],))
        state.setTimeoutTimestamp(int((found["at"].iloc[-1].timestamp() + forget) * 1000))
        yield found.loc[found["session_id"] != found["previous"], ["client", "at", "session_id", "previous"]]

    rows = stream.select("client", "at", "session_id").filter("session_id <> ''").withWatermark("at", late)
    out = "client string, at timestamp, session_id string, previous string"
    return rows.groupBy("client").applyInPandasWithState(step, out, "session string", "append", GroupStateTimeout.EventTimeTimeout)


def latest_samples(stream: DataFrame, keep: int = 1000, forget: int = 48 * 3600, late: str = "10 minutes") -> DataFrame:
    """(kind, n, mean, p50, p95, p99) of each kind with new samples: the count and mean of all, nearest ranks of the last ``keep``.

    stream: kind, at, value; null values are left out. A stream in update mode.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, before = state.get if state.exists else (0, 0.0, [])
        new = None
        for part in batches:  # no more than the latest of a batch are held
            n, total = n + len(part), total + float(part["value"].sum())
            new = (part if new is None else pd.concat([new, part])).sort_values(["at", "value"]).tail(keep)
        values = [*before, *new["value"].tolist()][-keep:]
        state.update((n, total, values))
        state.setTimeoutTimestamp(int((new["at"].iloc[-1].timestamp() + forget) * 1000))
        ordered = np.sort(values)
        rank = lambda p: float(ordered[int(np.floor(p / 100 * (len(ordered) - 1) + 0.5))])
        yield pd.DataFrame([(*key, n, total / n, rank(50), rank(95), rank(99))], columns=["kind", "n", "mean", "p50", "p95", "p99"])

    rows = stream.selectExpr("kind", "at", "CAST(value AS double) AS value").filter("value IS NOT NULL").withWatermark("at", late)
    out = "kind string, n long, mean double, p50 double, p95 double, p99 double"
    return rows.groupBy("kind").applyInPandasWithState(step, out, "n long, total double, latest array<double>", "update", GroupStateTimeout.EventTimeTimeout)
