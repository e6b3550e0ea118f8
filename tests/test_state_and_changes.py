"""State over restarts and the source of a tree's changes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorespan import streaming
from lorespan.functions import nearest_rank
from lorespan.streaming import state, watch

T0 = dt.datetime(2024, 1, 1)


def run(stream, mode, seen, checkpoint):
    """One run to the end of what there is; the rows of each batch go to ``seen``."""
    started = stream.writeStream.foreachBatch(lambda rows, _: seen.extend(rows.collect())).outputMode(mode)
    q = started.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()


def test_sessions_outlive_a_restart(spark, tmp_path):
    schema, rng, seen = "client string, at timestamp, session_id string", random.Random(1), []
    rows = [(f"c{rng.randint(0, 2)}", T0 + dt.timedelta(seconds=i), rng.choice(["a", "a", "a", "b", "", None])) for i in range(60)]
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        run(state.session_switches(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "append", seen, str(tmp_path / "ck"))
    want = streaming.session_switches(spark.createDataFrame(rows, schema)).select("client", "at", "session_id", "previous").collect()
    assert sorted(map(str, seen)) == sorted(map(str, want)) and len(want) > 10


def test_latest_samples_outlive_a_restart(spark, tmp_path):
    schema, rng = "kind string, at timestamp, value double", random.Random(2)
    rows = [(rng.choice("xy"), T0 + dt.timedelta(seconds=i), rng.choice([None, *map(float, range(50))])) for i in range(90)]
    told = []
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        run(state.latest_samples(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keep=10), "update", told, str(tmp_path / "ck"))
    last = {r["kind"]: tuple(r)[1:] for r in told}
    for kind in "xy":
        values = [v for k, _, v in rows if k == kind and v is not None]
        ranks = spark.createDataFrame([(sorted(values[-10:]),)], "v array<double>").select(*(nearest_rank(F.col("v"), p) for p in (50, 95, 99))).first()
        assert last[kind][0] == len(values) and abs(last[kind][1] - sum(values) / len(values)) < 1e-9
        assert last[kind][2:] == tuple(ranks)


def test_changes_of_a_tree_once_each(spark, tmp_path):
    root, listings, seen = tmp_path / "tree", tmp_path / "listings", []
    (root / "sub").mkdir(parents=True)

    def events():
        seen.clear()
        run(watch.tree_changes(spark, str(root), str(listings), 3), "append", seen, str(tmp_path / "ck"))
        return sorted((r["path"][len(str(root)) + 1 :], r["change"]) for r in seen)

    (root / "a.py").write_text("a")
    (root / "sub" / "b.py").write_text("b")
    assert events() == [("a.py", "create"), ("sub/b.py", "create")]
    assert events() == []
    (root / "a.py").write_text("longer")
    (root / "sub" / "b.py").unlink()
    (root / "c é.py").write_text("")
    assert events() == [("a.py", "modify"), ("c é.py", "create"), ("sub/b.py", "delete")]
    assert events() == []


def test_listings_are_read_whatever_their_parts(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for n in range(20):
        (root / f"{n}.py").write_text("x")
    old = watch.TreeReader(str(root), str(tmp_path / "l"), 2)
    first = old.latestOffset()
    (root / "3.py").unlink()
    new = watch.TreeReader(str(root), str(tmp_path / "l"), 5)
    second = new.latestOffset()
    rows = [r for part in new.partitions(first, second) for r in new.read(part)]
    assert [(r[0].rsplit("/", 1)[1], r[1]) for r in rows] == [("3.py", "delete")]
    assert new.latestOffset() == second and new.partitions(second, second) == []
    again = [r for part in new.partitions(first, second) for r in new.read(part)]
    assert again == rows  # a batch that is run again gives the same rows
    new.commit(second)
    assert new._numbers() == [second["listing"]]
    with pytest.raises(ValueError):
        watch.TreeReader(str(root), str(root / "inside"), 2)


def test_nearly_equal():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choices("abc", k=rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        b = "".join(b)
        share = rng.choice([0.5, 0.8, 0.9])
        want = True if not a and not b else 1 - distance(a, b) / max(len(a), len(b)) > share
        assert streaming.nearly_equal(a, b, share) == want, (a, b, share)
