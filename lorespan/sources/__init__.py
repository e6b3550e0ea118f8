"""Readers and writers: source trees, telemetry lines, run logs, case files and versioned tables."""

from __future__ import annotations

import json
import re
import time
import tomllib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan import functions as fn
from lorespan import schema

C = F.col
METRIC_EVENT = "timestamp string, event string, conversation_id string, generation_id string, model string, tool_name string, input_bytes long, output_bytes long, duration_ms long, context_tokens long, context_window_size long, context_usage_pct double, status string, loop_count int, file_path string"
RUN_EVENT = "type string, session_id string, duration_ms long, message struct<id:string,usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>,content:array<struct<type:string,name:string,input:map<string,string>>>>"
LOG_LINE = "timestamp string, level string, message string, method string"
#: Log levels from least to most severe.
LEVELS = ("trace", "debug", "info", "warn", "error")


def ignore_rules(spark: SparkSession, root: str, name: str = ".gitignore") -> list[tuple[str, bool, bool]]:
    """The rules of all ignore files below the root, those of outer folders first, as ``functions.ignore_rule`` gives them."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    base, found, listed = files.getFileStatus(top).getPath().toUri().getPath(), [], files.listFiles(top, True)
    while listed.hasNext():
        at = listed.next().getPath()
        if at.getName() == name:
            found.append((at.getParent().toUri().getPath().removeprefix(base).strip("/"), at))
    out = []
    for folder, at in sorted(found, key=lambda x: (x[0].count("/") + bool(x[0]), x[0])):
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(files.open(at), "UTF-8"))
        out += [rule for line in reader.lines().toList() if (rule := fn.ignore_rule(line, folder))]
        reader.close()
    return out


def source_files(spark: SparkSession, root: str, ignored: list[str] | None = None, docs: bool = False) -> DataFrame:
    """(file_path, content, mtime) of files in known languages, or of markdown; hidden paths and paths that are ignored by the
    given patterns and then by the ignore files of the tree (``functions.ignored_by``) are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = fn.route(C("path"))
    rows = rows.filter(kind == ("doc" if docs else "code")).filter(~C("path").rlike(r"/\.[^/]"))
    below = F.split_part(C("path"), F.lit(root.rstrip("/").split(":", 1)[-1].replace("//", "/") + "/"), F.lit(-1))
    given = [rule for x in ignored or [] if (rule := fn.ignore_rule(x))]
    rows = rows.filter(~fn.ignored_by(below, given + ignore_rules(spark, root)))
    return rows.select(C("path").alias("file_path"), F.decode("content", "utf-8").alias("content"), F.unix_timestamp("modificationTime").alias("mtime"))


def json_lines(spark: SparkSession, path: str, ddl: str = METRIC_EVENT) -> DataFrame:
    """JSON lines of a schema; lines that do not parse are skipped."""
    return spark.read.schema(ddl).option("mode", "DROPMALFORMED").json(path)


def run_events(spark: SparkSession, path: str) -> DataFrame:
    """One row per event of an external run's log; lines that are no JSON object are skipped."""
    parsed = spark.read.text(path).select(F.from_json("value", RUN_EVENT).alias("e")).filter(C("e").isNotNull() & C("e.type").isNotNull())
    return parsed.select("e.*")


def run_metrics(events: DataFrame) -> DataFrame:
    """Per session: tokens by kind, turns (ends of runs) and their durations in all, tool calls, and how often each tool was
    called: ``by_tool`` by name, ``by_service`` those of services (``mcp__service__tool``) by the service's tool."""
    used = C("message.usage")
    total = lambda c: F.coalesce(F.sum(used[c]), F.lit(0)).alias(c)
    ended = C("type") == "result"
    sums = events.groupBy("session_id").agg(
        total("input_tokens"), total("output_tokens"), total("cache_read_input_tokens"), total("cache_creation_input_tokens"),
        F.count_if(ended).alias("turns"), F.coalesce(F.sum(F.when(ended, C("duration_ms"))), F.lit(0)).alias("duration_ms"),
    )
    calls = events.select("session_id", F.explode("message.content").alias("x")).filter("x.type = 'tool_use' AND x.name IS NOT NULL")
    counts = calls.groupBy("session_id", C("x.name").alias("name")).agg(F.count("*").alias("n"))
    service = C("name").startswith("mcp__")
    named = lambda name, which: F.map_from_entries(F.sort_array(F.collect_list(F.when(which, F.struct(name, "n")))))
    maps = counts.groupBy("session_id").agg(F.sum("n").alias("tool_calls"), named(C("name"), F.lit(True)).alias("by_tool"), named(F.substring("name", 6, 1_000), service).alias("by_service"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    out = sums.join(maps.withColumnRenamed("session_id", "_session"), C("session_id").eqNullSafe(C("_session")), "left").drop("_session")
    return out.withColumns({"tool_calls": F.coalesce("tool_calls", F.lit(0)), "by_tool": F.coalesce("by_tool", none), "by_service": F.coalesce("by_service", none)})


def log_lines(spark: SparkSession, path: str, level: str = "info", method: str | None = None, last: int = 50) -> DataFrame:
    """The last lines of a JSON log at or above a level, newest first; schema timestamp, level, message, method."""
    return logged(json_lines(spark, path, LOG_LINE), level, method).orderBy(C("timestamp").desc()).limit(last)


def logged(rows: DataFrame, level: str = "info", method: str | None = None) -> DataFrame:
    """Log rows at or above a level whose method contains a text; of a table or a stream."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.lower("level"))
    rows = rows.filter(rank >= LEVELS.index(level) + 1)
    return rows.filter(C("method").contains(method)) if method else rows


def cases(spark: SparkSession, path: str, key: str = "cases") -> DataFrame:
    """Evaluation cases of a TOML file, one row each, values as text (lists as JSON)."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get(key, [])
    names = sorted({k for c in found for k in c})
    if not names:
        return spark.createDataFrame([], "name string")
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return spark.createDataFrame([tuple(text(c.get(n)) for n in names) for c in found], ", ".join(f"`{n}` string" for n in names))


def thresholds(path: str) -> dict[str, float]:
    """Every number of a TOML file by its dotted name."""
    with open(path, "rb") as f:
        tree = tomllib.load(f)

    def walk(node: dict, head: str) -> dict[str, float]:
        out: dict[str, float] = {}
        for k, v in node.items():
            out |= walk(v, f"{head}{k}.") if isinstance(v, dict) else {head + k: float(v)} if isinstance(v, int | float) else {}
        return out

    return walk(tree, "")


class Moved(Exception):
    """A branch of a table has another version than the one that a write was computed from."""


class Store:
    """Tables under one root. A branch of a table is a folder of data folders and of numbered manifests that list some.

    A write adds one data folder and commits it by the next manifest, whose name can be taken once; so it costs what it
    writes, whatever other branches hold, and a writer that dies leaves nothing half done. Readers see the newest
    manifest. What was computed from a version is committed only on top of that version (``update``, ``since``), and
    computed anew where another writer was first. ``swap`` lists a folder of keys beside its data: rows of earlier folders
    with these keys are no longer read, so that replacing some rows writes those only.

    Taking a name is renaming a file to it, which is atomic on HDFS and local disks; an object store needs a committer
    with conditional writes behind the file system. ``vacuum`` removes what no recent version lists.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _folder(self, table: str, branch: str) -> str:
        return f"{self.root}/{table}/{file_name(branch)}"

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(m.group(1)) for n in self._names(folder) if (m := re.fullmatch(r"v(\d+)", n)))

    def _listed(self, folder: str, number: int) -> list[str]:
        return [r["value"] for r in self.spark.read.text(f"{folder}/v{number}").collect()]  # a few names

    def _newest(self, folder: str) -> tuple[int, list[str]]:
        """Number and folders of the newest manifest; 0 and none before the first."""
        numbers = self._numbers(folder)
        return (numbers[-1], self._listed(folder, numbers[-1])) if numbers else (0, [])

    def _commit(self, folder: str, change: Callable[[list[str]], list[str]], since: int | None = None) -> int:
        while True:
            number, data = self._newest(folder)
            if since is not None and number != since:
                raise Moved(f"{folder}: version {number}, not {since}")
            ready, target = self._path(folder, f"_ready-{uuid.uuid4().hex}"), self._path(folder, f"v{number + 1}")
            out = self._fs.create(ready)
            out.write(bytearray("\n".join(change(data)).encode()))
            out.close()
            if not self._fs.exists(target) and self._fs.rename(ready, target):
                return number + 1
            self._fs.delete(ready, False)

    def _add(self, table: str, rows: DataFrame, branch: str, change: Callable[[list[str], str], list[str]], since: int | None = None) -> int:
        folder, name = self._folder(table, branch), f"data-{uuid.uuid4().hex}"
        schema.conform(rows, table).write.parquet(f"{folder}/{name}")
        try:
            return self._commit(folder, lambda data: change(data, name), since)
        except Moved:
            self._fs.delete(self._path(folder, name), True)
            raise

    def write(self, table: str, rows: DataFrame, branch: str = "main", since: int | None = None) -> int:
        """Replaces the branch's rows; the number of the new version. ``since``: only on top of that version, else ``Moved``."""
        return self._add(table, rows, branch, lambda data, name: [name], since)

    def append(self, table: str, rows: DataFrame, branch: str = "main") -> int:
        """Adds log rows to the newest version."""
        return self._add(table, rows, branch, lambda data, name: [*data, name])

    def swap(self, table: str, rows: DataFrame, gone: DataFrame, branch: str = "main", since: int | None = None) -> int:
        """Adds rows in the place of those whose value of the one column of ``gone`` is among its rows; writes both, no more."""
        folder, keys = self._folder(table, branch), f"gone-{uuid.uuid4().hex}"
        gone.distinct().write.parquet(f"{folder}/{keys}")
        return self._add(table, rows, branch, lambda data, name: [*data, keys, name], since)

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], branch: str = "main") -> int:
        """Replaces the branch's rows by what ``change`` makes of them, again from the start if another writer is first."""
        while True:
            rows, number = self.versioned(table, branch)
            try:
                return self.write(table, change(rows), branch, number)
            except Moved:
                continue

    def read(self, table: str, branch: str = "main") -> DataFrame:
        """The branch's rows; empty where nothing was written."""
        return self.versioned(table, branch)[0]

    def versioned(self, table: str, branch: str = "main") -> tuple[DataFrame, int]:
        """The branch's rows and the number of their version."""
        folder = self._folder(table, branch)
        number, names = self._newest(folder)
        data = [n for n in names if n.startswith("data-")]
        if not data:
            return self.spark.createDataFrame([], schema.TABLES[table]), number
        read = lambda some: self.spark.read.schema(schema.TABLES[table]).parquet(*(f"{folder}/{n}" for n in some))
        if len(data) == len(names):
            return read(data), number
        gone: dict[str, list[DataFrame]] = {}
        rows = reduce(DataFrame.unionByName, (read([n]).withColumn("_place", F.lit(i)) for i, n in enumerate(names) if n in data))
        for i, n in enumerate(names):
            if n.startswith("gone-"):
                keys = self.spark.read.parquet(f"{folder}/{n}")
                gone.setdefault(keys.columns[0], []).append(keys.withColumn("_gone", F.lit(i)))
        for key, lists in gone.items():
            last = reduce(DataFrame.unionByName, lists).groupBy(C(key).alias("_key")).agg(F.max("_gone").alias("_gone"))
            rows = rows.join(last, (C(key) == C("_key")) & (C("_gone") > C("_place")), "left_anti")
        return rows.drop("_place"), number

    def vacuum(self, table: str, branch: str = "main", keep: int = 2, hours: float = 24) -> int:
        """Removes folders and manifests that none of the last ``keep`` versions lists, if they are older than ``hours``
        (younger ones may be a write's that is not committed yet); how many."""
        folder = self._folder(table, branch)
        numbers = self._numbers(folder)[-keep:]
        used = {f"v{n}" for n in numbers} | {name for n in numbers for name in self._listed(folder, n)}
        before = (time.time() - hours * 3600) * 1000
        old = [s.getPath() for s in (self._fs.listStatus(self._path(folder)) if numbers else ()) if s.getPath().getName() not in used and s.getModificationTime() < before]
        for path in old:
            self._fs.delete(path, True)
        return len(old)

    def manifest(self, table: str, branch: str = "main") -> str:
        """The path of the newest manifest, which is another one after each write; the table's folder before the first."""
        folder = self._folder(table, branch)
        number = self._newest(folder)[0]
        return f"{folder}/v{number}" if number else folder

    def has(self, table: str, branch: str) -> bool:
        return self._newest(self._folder(table, branch))[0] > 0

    def get_meta(self, key: str, branch: str = "main") -> str | None:
        row = self.read("daemon_meta", branch).filter(C("key") == key).first()
        return row["value"] if row else None

    def set_meta(self, key: str, value: str, branch: str = "main") -> int:
        own = self.spark.createDataFrame([(key, value)], "key string, value string")
        return self.update("daemon_meta", lambda rows: rows.filter(C("key") != key).unionByName(own), branch)

    def switch_branch(self, name: str) -> str:
        """Makes a branch the current one: ``same``, ``warm`` if it has an index, or ``cold``: it begins with the tables of
        the branch before, whose files a re-indexing then brings up to date."""
        now = self.get_meta("current_branch") or "main"
        if file_name(name) == file_name(now):
            return "same"
        warm = self.has("nodes", name)
        for table in () if warm else schema.BRANCH_TABLES:
            if self.has(table, now):
                self.write(table, self.read(table, now), name)
        self.set_meta("current_branch", name)
        return "warm" if warm else "cold"

    def federate(self, path: str, at: int) -> int:
        """Registers another store, which must hold a table."""
        if not Store(self.spark, path)._names(path):
            raise ValueError(f"no store at {path}")
        own = self.spark.createDataFrame([(path, at, at)], schema.TABLES["federated_repos"])
        return self.update("federated_repos", lambda rows: rows.filter(C("path") != path).unionByName(own))

    def unfederate(self, path: str) -> int:
        return self.update("federated_repos", lambda rows: rows.filter(C("path") != path))

    def federated_repos(self) -> DataFrame:
        """(path, added_at, last_seen) of the registered stores."""
        return self.read("federated_repos")

    def verified_repos(self) -> DataFrame:
        """(path, reachable): whether each registered store still holds a table."""
        paths = [r["path"] for r in self.federated_repos().select("path").collect()]  # a registry, a few rows
        return self.spark.createDataFrame([(p, bool(self._names(p))) for p in paths], "path string, reachable boolean")


def file_name(name: str) -> str:
    """A branch's name as the name of a folder."""
    return "".join("_" if c in '/\\:*?"<>|' else c for c in name)


def federated(stores: dict[str, Store], table: str, branch: str = "main") -> DataFrame:
    """The tables of several stores with the store's name in ``repo``."""
    out = None
    for name, store in stores.items():
        rows = store.read(table, branch).withColumn("repo", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no stores")
    return out


def as_text(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Columns cut to widths with an ellipsis, as text."""
    cut = lambda c, n: F.when(F.length(C(c).cast("string")) > n, F.concat(F.substring(C(c).cast("string"), 1, n - 1), F.lit("…"))).otherwise(C(c).cast("string"))
    return rows.select(*(cut(c, n).alias(c) for c, n in widths.items()))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
