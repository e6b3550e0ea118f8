"""A streaming source of the changes in a tree of files: creations, changes and deletions, once each over a restart.

``spark.readStream.format("tree_changes")`` with the options ``path`` (the tree), ``listings`` (a folder outside it, kept
with the query's checkpoint) and ``partitions``. Rows are path, change (``create``, ``modify``, ``delete``) and at (when the
change was listed). The driver and the executors must see both folders under the same path.

An offset is the number of a listing. A listing holds path, time and length of every file, in as many parts as there are
partitions, and is never written again; what changed between two of them is found by the tasks, a part each. So a batch
that is run again after a failure gives the same rows. Listings before the last committed one are removed.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tree_changes"


def _dealt(path: str, parts: int) -> int:
    return zlib.crc32(path.encode("utf-8", "surrogatepass")) % parts


class Part(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        super().__init__(number)
        self.number, self.start, self.end = number, start, end


class TreeChanges(DataSource):
    """The source's entry for ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, change string, at timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeReader(self.options["path"], self.options["listings"], int(self.options.get("partitions", "8")))


class TreeReader(DataSourceStreamReader):
    def __init__(self, root: str, listings: str, parts: int):
        self.root, self.listings, self.parts = os.path.abspath(root), os.path.abspath(listings), parts
        if os.path.commonpath([self.root, self.listings]) == self.root:
            raise ValueError("keep the listings outside the tree")

    def _folder(self, number: int) -> str:
        return os.path.join(self.listings, f"{number:012d}")

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in os.listdir(self.listings) if n.isdigit()) if os.path.isdir(self.listings) else []

    def _files(self) -> Iterator[tuple[str, int, int]]:
        """(path below the root, time, length), folder by folder; what vanishes meanwhile is left out."""
        todo = [self.root]
        while todo:
            try:
                with os.scandir(todo.pop()) as found:
                    for entry in found:
                        try:
                            if entry.is_dir(follow_symlinks=False):
                                todo.append(entry.path)
                            elif entry.is_file(follow_symlinks=False):
                                state = entry.stat(follow_symlinks=False)
                                yield os.path.relpath(entry.path, self.root), state.st_mtime_ns, state.st_size
                        except FileNotFoundError:
                            continue
            except FileNotFoundError:
                continue

    def _written(self) -> tuple[str, str]:
        """A new listing under a passing name, and a digest of its lines in any order. A line a file, dealt by its path's hash.

        Lines go to disk as the tree is walked, so the driver holds none of them.
        """
        folder, total = os.path.join(self.listings, f"new-{uuid.uuid4().hex}"), 0
        os.makedirs(folder)
        with ExitStack() as opened:
            parts = [opened.enter_context(open(os.path.join(folder, str(n)), "w")) for n in range(self.parts)]
            for path, changed, size in self._files():
                line = json.dumps([path, changed, size])
                total += int.from_bytes(hashlib.sha256(line.encode()).digest(), "big")
                parts[_dealt(path, self.parts)].write(line + "\n")
        return folder, f"{total % (1 << 256):x}"

    def _said(self, number: int) -> dict:
        with open(os.path.join(self._folder(number), "said")) as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The number of the tree's listing: that of the last one, where nothing changed."""
        numbers, (new, digest) = self._numbers(), self._written()
        if numbers and self._said(numbers[-1])["digest"] == digest:
            shutil.rmtree(new)
            return {"listing": numbers[-1]}
        with open(os.path.join(new, "said"), "w") as f:
            json.dump({"digest": digest, "at": time.time(), "parts": self.parts}, f)
        number = numbers[-1] + 1 if numbers else 1
        os.rename(new, self._folder(number))
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(n, start["listing"], end["listing"]) for n in range(self.parts if start != end else 0)]

    def _listed(self, number: int, part: int) -> dict[str, tuple[int, int]]:
        """The files of a part. The parts of a listing may be others than this reader's."""
        if number == 0:
            return {}
        many, out = self._said(number)["parts"], {}
        for name in [part] if many == self.parts else range(many):
            with open(os.path.join(self._folder(number), str(name))) as f:
                for line in f:
                    path, changed, size = json.loads(line)
                    if _dealt(path, self.parts) == part:
                        out[path] = changed, size
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        before, after = self._listed(partition.start, partition.number), self._listed(partition.end, partition.number)
        at = datetime.fromtimestamp(self._said(partition.end)["at"])
        for path in sorted(before.keys() | after.keys()):
            if before.get(path) != after.get(path):
                change = "create" if path not in before else "delete" if path not in after else "modify"
                yield os.path.join(self.root, path), change, at

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            if number < end["listing"]:
                shutil.rmtree(self._folder(number), ignore_errors=True)


def tree_changes(spark: SparkSession, root: str, listings: str, partitions: int = 8) -> DataFrame:
    """The stream of changes (path, change, at) below ``root``; for ``changes`` and ``each_batch``."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format(NAME).options(path=root, listings=listings, partitions=str(partitions)).load()
