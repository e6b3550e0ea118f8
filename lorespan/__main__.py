"""The tool calls from a shell: ``python -m lorespan ROOT COMMAND ...``; results are JSON lines."""

from __future__ import annotations

import argparse
import re
import time

from pyspark.sql import DataFrame, SparkSession

from lorespan.api import Engine
from lorespan.config import load
from lorespan.operators.indexing import bulk_index
from lorespan.sources import Store, as_json, source_files
from lorespan.sql import full_text
from lorespan.sql import run as run_sql


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lorespan", description=__doc__)
    parser.add_argument("root", help="folder of the store's tables")
    parser.add_argument("--settings", help="TOML file of settings")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> None:
        own = commands.add_parser(name)
        for p in positional:
            own.add_argument(p)
        for key, default in options.items():
            own.add_argument(f"--{key}", default=default, type=type(default) if default is not None else str)

    command("index", "source")
    command("reindex", "source")
    command("capsule", "file", symbol=None, query="", budget=8000, detail="standard")
    command("docs", "query", limit=10)
    command("search", "query", limit=50)
    command("notes", query="", limit=20)
    command("status")
    command("metrics", hours=24)
    command("effectiveness")
    command("switch", "branch")
    command("federate", "action", path="")
    command("sql", "text")
    return parser.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """What the command gives; None where it only changes the store."""
    store = Store(spark, args.root)
    engine = Engine(store, int(time.time()), store.get_meta("current_branch") or "main", load(args.settings))
    match args.command:
        case "index":
            engine.save_index(bulk_index(source_files(spark, args.source)))
        case "reindex":
            engine.apply_changes(source_files(spark, args.source))
        case "capsule":
            row = (1, args.file, args.symbol, args.query, args.budget, args.detail)
            return engine.get_capsules(spark.createDataFrame([row], "request_id int, file string, symbol string, query string, budget int, detail string"))
        case "docs":
            return engine.search_docs(spark.createDataFrame([(0, args.query)], "qid int, query string"), args.limit)
        case "search":
            return engine.search_symbols(spark.createDataFrame([(0, args.query)], "qid int, query string"), args.limit).orderBy("rank")
        case "notes":
            return engine.read_annotations(query=args.query, limit=args.limit)
        case "status":
            return engine.status()
        case "metrics":
            return engine.metrics(args.hours)
        case "effectiveness":
            return engine.effectiveness()
        case "switch":
            return spark.createDataFrame([(args.branch, engine.switch_branch(args.branch))], "branch string, start string")
        case "federate" if args.action in ("add", "remove"):
            store.federate(args.path, int(time.time())) if args.action == "add" else store.unfederate(args.path)
        case "federate":
            return store.verified_repos() if args.action == "verify" else store.federated_repos()
        case "sql":
            for table in ("nodes", "edges", "files", "annotations", "doc_chunks", "session_log", "token_log", "capsule_log"):
                engine._read(table).createOrReplaceTempView(table)
            for name, index in (("search_symbols", engine.symbol_index), ("search_docs", engine.docs_index)):
                if re.search(rf"\b{name}\s*\(", args.text):
                    full_text(spark, index(), name)
            return run_sql(spark, args.text)
    return None


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("lorespan").getOrCreate()
    out = run(spark, args)
    if out is not None:
        for row in as_json(out).toLocalIterator():
            print(row["json"])


if __name__ == "__main__":
    main()
