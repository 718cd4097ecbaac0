"""The command line: index, query, scan, status, exclude, git, commit, cache prune, serve."""

from __future__ import annotations

import argparse
import json
import sys
import traceback
from pathlib import Path

from pyspark.sql import SparkSession

from . import commands, embedding, render, search
from .index import Index
from .operators import ranking


def session() -> SparkSession:
    spark = SparkSession.builder.appName("twinsift").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinsift", description="Finds duplicated and near-duplicate code.")
    for names in (("--model",), ("--host", "--ollama-host"), ("--db",), ("--query-prefix",)):
        top.add_argument(*names)
    top.add_argument("--verbose", action="store_true", help="say on standard error what is being done")
    for name in ("--context-length", "--max-input-bytes", "--dimensions"):
        top.add_argument(name, type=int)
    top.add_argument("--json", action="store_true", help="JSON even on a terminal")
    verbs = top.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("index")
    one.add_argument("path", nargs="?", default=".")
    one.add_argument("--force", action="store_true")
    one.add_argument("--dry-run", action="store_true")
    one = verbs.add_parser("query")
    one.add_argument("file", nargs="?")
    one.add_argument("--stdin", action="store_true")
    one.add_argument("--language", help="extension that decides the language of standard input, such as py")
    for name in ("query", "git", "commit"):
        one = one if name == "query" else verbs.add_parser(name)
        one.add_argument("--top-k", type=int, default=ranking.QUERY_TOP)
        one.add_argument("--threshold", type=float, default=ranking.QUERY_THRESHOLD)
    one.add_argument("hash")
    one = verbs.add_parser("scan")
    one.add_argument("--top-n", type=int, default=ranking.SCAN_TOP)
    one.add_argument("--threshold", type=float, default=ranking.SCAN_THRESHOLD)
    verbs.add_parser("status")
    verbs.add_parser("serve", help="answer JSON requests on standard input")
    kinds = verbs.add_parser("exclude").add_subparsers(dest="kind", required=True)
    one = kinds.add_parser("pair", help="two functions, each as FILE:FUNCTION")
    one.add_argument("a")
    one.add_argument("b")
    kinds.add_parser("file").add_argument("pattern")
    one = kinds.add_parser("file-pair")
    one.add_argument("a")
    one.add_argument("b")
    kinds.add_parser("file-group").add_argument("files", nargs="+")
    for one in kinds.choices.values():
        one.add_argument("--reason", default="")
    verbs.add_parser("cache").add_subparsers(dest="kind", required=True).add_parser("prune")
    return top


def _side(text: str) -> tuple[str, str]:
    path, colon, name = text.partition(":")
    if not colon:
        raise ValueError(f"{text} is not FILE:FUNCTION")
    return path, name


def run(options: argparse.Namespace, spark: SparkSession) -> tuple[dict, str]:
    """(result, text for people)."""
    start = options.path if options.verb == "index" else "."
    index = Index(spark, start, options.db)
    embedder = lambda: embedding.resolve(options.model, options.host, options.dimensions, options.context_length, options.max_input_bytes, options.query_prefix)
    if options.verb == "index":
        here = Path(start).resolve()
        prefix = "" if str(here) == index.root else here.relative_to(index.root).as_posix() + "/"
        told = (lambda done, left: print(f"embedded {done}, {left} were left", file=sys.stderr)) if options.verbose else None
        result = index.dry_run(prefix, options.force) if options.dry_run else index.run(embedder(), prefix, options.force, told).as_json()
        return result, render.table_text(result)
    if options.verb == "query":
        name = f"input.{options.language}" if options.language else search.VIRTUAL_NAME
        if options.file and not options.stdin:
            result = search.query_source(index, embedder(), Path(options.file).read_text(), commands.relative(index, str(Path(options.file).resolve())), options.top_k, options.threshold)
        else:
            result = search.query_source(index, embedder(), sys.stdin.read(), name, options.top_k, options.threshold)
        return result, render.query_text(result)
    if options.verb in ("git", "commit"):
        result = search.query_working_tree(index, embedder(), options.top_k, options.threshold) if options.verb == "git" else search.query_commit(index, embedder(), options.hash, options.top_k, options.threshold)
        return result, render.query_text(result)
    if options.verb == "scan":
        result = search.scan(index, options.threshold, options.top_n)
        return result, render.scan_text(result)
    if options.verb == "exclude":
        if options.kind == "pair":
            result = commands.exclude_pair(index, _side(options.a), _side(options.b), options.reason)
        elif options.kind == "file":
            result = commands.exclude_file(index, options.pattern, options.reason)
        elif options.kind == "file-pair":
            result = commands.exclude_file_pair(index, options.a, options.b, options.reason)
        else:
            result = commands.exclude_file_group(index, options.files, options.reason)
        return result, render.table_text(result)
    result = index.prune_cache() if options.verb == "cache" else index.status()
    return result, render.table_text(result)


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    if options.verbose:
        print(f"{options.verb}: " + ", ".join(f"{k}={v}" for k, v in sorted(vars(options).items()) if v is not None and k != "verb"), file=sys.stderr)
    try:
        if options.verb == "serve":
            from .rpc import Server

            Server(session(), ".").serve(sys.stdin, sys.stdout)
            return 0
        result, text = run(options, session())
    except Exception as error:  # noqa: BLE001  every failure becomes a message and an exit code
        if options.verbose:
            traceback.print_exc()
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(json.dumps(result, indent=2) if options.json or not sys.stdout.isatty() else text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
