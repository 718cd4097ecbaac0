"""The tool server: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import SparkSession

from . import __version__, commands, embedding, render, search
from .index import Index
from .operators import ranking

PROTOCOL = "2024-11-05"
INVALID_REQUEST, UNKNOWN_METHOD = -32600, -32603

_STRING, _NUMBER, _INTEGER = {"type": "string"}, {"type": "number"}, {"type": "integer"}
_LIST = {"type": "array", "items": _STRING}
_DB = {"db": _STRING}
#: What tools that embed take besides; the names on the right are those of `embedding.resolve`.
SETTINGS = {"model": "model", "ollamaHost": "host", "contextLength": "context", "maxInputBytes": "max_bytes", "queryPrefix": "prefix", "dimensions": "dimensions"}
_SETTINGS = {name: _STRING if name in ("model", "ollamaHost", "queryPrefix") else _INTEGER for name in SETTINGS} | _DB

_PAIR = ("queryFunction", "queryPath", "querySignatureHash", "candidateFunction", "candidatePath", "candidateSignatureHash")

#: name: (description, properties, required ones)
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "query": ("Finds indexed code that is similar to a source text or file.", {"file": _STRING, "source": _STRING, "language": _STRING, "topK": _INTEGER | {"default": ranking.QUERY_TOP}, "threshold": _NUMBER | {"default": ranking.QUERY_THRESHOLD}} | _SETTINGS, []),
    "index": ("Brings the index up to date in the background.", {"path": _STRING, "force": {"type": "boolean", "default": False}} | _SETTINGS, []),
    "index_stop": ("Stops a run of the index; what it has embedded is kept.", {}, []),
    "scan": ("Lists the most similar pairs of the index.", {"topN": _INTEGER | {"default": ranking.SCAN_TOP}, "threshold": _NUMBER | {"default": ranking.SCAN_THRESHOLD}} | _DB, []),
    "status": ("Says how the index is and what a run of it does.", _DB, []),
    "add_exclusion": ("Excludes a pair of functions.", {name: _STRING for name in (*_PAIR, "reason")}, [*_PAIR, "reason"]),
    "add_file_exclusion": ("Excludes files by a pattern.", {"pattern": _STRING, "reason": _STRING}, ["pattern", "reason"]),
    "add_file_pair_exclusion": ("Excludes a pair of files.", {"fileA": _STRING, "fileB": _STRING, "reason": _STRING}, ["fileA", "fileB", "reason"]),
    "add_file_group_exclusion": ("Excludes all pairs of a group of files.", {"files": _LIST, "reason": _STRING}, ["files", "reason"]),
}


class IndexRun:
    """The state of indexing in the background: idle, running, done, failed or cancelled."""

    def __init__(self, spark: SparkSession):
        self.lock, self.stop, self.context = threading.Lock(), threading.Event(), spark.sparkContext
        self.group = f"index-{id(self)}"
        self.state: dict[str, Any] = {"state": "idle"}
        self.thread: threading.Thread | None = None

    def start(self, work: Callable[[Callable, Callable], dict]) -> bool:
        with self.lock:
            if self.state["state"] == "running":
                return False
            self.stop.clear()
            self.state = {"state": "running", "started": time.time(), "embedded": 0, "left": None}
        self.thread = threading.Thread(target=self._work, args=(work,), daemon=True)
        self.thread.start()
        return True

    def _progress(self, embedded: int, left: int) -> None:
        with self.lock:
            self.state |= {"embedded": embedded, "left": left}

    def _work(self, work) -> None:
        try:
            self.context.setJobGroup(self.group, "index", interruptOnCancel=True)
            result = work(self._progress, self.stop.is_set)
            done = {"state": "cancelled" if result["status"] == "cancelled" else "done", "result": result}
        except Exception as error:  # noqa: BLE001  shown by status
            done = {"state": "cancelled"} if self.stop.is_set() else {"state": "failed", "error": str(error)}
        with self.lock:
            self.state = done

    def cancel(self) -> bool:
        with self.lock:
            running = self.state["state"] == "running"
        if running:
            self.stop.set()
            self.context.cancelJobGroup(self.group)
        return running


class Server:
    """Answers requests about the project that `root` lies in."""

    def __init__(self, spark: SparkSession, root: str, resolve: Callable[..., embedding.Embedder] = embedding.resolve, db: str | None = None):
        self.spark, self.root, self.resolve, self.db, self.runs = spark, root, resolve, db, IndexRun(spark)

    def index(self, db: str | None = None, path: str | None = None) -> Index:
        return Index(self.spark, path or self.root, db or self.db)

    def embedder(self, settings: dict) -> embedding.Embedder:
        if unknown := sorted(settings.keys() - SETTINGS.keys()):
            raise ValueError(f"unknown argument {unknown[0]}")
        return self.resolve(**{SETTINGS[name]: value for name, value in settings.items()})

    # --- tools

    def tool_query(self, file: str | None = None, source: str | None = None, language: str | None = None, topK: int = ranking.QUERY_TOP, threshold: float = ranking.QUERY_THRESHOLD, db: str | None = None, **settings) -> dict:  # noqa: N803
        index, embedder = self.index(db), self.embedder(settings)
        name = f"input.{language}" if language else search.VIRTUAL_NAME
        if file is not None:
            name = commands.relative(index, file)
            source = (Path(index.root) / name).read_text()
        if source is None:
            raise ValueError("file or source is needed")
        return search.query_source(index, embedder, source, name, int(topK), threshold)

    def tool_index(self, path: str | None = None, force: bool = False, db: str | None = None, **settings) -> dict:
        index, embedder = self.index(db, path), self.embedder(settings)
        here = Path(path or self.root).resolve()
        prefix = "" if str(here) == index.root else here.relative_to(index.root).as_posix() + "/"
        started = self.runs.start(lambda progress, cancelled: index.run(embedder, prefix, force, progress, cancelled).as_json())
        return {"status": "started" if started else "already running"}

    def tool_index_stop(self) -> dict:
        return {"status": "stopping" if self.runs.cancel() else "not running"}

    def tool_scan(self, topN: int = ranking.SCAN_TOP, threshold: float = ranking.SCAN_THRESHOLD, db: str | None = None) -> dict:  # noqa: N803
        return search.scan(self.index(db), threshold, int(topN))

    def tool_status(self, db: str | None = None) -> dict:
        state = dict(self.runs.state)
        if state["state"] == "running" and state["embedded"]:
            state["remaining"] = render.duration((time.time() - state["started"]) / state["embedded"] * max(0, state["left"] - state["embedded"]))
        return self.index(db).status() | {"indexing": state}

    def tool_add_exclusion(self, queryFunction: str, queryPath: str, querySignatureHash: str, candidateFunction: str, candidatePath: str, candidateSignatureHash: str, reason: str) -> dict:  # noqa: N803
        return commands.exclude_sides(self.index(), (queryPath, queryFunction, querySignatureHash), (candidatePath, candidateFunction, candidateSignatureHash), reason)

    def tool_add_file_exclusion(self, pattern: str, reason: str) -> dict:
        return commands.exclude_file(self.index(), pattern, reason)

    def tool_add_file_pair_exclusion(self, fileA: str, fileB: str, reason: str) -> dict:  # noqa: N803
        return commands.exclude_file_pair(self.index(), fileA, fileB, reason)

    def tool_add_file_group_exclusion(self, files: list[str], reason: str) -> dict:
        return commands.exclude_file_group(self.index(), files, reason)

    # --- protocol

    def call(self, name: str, arguments: dict) -> dict:
        """A tool's result; failures are results too."""
        try:
            if name not in TOOLS:
                raise ValueError(f"unknown tool {name}")
            return {"content": [{"type": "text", "text": json.dumps(getattr(self, f"tool_{name}")(**arguments))}]}
        except Exception as error:  # noqa: BLE001  the caller is told
            return {"content": [{"type": "text", "text": str(error)}], "isError": True}

    def answer(self, message: dict) -> dict | None:
        """The reply to a message; none to notifications."""
        ident = message.get("id")
        if message.get("jsonrpc") != "2.0":
            reply = {"error": {"code": INVALID_REQUEST, "message": "jsonrpc must be 2.0"}}
        else:
            params = message.get("params") or {}
            match message.get("method"):
                case "initialize":
                    reply = {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "twinsift", "version": __version__}}}
                case "ping":
                    reply = {"result": {}}
                case "tools/list":
                    reply = {"result": {"tools": [{"name": name, "description": text, "inputSchema": {"type": "object", "properties": properties, "required": required}} for name, (text, properties, required) in TOOLS.items()]}}
                case "tools/call":
                    if ident is None:
                        return None
                    reply = {"result": self.call(params.get("name", ""), params.get("arguments") or {})}
                case method:
                    reply = {"error": {"code": UNKNOWN_METHOD, "message": f"unknown method {method}"}}
        return None if ident is None else {"jsonrpc": "2.0", "id": ident} | reply

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        for line in lines:
            try:
                message = json.loads(line)
            except ValueError:
                continue
            if isinstance(message, dict) and (reply := self.answer(message)) is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()
