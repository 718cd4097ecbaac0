"""The small syntax tree that all languages are read into, and the walk that makes chunks of it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.scalars import WHITE_SPACE

MIN_LINES, MIN_BLOCK_LINES, MIN_BLOCK_STATEMENTS = 3, 6, 2

FUNCTION, PARENT, CONTROL, BLOCK, EXPORT, OTHER = "function", "parent", "control", "block", "export", "other"


@dataclass
class Function:
    """What a function node says about itself; a null name stands for an anonymous one."""

    name: str | None
    params: list[tuple[str, str | None]] = field(default_factory=list)
    return_type: str | None = None
    body: Node | None = None


@dataclass
class Node:
    """A stretch of source [start, end) with a role; children are the named parts that matter, in order."""

    role: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    function: Function | None = None


@dataclass
class Parsed:
    """A file's tree, the identifiers outside type syntax as (offset, text), and errors as (offset, text)."""

    root: Node
    identifiers: list[tuple[int, str]]
    errors: list[tuple[int, str]] = field(default_factory=list)


class Language:
    """What a language plugs in: file names, a parser, stop words and the rule for exported functions."""

    name = ""
    extensions: tuple[str, ...] = ()
    stop_words: frozenset[str] = frozenset()

    def is_excluded(self, file_name: str) -> bool:
        return False

    def parse(self, text: str) -> Parsed:
        raise NotImplementedError

    def is_exported(self, name: str, inside_export: bool) -> bool:
        return inside_export


def type_hash_text(value: str | None, missing: str) -> str:
    return re.sub(f"{WHITE_SPACE}+", "", missing if value is None else value).lower()


def signature_hash(name: str, params: list[tuple[str, str | None]], return_type: str | None) -> str:
    types = ",".join(type_hash_text(kind, "any") for _, kind in params)
    return short_hash(f"{re.sub(f'^{WHITE_SPACE}+|{WHITE_SPACE}+$', '', name).lower()}({types}):{type_hash_text(return_type, 'void')}")


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def signature_text(params: list[tuple[str, str | None]], return_type: str | None) -> str:
    listed = ", ".join(name if kind is None else f"{name}: {kind}" for name, kind in params)
    return f"({listed})" + (f" => {return_type}" if return_type is not None else "")


class Chunker:
    """Makes the chunks of one parsed file."""

    def __init__(self, path: str, text: str, parsed: Parsed, language: Language):
        self.path, self.text, self.parsed, self.language = path, text, parsed, language
        self.breaks = [at for at, char in enumerate(text) if char == "\n"]
        self.places = [at for at, _ in parsed.identifiers]

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.breaks, at) + 1

    def lines(self, node: Node) -> tuple[int, int]:
        return self.line(node.start), self.line(max(node.start, node.end - 1) if self.text[node.end - 1 : node.end] != "\n" else node.end)

    def tokens(self, node: Node) -> list[str]:
        from bisect import bisect_left

        low, high = bisect_left(self.places, node.start), bisect_left(self.places, node.end)
        words = {text.lower() for _, text in self.parsed.identifiers[low:high]}
        return sorted(w for w in words if len(w.encode()) > 1 and w not in self.language.stop_words)

    def chunks(self) -> Iterator[dict]:
        yield from self._functions(self.parsed.root, False)

    def _functions(self, node: Node, exported: bool) -> Iterator[dict]:
        if node.role == FUNCTION:
            if node.function.name is not None:
                yield from self._function(node, exported)
                if node.function.body is not None:
                    yield from self._blocks(node.function.body, node.function.name)
            return
        for child in node.children:
            yield from self._functions(child, exported or node.role == EXPORT)

    def _function(self, node: Node, exported: bool) -> Iterator[dict]:
        first, last = self.lines(node)
        if last - first + 1 >= MIN_LINES:
            own = node.function
            yield self._chunk(node, own.name, "function", own.params, own.return_type, self.language.is_exported(own.name, exported), signature_hash(own.name, own.params, own.return_type), signature_text(own.params, own.return_type), None)

    def _blocks(self, node: Node, context: str) -> Iterator[dict]:
        if node.role == PARENT:
            for child in node.children:
                yield from self._block(child, context)
        for child in node.children:
            if child.role != FUNCTION:
                yield from self._blocks(child, context)
            elif child.function.body is not None:
                yield from self._block(child.function.body, context)

    def _block(self, node: Node, context: str) -> Iterator[dict]:
        first, last = self.lines(node)
        size = last - first + 1
        if node.role == BLOCK and size >= MIN_BLOCK_LINES and len(node.children) >= MIN_BLOCK_STATEMENTS and any(c.role in (PARENT, CONTROL) for c in node.children):
            yield self._chunk(node, f"<block:{first}>", "block", [], None, False, short_hash(self.text[node.start : node.end]), f"<block> ({size} lines)", context)

    def _chunk(self, node, name, kind, params, return_type, exported, hashed, signature, context) -> dict:
        first, last = self.lines(node)
        return {
            "id": f"{self.path}:{name}:{first}", "file_path": self.path, "function_name": name, "source_text": self.text[node.start : node.end],
            "start_line": first, "end_line": last, "params": [{"name": n, "type": t} for n, t in params], "return_type": return_type,
            "is_exported": exported, "signature_hash": hashed, "signature": signature, "tokens": self.tokens(node), "chunk_type": kind, "context": context,
        }

    def errors(self) -> list[str]:
        return [f"Parse error at line {self.line(at)}: {text[:80]}" for at, text in self.parsed.errors]
