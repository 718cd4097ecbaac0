"""Python, by the interpreter's own parser; lines that it rejects are blanked out and reported."""

from __future__ import annotations

import ast
import io
import itertools
import keyword
import re
import tokenize
import warnings

from .tree import BLOCK, CONTROL, FUNCTION, OTHER, PARENT, Function, Language, Node, Parsed

#: After so many faults a file is also read statement by statement.
MANY_FAULTS = 50

#: Lines at which a statement of a module begins, where no decorator stands before them.
_TOP = re.compile(r"(?:(?:async\s+)?def|class|import|from)\s|@")
_PARENTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith)


class _Source:
    """Offsets in code points from the parser's lines and byte columns."""

    def __init__(self, text: str):
        self.text = text
        self.lines = text.splitlines(keepends=True) if "\r" not in text and "\f" not in text else text.split("\n")
        if "\r" in text or "\f" in text:
            self.lines = [line + "\n" for line in self.lines[:-1]] + [self.lines[-1]]
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))

    def at(self, line: int, column: int) -> int:
        own = self.lines[line - 1] if line <= len(self.lines) else ""
        return self.starts[min(line - 1, len(self.lines))] + (column if own.isascii() else len(own.encode()[:column].decode(errors="ignore")))

    def span(self, node) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)


class Python(Language):
    name, extensions = "python", (".py",)
    # Words that say nothing about what code does.
    stop_words = frozenset(
        ["def", "class", "return", "if", "elif", "else", "for", "while", "break", "continue", "pass", "import", "from", "as", "with", "try", "except", "finally", "raise", "yield", "lambda", "and", "or", "not", "is", "in", "True", "False", "None", "self", "cls", "async", "await", "global", "nonlocal", "assert", "del"]
    )

    def is_excluded(self, file_name: str) -> bool:
        return file_name.startswith("test_") or file_name.endswith(("_test.py", "_tests.py")) or file_name in ("conftest.py", "setup.py")

    def is_exported(self, name: str, inside_export: bool) -> bool:
        return not name.startswith("_")

    def parse(self, text: str) -> Parsed:
        lines = text.split("\n")
        faults: list[int] = []
        tree = _accepted(lines, 0, len(lines), faults, MANY_FAULTS)
        if tree is None:  # statement by statement first, which takes time in proportion to the file
            tops = [i for i, line in enumerate(lines) if _TOP.match(line) and not (i and lines[i - 1].startswith("@"))]
            for low, high in zip([0, *tops], [*tops, len(lines)], strict=True):
                _accepted(lines, low, high, faults)
            tree = _accepted(lines, 0, len(lines), faults)
        starts = [0, *itertools.accumulate(len(line) + 1 for line in text.split("\n"))]
        given = text.split("\n")
        errors = [(starts[at], given[at].strip()) for at in sorted(set(faults))]
        # Blanked lines change what the tree says of their own columns only; offsets are those of the given text.
        source = _Source(text)
        comments, identifiers = _tokens("\n".join(lines), source)
        root = Node(OTHER, 0, len(text), [_statement(s, source, comments) for s in tree.body])
        return Parsed(root, identifiers, errors)


def _accepted(lines: list[str], low: int, high: int, faults: list[int], most: int | None = None) -> ast.Module | None:
    """The tree of lines[low:high], of which faulty ones become `pass` or, if that doesn't do, empty; None after `most` faults.

    Every round empties a line more or shortens it to `pass`, so there is an end.
    """
    rounds = 0
    while most is None or rounds < most:
        rounds += 1
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return ast.parse("\n".join(lines[low:high]))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
            nulls = next((i for i in range(low, high) if "\0" in lines[i]), None)
            line = getattr(error, "lineno", None)
            if nulls is not None:
                at = nulls
            elif line is not None:
                at = low + min(max(1, line), high - low) - 1
            else:
                at = max(range(low, high), key=lambda i: len(lines[i]))
            if not lines[at].strip():
                before = next((i for i in range(at - 1, low - 1, -1) if lines[i].strip()), None)
                at = before if before is not None else next(i for i in range(low, high) if lines[i].strip())
            faults.append(at)
            indent = len(lines[at]) - len(lines[at].lstrip())
            lines[at] = "" if lines[at].strip() == "pass" else lines[at][:indent].replace("\0", " ") + "pass"
    return None


def _tokens(text: str, source: _Source) -> tuple[list[int], list[tuple[int, str]]]:
    comments, names = [], []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            line, column = token.start
            if line > len(source.lines):
                continue
            at = source.starts[line - 1] + column
            if token.type == tokenize.COMMENT:
                comments.append(at)
            elif token.type == tokenize.NAME and not keyword.iskeyword(token.string):
                names.append((at, token.string))
    except (tokenize.TokenError, SyntaxError):
        pass
    return comments, names


def _block(body: list, source: _Source, comments: list[int], low: int = 0) -> Node:
    start, end = source.span(body[0])[0], source.span(body[-1])[1]
    if getattr(body[0], "decorator_list", None):
        start = source.span(body[0].decorator_list[0])[0] - 1
    children = [_statement(s, source, comments) for s in body]
    inside = [c for c in comments if start <= c < end and not any(n.start <= c < n.end for n in children)]
    children = sorted(children + [Node(OTHER, c, c) for c in inside], key=lambda n: n.start)
    return Node(BLOCK, start, end, children)


def _clause(node, body: list, source: _Source, comments: list[int]) -> Node:
    inner = _block(body, source, comments)
    return Node(OTHER, inner.start, inner.end, [inner])


def _statement(node, source: _Source, comments: list[int]) -> Node:
    start, end = source.span(node)
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        body = _block(node.body, source, comments)
        made = Node(FUNCTION, start, end, [], Function(node.name, _params(node.args, source), None if node.returns is None else _text(node.returns, source), body))
        return Node(OTHER, start, end, [made]) if node.decorator_list else made
    if isinstance(node, _PARENTS):
        children = [_block(node.body, source, comments)]
        for handler in getattr(node, "handlers", []):
            children.append(_clause(handler, handler.body, source, comments))
        rest = getattr(node, "orelse", [])
        while len(rest) == 1 and isinstance(node, ast.If) and isinstance(rest[0], ast.If) and source.text.startswith("elif", source.span(rest[0])[0]):
            children.append(_clause(rest[0], rest[0].body, source, comments))
            rest = rest[0].orelse
        for body in (rest, getattr(node, "finalbody", [])):
            if body:
                children.append(_clause(node, body, source, comments))
        return Node(PARENT, start, end, children)
    if isinstance(node, ast.Match):
        return Node(CONTROL, start, end, [_clause(case, case.body, source, comments) for case in node.cases])
    if isinstance(node, ast.ClassDef):
        return Node(OTHER, start, end, [_block(node.body, source, comments)])
    return Node(OTHER, start, end)


def _text(node, source: _Source) -> str:
    start, end = source.span(node)
    return source.text[start:end]


def _params(args: ast.arguments, source: _Source) -> list[tuple[str, str | None]]:
    kind = lambda a: None if a.annotation is None else _text(a.annotation, source)
    out = [(a.arg, kind(a)) for a in args.posonlyargs + args.args]
    if args.vararg:
        out.append((f"*{args.vararg.arg}", kind(args.vararg)))
    out += [(a.arg, kind(a)) for a in args.kwonlyargs]
    if args.kwarg:
        out.append((f"**{args.kwarg.arg}", kind(args.kwarg)))
    return out
