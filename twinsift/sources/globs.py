"""Ignore patterns in the style of .gitignore, as Python matchers and as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(pattern: str, at: int) -> tuple[str, int]:
    """A bracket expression that starts at `at`; (regular expression, end)."""
    end = at + 1
    if end < len(pattern) and pattern[end] in "!^":
        end += 1
    if end < len(pattern) and pattern[end] == "]":
        end += 1
    while end < len(pattern) and pattern[end] != "]":
        end += 1
    if end >= len(pattern):
        return r"\[", at + 1
    body = pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
    negated = body[:1] in ("!", "^")
    return f"[{'^/' if negated else ''}{body[1:] if negated else body}]", end + 1


def translate(pattern: str) -> str:
    """A regular expression (for Python and Java) for the part of a pattern between its slashes' meaning."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**/", at) and (at == 0 or pattern[at - 1] == "/"):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif pattern[at:] == "**" and at and pattern[at - 1] == "/":
            out, at = out + ".+", at + 2
        elif pattern[at] == "*":
            while at < len(pattern) and pattern[at] == "*":
                at += 1
            out += "[^/]*"
        elif pattern[at] == "?":
            out, at = out + "[^/]", at + 1
        elif pattern[at] == "[":
            piece, at = _class(pattern, at)
            out += piece
        elif pattern[at] == "\\" and at + 1 < len(pattern):
            out, at = out + re.escape(pattern[at + 1]), at + 2
        else:
            out, at = out + re.escape(pattern[at]), at + 1
    return out


@dataclass(frozen=True)
class Rule:
    """One line: `regex` matches a path or a parent of it; a negated rule takes paths back in."""

    regex: str
    negated: bool
    directory: bool


def parse_rule(line: str) -> Rule | None:
    line = line.rstrip("\n\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    directory = line.endswith("/") and not line.endswith("\\/")
    body = line.rstrip("/") if directory else line
    if not body:
        return None
    anchored = "/" in body
    body = body.removeprefix("/")
    prefix = "" if anchored or body.startswith("**/") else "(?:[^/]+/)*"
    return Rule(prefix + translate(body), negated, directory)


class GlobSet:
    """Rules in order; the last one that matches a path decides, and an ignored parent ignores all below it."""

    def __init__(self, lines: list[str]):
        self.rules = [rule for line in lines if (rule := parse_rule(line))]

    def __bool__(self) -> bool:
        return any(not rule.negated for rule in self.rules)

    def _decides(self, path: str, directory: bool) -> bool | None:
        for rule in reversed(self.rules):
            if (directory or not rule.directory) and re.fullmatch(rule.regex, path):
                return not rule.negated
        return None

    def ignores(self, path: str, directory: bool = False) -> bool:
        """Whether the path, or else the nearest parent that any rule matches, is ignored."""
        path = path.removeprefix("./").strip("/")
        while path:
            decided = self._decides(path, directory)
            if decided is not None:
                return decided
            path, directory = path.rpartition("/")[0], True
        return False

    def matches(self, path: Column) -> Column:
        """The same for a column of file paths: the nearest of path and parents that a rule matches, then the last rule."""
        parts = F.split(F.regexp_replace(path, r"^(\./)?/*|/+$", ""), "/")
        depth = F.size(parts)
        levels = F.transform(F.sequence(depth, F.lit(1)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < depth).alias("d")))

        def decide(level: Column) -> Column:
            out = F.lit(None).cast("boolean")
            for rule in self.rules:
                hit = F.regexp_like(level["p"], F.lit(f"^(?:{rule.regex})$"))
                if rule.directory:
                    hit = hit & level["d"]
                out = F.when(hit, F.lit(not rule.negated)).otherwise(out)
            return out

        decided = F.filter(F.transform(levels, decide), lambda x: x.isNotNull())
        return F.coalesce(F.try_element_at(decided, F.lit(1)), F.lit(False))
