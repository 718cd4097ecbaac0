"""A tolerant lexer for languages with braces."""

from __future__ import annotations

import re
from dataclasses import dataclass

WORD, NUMBER, STRING, PUNCT, COMMENT, REGEX, TEXT = "word", "number", "string", "punct", "comment", "regex", "text"

_WORD = re.compile(r"[#@]?[^\W\d][\w$]*|\$[\w$]*")
_NUMBER = re.compile(r"0[xXoObB][\w]+|(?:\d[\d_]*)(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*|\.\d[\d_]*(?:[eE][+-]?\d+)?")
_JS_PUNCT = re.compile(r"\.\.\.|=>|\?\.|\?\?=?|===?|!==?|&&=?|\|\|=?|\*\*=?|\+\+|--|<<=?|>=|<=|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
_RUST_PUNCT = re.compile(r"\.\.=|\.\.\.|\.\.|=>|->|::|==|!=|&&|\|\||<=|>=|<<=|>>=|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#$\\]")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    breaks: bool  # a line break comes before it


def _string_end(text: str, at: int, quote: str) -> int:
    end = at + 1
    while end < len(text) and text[end] != quote:
        if text[end] == "\\":
            end += 1
        elif text[end] == "\n" and quote != "`":
            return end
        end += 1
    return min(len(text), end + 1)


def _before_regex(tokens: list[Token]) -> bool:
    """Whether a slash after these tokens starts a regular expression."""
    last = next((t for t in reversed(tokens) if t.kind != COMMENT), None)
    if last is None:
        return True
    if last.kind == WORD:
        return last.text in ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield")
    return last.kind == PUNCT and last.text not in (")", "]", "}", "++", "--")


def _regex_end(text: str, at: int) -> int | None:
    end, inside = at + 1, False
    while end < len(text) and text[end] != "\n":
        char = text[end]
        if char == "\\":
            end += 1
        elif char == "[":
            inside = True
        elif char == "]":
            inside = False
        elif char == "/" and not inside:
            end += 1
            while end < len(text) and text[end].isalpha():
                end += 1
            return end
        end += 1
    return None


class ScriptLexer:
    """JavaScript and TypeScript, with template literals and, if asked for, JSX."""

    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx, self.at, self.tokens, self.broke = text, jsx, 0, [], False

    def run(self) -> list[Token]:
        while self.at < len(self.text):
            self._one()
        return self.tokens

    def _add(self, kind: str, end: int) -> None:
        self.tokens.append(Token(kind, self.text[self.at : end], self.at, end, self.broke))
        self.at, self.broke = end, False

    def _one(self) -> None:
        text, at = self.text, self.at
        char = text[at]
        if char.isspace():
            self.broke |= char == "\n"
            self.at += 1
        elif text.startswith("//", at) or (at == 0 and text.startswith("#!")):
            end = text.find("\n", at)
            self._add(COMMENT, len(text) if end < 0 else end)
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            self._add(COMMENT, len(text) if end < 0 else end + 2)
        elif char in "\"'":
            self._add(STRING, _string_end(text, at, char))
        elif char == "`":
            self._template()
        elif char == "/" and _before_regex(self.tokens) and (end := _regex_end(text, at)):
            self._add(REGEX, end)
        elif char == "<" and self.jsx and _before_regex(self.tokens) and re.match(r"<(?:[A-Za-z_$][\w$.:-]*|>)", text[at : at + 80]) and not re.match(r"<[A-Za-z_$][\w$]*(?:\s+extends\b|\s*,)", text[at : at + 80]):
            self._element()
        elif match := _WORD.match(text, at):
            self._add(WORD, match.end())
        elif char.isdigit() or (char == "." and text[at + 1 : at + 2].isdigit()):
            self._add(NUMBER, _NUMBER.match(text, at).end())
        elif match := _JS_PUNCT.match(text, at):
            self._add(PUNCT, match.end())
        else:
            self._add(PUNCT, at + 1)

    def _code_in_braces(self) -> None:
        """The tokens from an open brace to the one that closes it."""
        depth = 0
        while self.at < len(self.text):
            self._one()
            last = self.tokens[-1] if self.tokens else None
            if last is not None and last.kind == PUNCT and last.end == self.at:
                depth += (last.text in ("{", "${")) - (last.text == "}")
                if depth <= 0 and last.text == "}":
                    return

    def _template(self) -> None:
        end = self.at + 1
        while end < len(self.text):
            if self.text[end] == "\\":
                end += 2
            elif self.text[end] == "`":
                self._add(STRING, end + 1)
                return
            elif self.text.startswith("${", end):
                if end > self.at:
                    self._add(STRING, end)
                self._add(PUNCT, end + 2)
                depth = 1
                while self.at < len(self.text) and depth:
                    before = len(self.tokens)
                    self._one()
                    for token in self.tokens[before:] if len(self.tokens) == before + 1 else ():
                        if token.kind == PUNCT:
                            depth += (token.text in ("{", "${")) - (token.text == "}")
                end = self.at
            else:
                end += 1
        if end > self.at:
            self._add(STRING, len(self.text))

    def _element(self) -> None:
        """A JSX element: tags become punctuation and text, braces hold code."""
        depth = 0
        while self.at < len(self.text):
            opened = re.compile(r"</?\s*[A-Za-z_$]?[\w$.:-]*").match(self.text, self.at)
            if not opened:
                return
            closing = opened[0].startswith("</")
            self._add(TEXT, opened.end())
            alone = False
            while self.at < len(self.text):  # attributes
                char = self.text[self.at]
                if self.text.startswith("/>", self.at):
                    alone = True
                    self._add(TEXT, self.at + 2)
                    break
                if char == ">":
                    self._add(TEXT, self.at + 1)
                    break
                if char == "{":
                    self._code_in_braces()
                elif char in "\"'":
                    end = self.text.find(char, self.at + 1)
                    self._add(STRING, len(self.text) if end < 0 else end + 1)
                elif char.isspace():
                    self.broke |= char == "\n"
                    self.at += 1
                elif match := re.compile(r"[A-Za-z_$][\w$:-]*").match(self.text, self.at):
                    self._add(WORD, match.end())
                else:
                    self._add(TEXT, self.at + 1)
            depth += -1 if closing else 0 if alone else 1
            if depth <= 0:
                return
            while self.at < len(self.text) and self.text[self.at] != "<":  # children
                if self.text[self.at] == "{":
                    self._code_in_braces()
                else:
                    end = min((e for e in (self.text.find("<", self.at), self.text.find("{", self.at)) if e >= 0), default=len(self.text))
                    self._add(TEXT, end)


_RAW = re.compile(r'b?r(#*)"')
_LIFETIME = re.compile(r"'[^\W\d]\w*(?!')")


def rust_tokens(text: str) -> list[Token]:
    tokens, at, broke = [], 0, False
    while at < len(text):
        char, kind = text[at], PUNCT
        if char.isspace():
            broke |= char == "\n"
            at += 1
            continue
        if text.startswith("//", at):
            end = text.find("\n", at)
            kind, end = COMMENT, len(text) if end < 0 else end
        elif text.startswith("/*", at):
            kind, depth, end = COMMENT, 1, at + 2
            while end < len(text) and depth:
                if text.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif text.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
        elif raw := _RAW.match(text, at):
            end = text.find('"' + raw[1], raw.end())
            kind, end = STRING, len(text) if end < 0 else end + 1 + len(raw[1])
        elif char == '"' or text.startswith('b"', at):
            kind, end = STRING, at + (char == "b")
            end += 1
            while end < len(text) and text[end] != '"':
                end += 1 + (text[end] == "\\")
            end = min(len(text), end + 1)
        elif char == "'":
            found = _LIFETIME.match(text, at)
            kind, end = (TEXT, found.end()) if found else (STRING, _string_end(text, at, "'"))
        elif match := re.compile(r"(?:r#)?[^\W\d]\w*").match(text, at):
            kind, end = WORD, match.end()
        elif char.isdigit():
            kind, end = NUMBER, re.compile(r"\d[\w]*(?:\.\d[\w]*)?").match(text, at).end()
        else:
            match = _RUST_PUNCT.match(text, at)
            end = match.end() if match else at + 1
        tokens.append(Token(kind, text[at:end], at, end, broke))
        at, broke = end, False
    return tokens


class Cursor:
    """Tokens without comments, with the partner of each bracket; comments are kept apart."""

    OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}

    def __init__(self, text: str, tokens: list[Token]):
        self.text = text
        self.comments = [t for t in tokens if t.kind == COMMENT]
        self.tokens = [t for t in tokens if t.kind != COMMENT]
        self.partner: dict[int, int] = {}
        self.unmatched: list[int] = []
        stack: list[int] = []
        for at, token in enumerate(self.tokens):
            if token.kind != PUNCT:
                continue
            if token.text in self.OPEN:
                stack.append(at)
            elif token.text in (")", "]", "}"):
                fits = next((i for i in range(len(stack) - 1, -1, -1) if self.OPEN[self.tokens[stack[i]].text] == token.text), None)
                if fits is None:
                    self.unmatched.append(at)
                    continue
                self.unmatched += stack[fits + 1 :]
                self.partner[stack[fits]], self.partner[at] = at, stack[fits]
                del stack[fits:]
        self.unmatched += stack
        self.skipped: set[int] = set()  # tokens of type syntax

    def is_(self, at: int, *texts: str) -> bool:
        return 0 <= at < len(self.tokens) and self.tokens[at].kind in (PUNCT, WORD) and self.tokens[at].text in texts

    def word(self, at: int) -> bool:
        return 0 <= at < len(self.tokens) and self.tokens[at].kind == WORD

    def close(self, at: int, limit: int) -> int:
        """The partner of the bracket at `at`, or the last token before limit."""
        return min(self.partner.get(at, limit - 1), limit - 1)

    def skip(self, low: int, high: int) -> None:
        self.skipped.update(range(low, high))

    def errors(self) -> list[tuple[int, str]]:
        out = []
        for at in sorted(self.unmatched):
            start = self.tokens[at].start
            end = self.text.find("\n", start)
            out.append((start, self.text[start : len(self.text) if end < 0 else end]))
        return out

    def angle_close(self, at: int, limit: int, plain: bool = True) -> int | None:
        """The `>` that closes the `<` at `at`, if only type syntax lies between."""
        depth, i = 0, at
        while i < limit:
            token = self.tokens[i]
            if token.kind == PUNCT:
                if token.text == "<":
                    depth += 1
                elif token.text == ">":
                    depth -= 1
                    if not depth:
                        return i
                elif token.text in self.OPEN:
                    i = self.close(i, limit)
                elif token.text in (";", "}", ")", "]", "&&", "||", "===", "!==", "==", "+", "*", "/", "%") and not (not plain and token.text in ("+", "*")):
                    return None
            i += 1
        return None
