"""Rust, read by recursive descent over a tolerant lexer.

An `if`, `for`, `while`, `loop` or `match` that stands as a statement counts as the statement around it, so a block holds
control flow of its own only as a value.
"""

from __future__ import annotations

from .lexer import PUNCT, STRING, WORD, Cursor, rust_tokens
from .tree import BLOCK, FUNCTION, OTHER, PARENT, Function, Language, Node, Parsed

# Words that say nothing about what code does.
_WORDS = ["fn", "let", "mut", "const", "static", "pub", "crate", "super", "self", "mod", "use", "struct", "enum", "trait", "impl", "type", "where", "if", "else", "match", "for", "while", "loop", "break", "continue", "return", "in", "as", "ref", "move", "async", "await", "unsafe", "extern", "true", "false", "some", "none", "ok", "err"]

_RESERVED = frozenset([*_WORDS, "dyn", "Self"]) - {"some", "none", "ok", "err"}
_BEFORE_FN = frozenset(["pub", "const", "async", "unsafe", "extern", "default", "crate"])
_FLOW = frozenset(["if", "match", "for", "while", "loop"])


class _Reader:
    def __init__(self, text: str):
        self.c = Cursor(text, rust_tokens(text))
        self.t = self.c.tokens

    def node(self, role: str, low: int, high: int, children=(), function=None) -> Node:
        high = max(high, low + 1)
        if low >= len(self.t):
            return Node(role, len(self.c.text), len(self.c.text), list(children), function)
        return Node(role, self.t[low].start, self.t[min(high, len(self.t)) - 1].end, list(children), function)

    def source(self, low: int, high: int) -> str:
        return self.c.text[self.t[low].start : self.t[high - 1].end] if high > low else ""

    def fn_at(self, at: int, limit: int) -> int | None:
        """The `fn` of a function that starts at `at` with its modifiers."""
        i = at
        while i < limit and self.c.word(i) and self.t[i].text in _BEFORE_FN or (i < limit and self.t[i].kind == STRING):
            i += 1
            if self.c.is_(i, "(") and self.c.is_(i - 1, "pub", "crate"):
                i = self.c.close(i, limit) + 1
        return i if i < limit and self.c.is_(i, "fn") and self.c.word(i + 1) else None

    def type_end(self, at: int, limit: int, *stops: str) -> int:
        i = at
        while i < limit:
            if self.c.is_(i, *stops):
                return i
            if self.c.is_(i, "<") and (close := self.c.angle_close(i, limit, plain=False)) is not None:
                i = close + 1
            elif self.c.is_(i, "(", "["):
                i = self.c.close(i, limit) + 1
            elif self.c.is_(i, ")", "]", "}", ";"):
                return i
            else:
                i += 1
        return limit

    def skip_type(self, at: int, limit: int, *stops: str) -> int:
        end = self.type_end(at, limit, *stops)
        self.c.skip(at, end)
        return end

    # --- items

    def items(self, at: int, limit: int) -> list[Node]:
        out = []
        while at < limit:
            made, after = self.item(at, limit)
            if made is not None:
                out.append(made)
            at = max(after, at + 1)
        return out

    def item(self, at: int, limit: int) -> tuple[Node | None, int]:
        if self.c.is_(at, "#"):
            at += 1 + self.c.is_(at + 1, "!")
            return None, self.c.close(at, limit) + 1
        if (fn := self.fn_at(at, limit)) is not None:
            return self.function(at, fn, limit)
        i = at
        while self.c.word(i) and self.t[i].text in _BEFORE_FN and i < limit:
            i += 1
            if self.c.is_(i, "("):
                i = self.c.close(i, limit) + 1
        if self.c.is_(i, "impl", "trait", "mod") or (self.c.is_(i, "{") and self.c.is_(i - 1, "extern")):
            brace = self.type_end(i, limit, "{", ";")
            self.c.skip(i, brace)
            if not self.c.is_(brace, "{"):
                return None, brace + 1
            close = self.c.close(brace, limit)
            return self.node(OTHER, at, close + 1, self.items(brace + 1, close)), close + 1
        if self.c.is_(i, "struct", "enum", "union", "use", "type", "static", "macro_rules") or (self.c.is_(i, "const") or self.c.is_(i - 1, "const")):
            end = i
            while end < limit and not self.c.is_(end, ";"):
                brace = self.c.is_(end, "{")
                if self.t[end].kind == PUNCT and self.t[end].text in Cursor.OPEN:
                    end = self.c.close(end, limit)
                    if brace and not self.c.is_(i, "use"):
                        break
                end += 1
            return self.node(OTHER, at, min(limit, end + 1)), min(limit, end + 1)
        return None, max(i, at + 1)

    def function(self, at: int, fn: int, limit: int) -> tuple[Node, int]:
        name, i = self.t[fn + 1].text, fn + 2
        if self.c.is_(i, "<") and (close := self.c.angle_close(i, limit, plain=False)) is not None:
            self.c.skip(i, close + 1)
            i = close + 1
        params = []
        if self.c.is_(i, "("):
            close = self.c.close(i, limit)
            params = self.params(i + 1, close)
            i = close + 1
        kind = None
        if self.c.is_(i, "->"):
            end = self.skip_type(i + 1, limit, "{", "where", ";")
            kind = self.source(i + 1, end) or None
            i = end
        if self.c.is_(i, "where"):
            i = self.skip_type(i, limit, "{", ";")
        body = None
        if self.c.is_(i, "{"):
            body, i = self.block(i, limit)
        elif self.c.is_(i, ";"):
            i += 1
        return self.node(FUNCTION, at, i, [], Function(name, params, kind, body)), i

    def params(self, at: int, limit: int) -> list[tuple[str, str | None]]:
        out = []
        while at < limit:
            if self.c.is_(at, "#"):
                at = self.c.close(at + 1, limit) + 1
                continue
            low = at
            end = self.type_end(at, limit, ",")
            colon = self.type_end(at, end, ":")
            if colon < end:
                self.c.skip(colon, end)
                out.append((self.source(low, colon), self.source(colon + 1, end) or None))
            elif any(self.c.is_(i, "self") for i in range(low, end)):
                out.append((self.source(low, end), None))
            at = end + 1
        return out

    # --- statements and expressions

    def block(self, at: int, limit: int) -> tuple[Node, int]:
        close = self.c.close(at, limit)
        made = self.node(BLOCK, at, close + 1, self.statements(at + 1, close))
        inside = [c for c in self.c.comments if made.start <= c.start < made.end and not any(n.start <= c.start < n.end for n in made.children)]
        made.children = sorted([*made.children, *(Node(OTHER, c.start, c.end) for c in inside)], key=lambda n: n.start)
        return made, close + 1

    def statements(self, at: int, limit: int) -> list[Node]:
        out = []
        while at < limit:
            if self.c.is_(at, ";"):
                at += 1
                continue
            made, after = self.statement(at, limit)
            if made is not None:
                out.append(made)
            at = max(after, at + 1)
        return out

    def statement(self, at: int, limit: int) -> tuple[Node | None, int]:
        word = self.t[at].text if self.c.word(at) else ""
        if self.c.is_(at, "#") or self.fn_at(at, limit) is not None or (word in ("impl", "trait", "mod", "struct", "enum", "use", "type", "static", "macro_rules", "pub") or (word == "const" and self.c.word(at + 1))):
            return self.item(at, limit)
        if word == "let":
            i, children = at + 1, []
            while i < limit and not self.c.is_(i, "=", ";", ":"):
                i = self.c.close(i, limit) + 1 if self.c.is_(i, "(", "[", "{") else i + 1
            if self.c.is_(i, ":"):
                i = self.skip_type(i, limit, "=", ";")
            if self.c.is_(i, "="):
                children, i = self.expression(i + 1, limit)
            i += self.c.is_(i, ";")
            return self.node(OTHER, at, i, children), i
        children, i = self.expression(at, limit, whole=False)
        i += self.c.is_(i, ";")
        return self.node(OTHER, at, i, children), i

    def flow(self, at: int, limit: int) -> tuple[Node, int]:
        word, i, children = self.t[at].text, at + 1, []
        if word == "for":
            while i < limit and not self.c.is_(i, "in"):
                i = self.c.close(i, limit) + 1 if self.c.is_(i, "(", "[", "{") else i + 1
            i += 1
        if word != "loop":
            children, i = self.expression(i, limit, literal=False)
        if not self.c.is_(i, "{"):
            return self.node(PARENT, at, i, children), i
        if word == "match":
            close = self.c.close(i, limit)
            return self.node(PARENT, at, close + 1, [*children, self.node(OTHER, i, close + 1, self.arms(i + 1, close))]), close + 1
        made, i = self.block(i, limit)
        children.append(made)
        if word == "if" and self.c.is_(i, "else"):
            low = i
            made, i = self.flow(i + 1, limit) if self.c.is_(i + 1, "if") else self.block(i + 1, limit) if self.c.is_(i + 1, "{") else (self.node(OTHER, i, i + 1), i + 1)
            children.append(self.node(OTHER, low, i, [made]))
        return self.node(PARENT, at, i, children), i

    def arms(self, at: int, limit: int) -> list[Node]:
        out = []
        while at < limit:
            i = at
            while i < limit and not self.c.is_(i, "=>"):
                i = self.c.close(i, limit) + 1 if self.c.is_(i, "(", "[", "{") else i + 1
            children, end = self.expression(i + 1, limit, stops=(",",), whole=False)
            out.append(self.node(OTHER, at, end, children))
            at = max(end + self.c.is_(end, ","), at + 1)
        return out

    def inner(self, at: int, limit: int) -> list[Node]:
        out = []
        while at < limit:
            if self.c.is_(at, ",", ";"):
                at += 1
                continue
            more, end = self.expression(at, limit, stops=(",", ";"))
            out += more
            at = max(end, at + 1)
        return out

    def expression(self, at: int, limit: int, stops: tuple[str, ...] = (";",), literal: bool = True, whole: bool = True) -> tuple[list[Node], int]:
        """What an expression holds and the token after it; `whole`: it doesn't end with a block it starts with."""
        out, i = [], at
        while i < limit:
            token = self.t[i]
            text = token.text if token.kind in (PUNCT, WORD) else ""
            if text in stops or (token.kind == PUNCT and text in (")", "]", "}", ";")):
                break
            operand = i == at or (self.t[i - 1].kind == PUNCT and self.t[i - 1].text not in (")", "]", "}", "?")) or self.c.is_(i - 1, "return", "in", "move", "else", "match", "if", "while")
            if text in _FLOW and token.kind == WORD:
                made, after = self.flow(i, limit)
                out.append(made)
                ends = i == at and not whole and not self.c.is_(after, ".", "?")
                i = max(after, i + 1)
                if ends:
                    return out, i
            elif text == "{":
                if not literal:
                    break
                made, after = self.block(i, limit)
                out.append(made)
                ends = i == at and not whole and not self.c.is_(after, ".", "?")
                i = after
                if ends:
                    return out, i
            elif token.kind == WORD and self.c.is_(i + 1, "!") and self.c.is_(i + 2, "(", "[", "{"):
                brace = self.c.is_(i + 2, "{")
                first, i = i == at, self.c.close(i + 2, limit) + 1
                if first and brace and not whole:
                    return out, i
            elif token.kind == WORD and literal and self.c.is_(i + 1, "{") and text not in _RESERVED and (text[:1].isupper() or self.c.is_(i - 1, "::")) or (text == "Self" and literal and self.c.is_(i + 1, "{")):
                self.c.skip(i, i + 1)
                close = self.c.close(i + 1, limit)
                out += self.inner(i + 2, close)
                i = close + 1
            elif text == "::" and self.c.is_(i + 1, "<") and (close := self.c.angle_close(i + 1, limit, plain=False)) is not None:
                self.c.skip(i + 1, close + 1)
                i = close + 1
            elif text == "as" and i > at:
                i = max(self.skip_type(i + 1, limit, ",", "+", "-", "*", "/", "%", "==", "!=", ">=", "<=", "&&", "||", "?", ".", "{", "=>", "..", "..="), i + 1)
            elif text in ("|", "||") and operand:
                made, i = self.closure(i, limit, stops, literal)
                out.append(made)
            elif token.kind == PUNCT and text in ("(", "["):
                close = self.c.close(i, limit)
                out += self.inner(i + 1, close)
                i = close + 1
            else:
                i += 1
        return out, i

    def closure(self, at: int, limit: int, stops: tuple[str, ...], literal: bool) -> tuple[Node, int]:
        i = at + 1
        if self.c.is_(at, "|"):
            while i < limit and not self.c.is_(i, "|"):
                if self.c.is_(i, ":"):
                    i = self.skip_type(i, limit, "|", ",")
                else:
                    i = self.c.close(i, limit) + 1 if self.c.is_(i, "(", "[", "{") else i + 1
            i += 1
        if self.c.is_(i, "->"):
            i = self.skip_type(i, limit, "{")
        if self.c.is_(i, "{"):
            body, end = self.block(i, limit)
        else:
            more, end = self.expression(i, limit, (*stops, ","), literal)
            body = self.node(OTHER, i, end, more)
        return self.node(FUNCTION, at, end, [], Function(None, [], None, body)), end

    def parsed(self) -> Parsed:
        root = Node(OTHER, 0, len(self.c.text), self.items(0, len(self.t)))
        names = [(t.start, t.text.removeprefix("r#")) for i, t in enumerate(self.t) if t.kind == WORD and i not in self.c.skipped and t.text not in _RESERVED]
        return Parsed(root, names, self.c.errors())


class Rust(Language):
    name, extensions = "rust", (".rs",)
    stop_words = frozenset(_WORDS)

    def is_excluded(self, file_name: str) -> bool:
        return file_name == "build.rs"

    def is_exported(self, name: str, inside_export: bool) -> bool:
        return False

    def parse(self, text: str) -> Parsed:
        return _Reader(text).parsed()
