"""JavaScript, TypeScript and their JSX forms, read by recursive descent over a tolerant lexer."""

from __future__ import annotations

from .lexer import PUNCT, WORD, Cursor, ScriptLexer
from .tree import BLOCK, CONTROL, EXPORT, FUNCTION, OTHER, PARENT, Function, Language, Node, Parsed

# Words that say nothing about what code does.
_WORDS = ["const", "let", "var", "function", "return", "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "try", "catch", "finally", "throw", "new", "this", "typeof", "instanceof", "void", "delete", "in", "of", "import", "export", "from", "default", "async", "await", "class", "extends", "true", "false", "null", "undefined"]
_TYPE_WORDS = ["implements", "interface", "type", "enum"]

#: Words of the grammar that are no identifiers.
_RESERVED = frozenset([*_WORDS, "yield", "with", "super", "debugger", "static", "get", "set"]) - {"of", "from", "async", "get", "set", "static", "undefined"}
_GOES_ON = frozenset([".", "?.", "(", "[", "`", "+", "-", "*", "/", "%", "=", "=>", "?", ":", ",", "&&", "||", "??", "===", "!==", "==", "!=", "<", ">", "<=", ">=", "&", "|", "^", "in", "instanceof", "as", "satisfies"])
_MODIFIERS = frozenset(["static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor"])


class _Reader:
    def __init__(self, text: str, typed: bool, jsx: bool):
        self.typed = typed
        self.c = Cursor(text, ScriptLexer(text, jsx).run())
        self.t = self.c.tokens

    # --- helpers

    def node(self, role: str, low: int, high: int, children=(), function=None) -> Node:
        """A node over tokens [low, high)."""
        if low >= len(self.t) or high <= low:
            at = self.t[low].start if low < len(self.t) else len(self.c.text)
            return Node(role, at, at, list(children), function)
        return Node(role, self.t[low].start, self.t[high - 1].end, list(children), function)

    def source(self, low: int, high: int) -> str:
        return self.c.text[self.t[low].start : self.t[high - 1].end] if high > low else ""

    def with_comments(self, block: Node) -> Node:
        inside = [c for c in self.c.comments if block.start <= c.start < block.end and not any(n.start <= c.start < n.end for n in block.children)]
        block.children = sorted([*block.children, *(Node(OTHER, c.start, c.end) for c in inside)], key=lambda n: n.start)
        return block

    # --- statements

    def statements(self, at: int, limit: int) -> list[Node]:
        out = []
        while at < limit:
            if self.c.is_(at, ";"):
                at += 1
                continue
            made, after = self.statement(at, limit)
            out.append(made)
            at = max(after, at + 1)
        return out

    def block(self, at: int, limit: int) -> tuple[Node, int]:
        close = self.c.close(at, limit)
        return self.with_comments(self.node(BLOCK, at, close + 1, self.statements(at + 1, close))), close + 1

    def body(self, at: int, limit: int) -> tuple[Node, int]:
        return self.block(at, limit) if self.c.is_(at, "{") else self.statement(at, limit) if at < limit else (self.node(OTHER, at, at), at)

    def head(self, at: int, limit: int) -> tuple[list[Node], int]:
        """A condition in parentheses."""
        if not self.c.is_(at, "("):
            return [], at
        close = self.c.close(at, limit)
        return self.inner(at + 1, close), close + 1

    def statement(self, at: int, limit: int) -> tuple[Node, int]:
        c = self.c
        if c.is_(at, "{"):
            return self.block(at, limit)
        word = self.t[at].text if c.word(at) else ""
        if word in ("if", "for", "while", "do", "try", "switch") and not c.is_(at + 1, ":", "="):
            return getattr(self, f"_{word}")(at, limit)
        if word == "function" or (word == "async" and c.is_(at + 1, "function")):
            return self.function(at, limit)
        if word == "class" or (word == "abstract" and c.is_(at + 1, "class")):
            return self.klass(at, limit)
        if word in ("const", "let", "var") and not (word == "const" and c.is_(at + 1, "enum")):
            return self.declaration(at, limit)
        if word == "export":
            return self.export(at, limit)
        if self.typed and word in ("interface", "type", "declare", "namespace", "module", "enum", "const") and (c.word(at + 1) or word == "declare"):
            return self.type_statement(at, limit)
        if word == "import" and not c.is_(at + 1, "(", "."):
            end = self.statement_end(at, limit)
            return self.node(OTHER, at, end), end
        if c.word(at) and c.is_(at + 1, ":") and word not in ("default", "case"):
            made, end = self.statement(at + 2, limit) if at + 2 < limit else (self.node(OTHER, at, at + 2), at + 2)
            return self.node(OTHER, at, end, [made]), end
        start = at + 1 if word in ("return", "throw", "await", "yield") else at
        children, end = self.expression(start, limit)
        end += c.is_(end, ";") and end < limit
        return self.node(OTHER, at, max(end, at + 1), children), max(end, at + 1)

    def _if(self, at: int, limit: int) -> tuple[Node, int]:
        children, after = self.head(at + 1, limit)
        made, after = self.body(after, limit)
        children.append(made)
        after += c_semicolon(self.c, after, limit, made)
        if self.c.is_(after, "else"):
            low = after
            made, after = self.body(after + 1, limit)
            children.append(self.node(OTHER, low, after, [made]))
        return self.node(PARENT, at, after, children), after

    def _for(self, at: int, limit: int) -> tuple[Node, int]:
        start = at + 1 + self.c.is_(at + 1, "await")
        children, after = self.head(start, limit)
        made, after = self.body(after, limit)
        return self.node(PARENT, at, after, [*children, made]), after

    def _while(self, at: int, limit: int) -> tuple[Node, int]:
        return self._for(at, limit)

    def _do(self, at: int, limit: int) -> tuple[Node, int]:
        made, after = self.body(at + 1, limit)
        children = [made]
        if self.c.is_(after, "while"):
            more, after = self.head(after + 1, limit)
            children += more
            after += self.c.is_(after, ";")
        return self.node(PARENT, at, after, children), after

    def _try(self, at: int, limit: int) -> tuple[Node, int]:
        made, after = self.body(at + 1, limit)
        children = [made]
        while self.c.is_(after, "catch", "finally") and after < limit:
            low = after
            more, after = self.head(after + 1, limit)
            made, after = self.body(after, limit)
            children.append(self.node(OTHER, low, after, [*more, made]))
        return self.node(PARENT, at, after, children), after

    def _switch(self, at: int, limit: int) -> tuple[Node, int]:
        children, after = self.head(at + 1, limit)
        if not self.c.is_(after, "{"):
            return self.node(CONTROL, at, after, children), after
        close, i = self.c.close(after, limit), after + 1
        while i < close:
            if self.c.is_(i, "case", "default"):
                more, i = self.expression(i + 1, close, stops=(":",))
                children += more
                i += 1
            else:
                made, after = self.statement(i, close)
                children.append(made)
                i = max(after, i + 1)
        return self.node(CONTROL, at, close + 1, children), close + 1

    def statement_end(self, at: int, limit: int) -> int:
        i = at
        while i < limit and not self.c.is_(i, ";"):
            if self.t[i].kind == PUNCT and self.t[i].text in Cursor.OPEN:
                i = self.c.close(i, limit)
            i += 1
            if i < limit and self.t[i].breaks and not self.c.is_(i, "from", ",", "{", ".", "|", "&", "=") and not self.c.is_(i - 1, ",", "from", "=", "|", "&", "import"):
                return i
        return min(limit, i + 1)

    def type_statement(self, at: int, limit: int) -> tuple[Node, int]:
        word = self.t[at].text
        if word == "declare":
            made, end = self.statement(at + 1, limit) if at + 1 < limit else (self.node(OTHER, at, at + 1), at + 1)
            return self.node(OTHER, at, end, [made]), end
        i = at + 1
        while i < limit and not self.c.is_(i, "{", "=", ";"):
            i += 1
        if word in ("namespace", "module") and self.c.is_(i, "{"):
            made, end = self.block(i, limit)
            return self.node(OTHER, at, end, [made]), end
        if word == "type":
            end = self.type_end(i + 1, limit, (";",), True) if self.c.is_(i, "=") else i
            end += self.c.is_(end, ";")
        else:
            end = self.c.close(i, limit) + 1 if self.c.is_(i, "{") else i
        return self.node(OTHER, at, end), end

    def export(self, at: int, limit: int) -> tuple[Node, int]:
        i = at + 1
        if self.c.is_(i, "default"):
            i += 1
            if self.c.is_(i, "function", "class", "async", "abstract", "interface"):
                made, end = self.statement(i, limit)
                return self.node(EXPORT, at, end, [made]), end
            children, end = self.expression(i, limit)
            end += self.c.is_(end, ";")
            return self.node(EXPORT, at, max(end, i), children), max(end, i)
        if self.c.is_(i, "{", "*", "=") or (self.c.is_(i, "type") and self.c.is_(i + 1, "{", "*")):
            end = self.statement_end(i, limit)
            return self.node(EXPORT, at, end), end
        made, end = self.statement(i, limit) if i < limit else (self.node(OTHER, at, i), i)
        return self.node(EXPORT, at, end, [made]), end

    def declaration(self, at: int, limit: int) -> tuple[Node, int]:
        """Variables; a declaration with a function value is a function with the first such variable's name."""
        i, children, named, first = at + 1, [], None, None
        while i < limit:
            low = i
            i = self.c.close(i, limit) + 1 if self.c.is_(i, "{", "[") else i + 1
            name = self.source(low, i)
            i += self.c.is_(i, "!")
            if self.typed and self.c.is_(i, ":"):
                end = self.type_end(i + 1, limit, ("=", ",", ";", "of", "in"), True)
                self.c.skip(i, end)
                i = end
            if self.c.is_(i, "="):
                more, end = self.expression(i + 1, limit, stops=(",", ";"))
                whole = more[0] if len(more) == 1 and more[0].role == FUNCTION and self.spans(more[0], i + 1, end) else None
                if whole is not None and named is None:
                    named, first = name, whole.function
                children += more
                i = end
            if not self.c.is_(i, ","):
                break
            i += 1
        i = min(limit, i + self.c.is_(i, ";"))
        if named is not None:
            return self.node(FUNCTION, at, i, children, Function(named, first.params, first.return_type, first.body)), i
        return self.node(OTHER, at, i, children), i

    def spans(self, node: Node, low: int, high: int) -> bool:
        return high > low and node.start == self.t[low].start and node.end == self.t[high - 1].end

    # --- functions and classes

    def function(self, at: int, limit: int) -> tuple[Node, int]:
        i = at + 1 + self.c.is_(at, "async")
        i += self.c.is_(i, "*")
        name = None
        if self.c.word(i):
            name, i = self.t[i].text, i + 1
        return self.callable(at, i, limit, name)

    def callable(self, at: int, i: int, limit: int, name: str | None) -> tuple[Node, int]:
        """Type parameters, parameters, return type and body from token i on, for a function that starts at `at`."""
        if self.c.is_(i, "<") and (close := self.c.angle_close(i, limit)) is not None:
            self.c.skip(i, close + 1)
            i = close + 1
        children, params, kind = [], [], None
        if self.c.is_(i, "("):
            close = self.c.close(i, limit)
            params, children = self.params(i + 1, close)
            i = close + 1
        if self.typed and self.c.is_(i, ":"):
            end = self.type_end(i + 1, limit, ("{", ";", "=>", ","), True)
            kind = self.source(i + 1, end) or None
            self.c.skip(i, end)
            i = end
        body = None
        if self.c.is_(i, "{"):
            body, i = self.block(i, limit)
        return self.node(FUNCTION, at, i, children, Function(name, params, kind, body)), i

    def params(self, at: int, limit: int) -> tuple[list[tuple[str, str | None]], list[Node]]:
        out, children = [], []
        while at < limit:
            while self.c.is_(at, *_MODIFIERS) and self.c.word(at + 1) or self.c.is_(at, "@"):
                self.c.skip(at, at + 1)
                at += 1
            rest = self.c.is_(at, "...")
            at += rest
            low = at
            at = self.c.close(at, limit) + 1 if self.c.is_(at, "{", "[") else at + 1
            name = ("..." if rest else "") + self.source(low, min(at, limit))
            at += self.c.is_(at, "?")
            kind = None
            if self.typed and self.c.is_(at, ":"):
                end = self.type_end(at + 1, limit, (",", "="), False)
                kind = self.source(at + 1, end) or None
                self.c.skip(at, end)
                at = end
            if self.c.is_(at, "=") and at < limit:
                more, at = self.expression(at + 1, limit, stops=(",",))
                children += more
            while at < limit and not self.c.is_(at, ","):
                at += 1
            at += 1
            if name:
                out.append((name, kind))
        return out, children

    def klass(self, at: int, limit: int) -> tuple[Node, int]:
        i = at
        while i < limit and not self.c.is_(i, "{"):
            if self.c.is_(i, "<") and (close := self.c.angle_close(i, limit)) is not None:
                self.c.skip(i, close + 1)
                i = close
            i = self.c.close(i, limit) + 1 if self.c.is_(i, "(") else i + 1
        if i >= limit:
            return self.node(OTHER, at, limit), limit
        close = self.c.close(i, limit)
        return self.node(OTHER, at, close + 1, self.members(i + 1, close, ";")), close + 1

    def members(self, at: int, limit: int, gap: str) -> list[Node]:
        """Members of a class (gap ;) or an object literal (gap ,)."""
        out = []
        while at < limit:
            if self.c.is_(at, gap, ";"):
                at += 1
                continue
            if self.c.is_(at, "..."):
                more, at = self.expression(at + 1, limit, stops=(",",))
                out += more
                continue
            low = at
            while at + 1 < limit and (self.c.is_(at, *_MODIFIERS) and not self.c.is_(at + 1, "(", "=", ":", ",", ";", "?", "}") or self.c.is_(at, "*")):
                at += 1
            name_at = at
            if self.c.is_(at, "{") and gap == ";":  # static initialiser
                made, at = self.block(at, limit)
                out.append(made)
                continue
            at = self.c.close(at, limit) + 1 if self.c.is_(at, "[", "{", "(") else at + 1
            name = self.source(name_at, min(at, limit))
            at += self.c.is_(at, "?", "!")
            if self.c.is_(at, "(") or (self.c.is_(at, "<") and (end := self.c.angle_close(at, limit)) is not None and self.c.is_(end + 1, "(")):
                made, end = self.callable(low, at, limit, name)
                if made.function.body is None and gap == ";":
                    made = self.node(OTHER, low, end)  # a signature without a body
                out.append(made)
                at = max(end, at + 1)
                continue
            if gap == ";" and self.typed and self.c.is_(at, ":"):
                end = self.type_end(at + 1, limit, ("=", ";"), True)
                self.c.skip(at, end)
                at = end
            if self.c.is_(at, "=" if gap == ";" else ":") or (gap == "," and self.c.is_(at, "=")):
                more, at = self.expression(at + 1, limit, stops=(gap,))
                out += more
            at = max(at, low + 1)
        return out

    # --- types

    def type_end(self, at: int, limit: int, stops: tuple[str, ...], lines: bool) -> int:
        """The token after a type that starts at `at`; an open brace ends it only where a type can't go on."""
        i, ready = at, True
        while i < limit:
            token = self.t[i]
            if ready and token.kind == PUNCT and token.text in Cursor.OPEN:
                arrow = token.text == "("
                i = self.c.close(i, limit) + 1
                if arrow and self.c.is_(i, "=>"):
                    i += 1
                    continue
                ready = False
                continue
            if self.c.is_(i, *stops) or (token.kind == PUNCT and token.text in (")", "]", "}")):
                return i
            if lines and not ready and token.breaks and not self.c.is_(i, "|", "&", ".", "[", "<", "=>", "extends", "?", ":"):
                return i
            if self.c.is_(i, "<") and (close := self.c.angle_close(i, limit)) is not None:
                i, ready = close + 1, False
            elif self.c.is_(i, "["):
                i = self.c.close(i, limit) + 1
            elif self.c.is_(i, "|", "&", ".", "=>", "?", ":") or self.c.is_(i, "keyof", "typeof", "readonly", "is", "extends", "infer", "asserts", "new", "unique"):
                i, ready = i + 1, True
            else:
                i, ready = i + 1, False
        return i

    # --- expressions

    def inner(self, at: int, limit: int) -> list[Node]:
        """All that a bracket holds: expressions between commas and semicolons, declarations too."""
        out = []
        while at < limit:
            if self.c.is_(at, ",", ";", "of", "in", ":", "..."):
                at += 1
                continue
            if self.c.is_(at, "const", "let", "var"):
                made, end = self.declaration(at, limit)
                out.append(made)
            else:
                more, end = self.expression(at, limit, stops=(",", ";"))
                out += more
            at = max(end, at + 1)
        return out

    def arrow(self, at: int, limit: int) -> int | None:
        """The `=>` of an arrow function that starts at `at`, if one does."""
        i = at + (self.c.is_(at, "async") and (self.c.word(at + 1) or self.c.is_(at + 1, "(", "<")))
        if self.typed and self.c.is_(i, "<") and (close := self.c.angle_close(i, limit)) is not None:
            i = close + 1
        if self.c.is_(i, "("):
            i = self.c.close(i, limit) + 1
            if self.typed and self.c.is_(i, ":"):
                i = self.type_end(i + 1, limit, ("=>", ",", ";", "{"), False)
        elif self.c.word(i) and self.t[i].text not in _RESERVED:
            i += 1
        else:
            return None
        return i if self.c.is_(i, "=>") and i < limit else None

    def read_arrow(self, at: int, sign: int, limit: int, stops: tuple[str, ...]) -> tuple[Node, int]:
        i = at + (self.c.is_(at, "async") and at + 1 != sign)
        kind, params, children = None, [], []
        if self.c.is_(i, "<") and (close := self.c.angle_close(i, limit)) is not None:
            self.c.skip(i, close + 1)
            i = close + 1
        if self.c.is_(i, "("):
            close = self.c.close(i, limit)
            params, children = self.params(i + 1, close)
            if self.c.is_(close + 1, ":"):
                kind = self.source(close + 2, sign) or None
                self.c.skip(close + 1, sign)
        else:
            params = []
        if self.c.is_(sign + 1, "{"):
            body, end = self.block(sign + 1, limit)
        else:
            more, end = self.expression(sign + 1, limit, stops)
            body = self.node(OTHER, sign + 1, end, more)
        return self.node(FUNCTION, at, end, children, Function(None, params, kind, body)), end

    def operand_start(self, at: int) -> int:
        """Where the chain of members and calls that ends before token `at` starts."""
        i = at - 1
        while i > 0:
            if self.t[i].kind == PUNCT and self.t[i].text in (")", "]", "}") and i in self.c.partner:
                i = self.c.partner[i]
                if self.c.word(i - 1) or self.c.is_(i - 1, ")", "]", ".", "?."):
                    i -= 1
                    continue
                return i
            if self.c.is_(i - 1, ".", "?.", "!"):
                i -= 2
                continue
            return i
        return max(i, 0)

    def expression(self, at: int, limit: int, stops: tuple[str, ...] = (";",)) -> tuple[list[Node], int]:
        """Functions, classes and blocks of an expression, and the token after it."""
        out, i = [], at
        while i < limit:
            token = self.t[i]
            text = token.text if token.kind in (PUNCT, WORD) else ""
            if text in stops or text == ";" or (token.kind == PUNCT and text in (")", "]", "}")):
                break
            if i > at and token.breaks and self.ends_line(i):
                break
            sign = self.arrow(i, limit) if text in ("(", "async", "<") or (token.kind == WORD and self.c.is_(i + 1, "=>")) else None
            if sign is not None and not (self.c.word(i - 1) and i > at and text == "(" and self.t[i - 1].text not in _RESERVED):
                made, i = self.read_arrow(i, sign, limit, stops)
                out.append(made)
            elif text == "function" or (text == "async" and self.c.is_(i + 1, "function")):
                made, i = self.function(i, limit)
                out.append(made)
            elif text == "class" and not self.c.is_(i - 1, ".", "?."):
                made, i = self.klass(i, limit)
                out.append(made)
            elif text == "{":
                close = self.c.close(i, limit)
                out += self.members(i + 1, close, ",")
                i = close + 1
            elif token.kind == PUNCT and text in ("(", "[", "${"):
                close = self.c.close(i, limit)
                out += self.inner(i + 1, close)
                i = close + 1
            elif self.typed and text in ("as", "satisfies") and i > at and not self.c.is_(i - 1, ".", "?.", ","):
                end = self.type_end(i + 1, limit, (*stops, ",", ";", ")", "=", "?", "&&", "||", "??", "===", "!=="), True)
                self.c.skip(max(at, self.operand_start(i)), end)
                i = max(end, i + 1)
            elif self.typed and text == "<" and self.c.word(i - 1) and (close := self.c.angle_close(i, limit)) is not None and self.c.is_(close + 1, "("):
                self.c.skip(i, close + 1)
                i = close + 1
            else:
                i += 1
        return out, i

    def ends_line(self, at: int) -> bool:
        """Whether a line break before token `at` ends a statement."""
        before, token = self.t[at - 1], self.t[at]
        if token.kind in (PUNCT, WORD) and token.text in _GOES_ON:
            return False
        if before.kind == PUNCT and before.text not in (")", "]", "}", "++", "--"):
            return False
        return not (before.kind == WORD and before.text in ("return", "typeof", "new", "in", "of", "instanceof", "await", "case", "else", "extends", "as") and before.text != "return")

    def parsed(self) -> Parsed:
        root = Node(OTHER, 0, len(self.c.text), self.statements(0, len(self.t)))
        names = [(t.start, t.text.lstrip("#@")) for i, t in enumerate(self.t) if t.kind == WORD and i not in self.c.skipped and not (t.text in _RESERVED and not self.c.is_(i - 1, ".", "?."))]
        return Parsed(root, names, self.c.errors())


def c_semicolon(c: Cursor, at: int, limit: int, made: Node) -> int:
    """A semicolon between a branch without braces and its else."""
    return int(at < limit and made.role != BLOCK and c.is_(at, ";") and c.is_(at + 1, "else"))


class JavaScript(Language):
    name, extensions = "javascript", (".js", ".mjs", ".cjs", ".jsx")
    stop_words = frozenset(_WORDS)

    def is_excluded(self, file_name: str) -> bool:
        return file_name.endswith(tuple(f".{kind}{end}" for kind in ("test", "spec") for end in self.extensions))

    def parse(self, text: str) -> Parsed:
        return _Reader(text, False, True).parsed()


class TypeScript(Language):
    name, extensions = "typescript", (".ts",)
    stop_words = frozenset(_WORDS + _TYPE_WORDS)

    def is_excluded(self, file_name: str) -> bool:
        return file_name.endswith((".d.ts", ".test.ts", ".spec.ts"))

    def parse(self, text: str) -> Parsed:
        return _Reader(text, True, False).parsed()


class TypeScriptJsx(TypeScript):
    name, extensions = "tsx", (".tsx",)

    def is_excluded(self, file_name: str) -> bool:
        return file_name.endswith((".test.tsx", ".spec.tsx"))

    def parse(self, text: str) -> Parsed:
        return _Reader(text, True, True).parsed()


