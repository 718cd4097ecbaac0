import pytest

from twinsift import chunker
from twinsift.chunker import is_source, parse_source


def by_name(text, path):
    chunks, errors = parse_source(text, path)
    return {c["function_name"]: c for c in chunks}, errors


def test_routing_and_exclusions():
    yes = ["a.ts", "b.tsx", "c.js", "d.mjs", "e.cjs", "f.jsx", "g.rs", "h.py"]
    no = ["a.d.ts", "a.test.ts", "a.spec.tsx", "a.test.mjs", "build.rs", "test_a.py", "a_test.py", "a_tests.py", "conftest.py", "setup.py", "a.go", "README.md"]
    assert all(is_source(f"src/{p}") for p in yes) and not any(is_source(f"src/{p}") for p in no)


def test_unsupported():
    assert parse_source("x", "a.go") == ([], ["Unsupported file: a.go"])


def test_short_functions_are_left_out():
    assert not by_name("function a() { return 1; }\nfunction b() {\n}\n", "a.js")[0]


def test_typescript():
    found, errors = by_name(
        "export const load = async <T>(id: string, ...rest: T[]): Promise<T> => {\n  const row = await db.find(id);\n  return row as T;\n};\n"
        "class Box {\n  open(a?: number) {\n    return a;\n  }\n}\n"
        "run(() => {\n  quiet();\n  quiet();\n});\n",
        "a.ts",
    )
    assert not errors and set(found) == {"load", "open"}
    load = found["load"]
    assert load["params"] == [{"name": "id", "type": "string"}, {"name": "...rest", "type": "T[]"}]
    assert load["return_type"] == "Promise<T>" and load["is_exported"] and load["id"] == "a.ts:load:1" and load["end_line"] == 4
    assert load["tokens"] == ["db", "find", "id", "load", "rest", "row"] and "promise" not in load["tokens"]
    assert not found["open"]["is_exported"] and found["open"]["signature"] == "(a: number)"


def test_blocks_of_scripts():
    body = "\n".join(f"    step{i}();" for i in range(4))
    text = f"function outer(a) {{\n  if (a) {{\n    while (a) {{ a--; }}\n{body}\n  }} else {{\n    while (a) {{ a--; }}\n{body}\n  }}\n  list.map((x) => {{\n    if (x) {{ y(); }}\n{body}\n  }});\n}}\n"
    found, _ = by_name(text, "a.js")
    assert [n for n in found if n.startswith("<")] == ["<block:2>", "<block:15>"]
    assert all(found[n]["context"] == "outer" and found[n]["chunk_type"] == "block" for n in found if n.startswith("<"))
    assert found["<block:2>"]["signature"] == "<block> (7 lines)"


@pytest.mark.parametrize("text", ["const a = /[/}]/.test(b);", "const a = `x${ f({a: `}`}) }y`;", "// }\n/* } */", "const s = '}' + \"}\";"])
def test_braces_in_literals(text):
    found, errors = by_name(f"function f() {{\n  {text}\n  return 1;\n}}\nfunction g() {{\n  1;\n  2;\n}}\n", "a.ts")
    assert set(found) == {"f", "g"} and not errors


def test_jsx():
    text = "export default function App({ a }) {\n  return (\n    <p title=\"it's\" onClick={() => go(a)}>\n      Don't {a ? <b>yes</b> : null}\n    </p>\n  );\n}\n"
    found, errors = by_name(text, "a.tsx")
    assert set(found) == {"App"} and not errors and found["App"]["end_line"] == 7


def test_rust():
    text = "impl S {\n    pub async fn load<'a>(&mut self, path: &'a str) -> Result<Vec<u8>, E> {\n        let c = 'x';\n        let s = r#\"}\"#;\n        self.read(path, |b| b + 1)\n    }\n}\n"
    found, errors = by_name(text, "a.rs")
    load = found["load"]
    assert not errors and load["params"] == [{"name": "&mut self", "type": None}, {"name": "path", "type": "&'a str"}]
    assert load["return_type"] == "Result<Vec<u8>, E>" and not load["is_exported"] and load["tokens"] == ["load", "path", "read"]


def test_python():
    text = "class A:\n    @deco\n    async def go(self, a: int, *rest, b=2, **kw) -> str:\n        if a:\n            x = one(a)\n            for i in x:\n                two(i)\n            # note\n            y = x\n            z = y\n        return z\n\ndef _hidden(a):\n    b = a\n    return b\n"
    found, errors = by_name(text, "a.py")
    assert not errors and found["go"]["start_line"] == 3 and found["go"]["is_exported"] and not found["_hidden"]["is_exported"]
    assert found["go"]["signature"] == "(self, a: int, *rest, b, **kw) => str"
    assert found["<block:5>"]["context"] == "go" and found["<block:5>"]["source_text"].startswith("x = one(a)")


def test_python_goes_on_after_errors():
    found, errors = by_name("def broken(:\n    pass\n\ndef fine(a):\n    b = a\n    return b\n", "a.py")
    assert set(found) == {"fine"} and errors[0] == "Parse error at line 1: def broken(:"


def test_unbalanced_scripts_are_reported():
    found, errors = by_name("function a() {\n  b(;\n  c();\n}\n", "a.js")
    assert errors and errors[0].startswith("Parse error at line")


def test_table_function(spark):
    files = spark.createDataFrame([("a.py", "def f(a):\n    b = a\n    return b\n"), ("b.go", "x"), ("c.py", None)], "file_path string, source string")
    rows = chunker.parse_files(files).collect()
    assert [r["id"] for r in rows if r["id"]] == ["a.py:f:1"] and sorted(r["error"] for r in rows if r["error"]) == ["Unreadable file: c.py", "Unsupported file: b.go"]
    files.createOrReplaceTempView("files")
    chunker.register_sql(spark)
    found = spark.sql("SELECT c.id, c.tokens FROM files, LATERAL chunk_source(file_path, source) c WHERE c.id IS NOT NULL").collect()
    assert [tuple(r) for r in found] == [("a.py:f:1", [])]


def test_plug_in():
    from twinsift.chunker.tree import FUNCTION, OTHER, Function, Language, Node, Parsed

    class Toy(Language):
        extensions = (".toy",)

        def parse(self, text):
            return Parsed(Node(OTHER, 0, len(text), [Node(FUNCTION, 0, len(text), [], Function("all"))]), [(0, "Word")])

    chunker.register(Toy())
    try:
        assert by_name("Word\n1\n2", "x.toy")[0]["all"]["tokens"] == ["word"]
    finally:
        chunker.LANGUAGES.pop(0)


def test_many_faults():
    good = "def good(a):\n    b = a\n    return b\n"
    for bad in ("x = = 1\n", "def (:\n", ")\n", "    y = 1 +\n", "a\0b\n"):
        for count in (30, 60, 400):
            found, errors = by_name(good + bad * count + "@dec\n" + good.replace("good", "last"), "a.py")
            assert set(found) == {"good", "last"} and len(errors) >= count // 2
            assert found["last"]["start_line"] in (count + 4, count + 5)
    assert parse_source("\0", "a.py")[0] == [] and parse_source("(" * 5000 + "\n" + good, "a.py")[0][0]["function_name"] == "good"
    assert len(parse_source(")\n" * 50, "a.ts")[1]) == 50


class Lines(chunker.Language):
    """A language of the test: every file is one function."""

    name, extensions = "lines", (".lines",)

    def parse(self, text):
        from twinsift.chunker.tree import FUNCTION, OTHER, Function, Node, Parsed

        return Parsed(Node(OTHER, 0, len(text), [Node(FUNCTION, 0, len(text), [], Function(text.split()[0]))]), [])


def test_registered_languages_reach_executors(spark):
    chunker.register(Lines())
    try:
        rows = chunker.parse_files(spark.createDataFrame([("a.lines", "first\nb\nc\n")], "file_path string, source string")).collect()
        assert [(r["function_name"], r["error"]) for r in rows] == [("first", None)]
        chunker.register_sql(spark, "chunk_lines")
        assert spark.sql("SELECT function_name FROM chunk_lines('a.lines', 'other\\nb\\nc\\n')").first()[0] == "other"
    finally:
        chunker.LANGUAGES.pop(0)
    assert chunker.parse_files(spark.createDataFrame([("a.lines", "x\ny\nz\n")], "file_path string, source string")).first()["error"] == "Unsupported file: a.lines"
