"""Source files of every language made from `documents`, a file for each row, and the chunks that they must have.

A file's text is one of TEMPLATES with the row's id in the place of `§`, so names, tokens and ids differ from file to
file. What is expected of each template is written out by hand. (Rust has no blocks here: a control structure that stands as a
statement counts as the statement around it.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chunker import parse_files
from .tables import table


@dataclass
class Expected:
    """A chunk: params and their types as text, tokens with spaces between; hashed, for blocks, is the block's text."""

    name: str
    lines: tuple[int, int]
    tokens: str
    params: str = ""
    types: str = ""
    returns: str | None = None
    exported: bool = False
    context: str | None = None
    hashed: str | None = None


_BLOCK_TS = "{\n      use§(x);\n      if (x) {\n        drop(x);\n      }\n      keep(x);\n    }"
_BLOCK_PY = "x = one(a§)\n            for i in x:\n                two(i)\n            y = x\n            z = y\n            w = z"
_BLOCK_RS = "{\n            one(item);\n            three(item);\n            if item > 1 {\n                two(item)\n            }\n        }"

#: (file's ending, text, chunks)
TEMPLATES: list[tuple[str, str, list[Expected]]] = [
    (".ts", "\nfunction greet§(name: string): string {\n    const greeting = \"Hello, \" + name;\n    return greeting;\n}\n", [Expected("greet§", (2, 5), "greet§ greeting name", "name: string", "string", "string")]),
    (".ts", "const add§ = (a1: number, b1?: number): number => {\n  const sum = a1 + b1;\n  return sum;\n};\n", [Expected("add§", (1, 4), "a1 add§ b1 sum", "a1: number, b1: number", "number,number", "number")]),
    (".ts", "export class Box§ {\n  open(value: Map<string, number>): void {\n    console.log(value);\n    return;\n  }\n}\n", [Expected("open", (2, 5), "console log open value", "value: Map<string, number>", "map<string,number>", "void", True)]),
    (".ts", "function tiny§(x: number) { return x; }\n", []),
    (".js", "export function run§(x) {\n  if (x) {\n    return x;\n  }\n}\n", [Expected("run§", (1, 5), "run§", "x", "any", None, True)]),
    (".mjs", "function walk§(x) {\n  while (x) {\n    if (x.y) " + _BLOCK_TS + "\n  }\n}\n", [Expected("walk§", (1, 11), "drop keep use§ walk§", "x", "any"), Expected("<block:3>", (3, 9), "drop keep use§", context="walk§", hashed=_BLOCK_TS)]),
    (".jsx", "export default function App§({ title }) {\n  return (\n    <p>{title}</p>\n  );\n}\n", [Expected("App§", (1, 5), "app§ title", "{ title }", "any", None, True)]),
    (".py", "@deco\nasync def go§(self, count: int, *rest, flag=2, **kw) -> str:\n    value = count\n    return value\n", [Expected("go§", (2, 4), "count flag go§ int kw rest str value", "self, count: int, *rest, flag, **kw", "any,int,any,any,any", "str", True)]),
    (".py", "class Tool§:\n    def _hidden(self, a§):\n        if a§:\n            " + _BLOCK_PY + "\n        return a§\n", [Expected("_hidden", (2, 10), "_hidden a§ one two", "self, a§", "any,any"), Expected("<block:4>", (4, 9), "a§ one two", context="_hidden", hashed=_BLOCK_PY)]),
    (".rs", "impl Store§ {\n    pub fn load(&self, path: &str) -> Result<u8, E> {\n        let row = read(path);\n        Ok(row)\n    }\n}\n", [Expected("load", (2, 5), "load path read row", "&self, path: &str", "any,&str", "Result<u8, E>")]),
    (".rs", "fn each§(items: Vec<u8>) {\n    for item in items {\n        while item > 0 " + _BLOCK_RS + "\n    }\n}\n", [Expected("each§", (1, 11), "each§ item items one three two", "items: Vec<u8>", "vec<u8>")]),
    (".go", "package main§\n", []),
]


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, source): a file for each document."""
    which = F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int") + 1
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), which)
    ident = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return rows.select(F.concat(F.lit("f"), ident, of([ending for ending, _, _ in TEMPLATES])).alias("file_path"), F.replace(of([text for _, text, _ in TEMPLATES]), F.lit("§"), ident).alias("source"))


def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of these files."""
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")))), ", ")
    found = parse_files(source_files(spark, sf_dir)).where("id is not null")
    return found.select("id", "file_path", "function_name", "start_line", "end_line", params.alias("params"), "return_type", "is_exported", "signature", "signature_hash", F.array_join("tokens", " ").alias("tokens"), "chunk_type", "context")


def chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of these files."""
    return parse_files(source_files(spark, sf_dir)).where("error is not null").select("file_path", "error")


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _expected_sql() -> str:
    rows = []
    for number, (ending, _, chunks) in enumerate(TEMPLATES):
        for c in chunks:
            values = [_quoted(v) for v in (ending, c.name, c.tokens, c.params, c.types, c.returns, c.context, c.hashed)]
            rows.append(f"({number}, {c.lines[0]}, {c.lines[1]}, {str(c.exported).lower()}, {', '.join(values)})")
    return ", ".join(rows)


CHUNK_SOURCES_SQL = f"""
WITH t(which, start_line, end_line, is_exported, ending, name, tokens, params, types, returns, context, hashed) AS (VALUES {_expected_sql()}),
f AS (SELECT 'f' || doc_id || ending AS file_path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, is_exported, hashed IS NOT NULL AS block,
             replace(name, '§', doc_id::VARCHAR) AS function_name, list_aggregate(list_sort(string_split(replace(tokens, '§', doc_id::VARCHAR), ' ')), 'string_agg', ' ') AS tokens,
             replace(params, '§', doc_id::VARCHAR) AS params, types, CAST(returns AS VARCHAR) AS return_type, replace(CAST(context AS VARCHAR), '§', doc_id::VARCHAR) AS context,
             replace(CAST(hashed AS VARCHAR), '§', doc_id::VARCHAR) AS hashed
      FROM documents JOIN t ON doc_id % {len(TEMPLATES)} = which)
SELECT file_path || ':' || function_name || ':' || start_line AS id, file_path, function_name, start_line, end_line, params, return_type, is_exported,
       CASE WHEN block THEN '<block> (' || (end_line - start_line + 1) || ' lines)' ELSE '(' || params || ')' || coalesce(' => ' || return_type, '') END AS signature,
       substr(sha256(CASE WHEN block THEN hashed ELSE lower(function_name) || '(' || types || '):' || lower(replace(coalesce(return_type, 'void'), ' ', '')) END), 1, 16) AS signature_hash,
       tokens, CASE WHEN block THEN 'block' ELSE 'function' END AS chunk_type, context
FROM f
"""

CHUNK_ERRORS_SQL = f"""
SELECT 'f' || doc_id || '.go' AS file_path, 'Unsupported file: f' || doc_id || '.go' AS error FROM documents WHERE doc_id % {len(TEMPLATES)} = {len(TEMPLATES) - 1}
"""
