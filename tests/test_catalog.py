"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from twinsift.plans.catalog import CATALOG

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")


def rows(names, values):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted(repr([plain(row[names.index(n)]) for n in sorted(names)]) for row in values)


@pytest.mark.parametrize("name", [name for name, (_, sql) in CATALOG.items() if sql])
def test_same_as_sql(spark, name):
    query, sql = CATALOG[name]
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path if path.is_file() else f'{path}/*.parquet'}'")
    result = query(spark, str(DATA))
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(result.columns)
    expected = found.fetchall()
    assert rows(names, expected) == rows(result.columns, [tuple(r) for r in result.collect()])


def test_without_sql(spark):
    chunks = CATALOG["chunk_functions"][0](spark, str(DATA)).collect()
    assert {r["function_name"] for r in chunks if r["id"]} == {"load", "App", "greet"} and [r["error"] for r in chunks if r["error"]] == ["Unsupported file: e.go"]
    rows = CATALOG["embed_documents"][0](spark, str(DATA)).collect()
    assert rows and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in rows)


def test_long_documents_are_embedded_whole(spark, tmp_path):
    head = "some words " * 2000
    spark.createDataFrame([(1, head + "one end", "en", "s", 0), (2, head + "another tail " * 500, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = (tuple(r["embedding"]) for r in CATALOG["embed_documents"][0](spark, str(tmp_path)).collect())
    assert one != two
