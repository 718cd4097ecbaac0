import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinsift.chunker.tree import signature_hash as plain_hash
from twinsift.functions import scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def sets(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def test_jaccard(spark):
    assert one(spark, scalars.jaccard(sets(), sets())) == 1
    assert one(spark, scalars.jaccard(sets("a"), sets())) == 0
    assert one(spark, scalars.jaccard(sets("a", "b", "c"), sets("b", "c", "d"))) == 0.5


def test_tiers(spark):
    found = [one(spark, scalars.tier(F.lit(x))) for x in (0.0, 0.01, 0.05, 0.12, 0.2, 0.21)]
    assert found == ["identical", "identical", "nearly identical", "very similar", "similar", "weak"]


def test_combined(spark):
    assert abs(one(spark, scalars.combined(F.lit(0.1), F.lit(0.5))) - 0.22) < 1e-12


def test_signature_hash_ignores_case_and_space(spark):
    params = F.array(F.struct(F.lit("a").alias("name"), F.lit("Map< K, V >").alias("type")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("type")))
    found = one(spark, scalars.signature_hash(F.lit(" Load "), params, F.lit(None).cast("string")))
    assert found == hashlib.sha256(b"load(map<k,v>,any):void").hexdigest()[:16]
    assert found == plain_hash("Load", [("x", "map<K,V>"), ("y", "ANY")], "void")


def test_signature_hash_knows_all_white_space(spark):
    for space in ("\t", "\n", "\r\n", "\x0b", "\x85", "\u00a0", "\u2003", "\u3000", "\x1c"):
        params = F.array(F.struct(F.lit("a").alias("name"), F.lit(f"Map<{space}K,{space}V>").alias("type")))
        found = one(spark, scalars.signature_hash(F.lit(f"{space}Foo{space}"), params, F.lit(f"{space}int")))
        assert found == plain_hash(f"{space}Foo{space}", [("a", f"Map<{space}K,{space}V>")], f"{space}int")
        assert (found == plain_hash("foo", [("a", "map<k,v>")], "int")) == (space != "\x1c")


def test_line_count(spark):
    assert [one(spark, scalars.line_count(F.lit(a), F.lit(b))) for a, b in ((3, 5), (5, 5), (6, 2))] == [3, 1, 1]


def test_text_forms(spark):
    assert one(spark, scalars.display_name(F.lit("<block:3>"), F.lit("block"), F.lit("f"))) == "<block:3> in f"
    assert one(spark, scalars.relative_path(F.lit("/p/src/a.ts"), "/p")) == "src/a.ts"
    assert one(spark, scalars.relative_path(F.lit("/px/a.ts"), "/p")) == "/px/a.ts"
    assert one(spark, scalars.similarity_percent(F.lit(0.126))) == 87
    assert one(spark, scalars.block_signature(F.lit(7))) == "<block> (7 lines)"


def test_cut_bytes(spark):
    rows = spark.createDataFrame([("aéb", 2), ("aéb", 3), (None, 3), ("abc", 9)], "t string, n int")
    assert [r[0] for r in rows.select(scalars.cut_bytes("t", "n")).collect()] == ["a", "aé", None, "abc"]


def test_vector_codec():
    values = [0.5, -1.25, 3.0]
    data = scalars.encode_vector(values)
    assert len(data) == 12 and scalars.decode_vector(data) == values
    assert scalars.decode_vector(data + b"xy") == values


@given(st.lists(st.floats(width=32, allow_nan=False)))
def test_vector_round_trip(values):
    assert scalars.decode_vector(scalars.encode_vector(values)) == values


def test_max_input_bytes():
    assert scalars.max_input_bytes(512) == 1024 and scalars.max_input_bytes(None) == 16_000
