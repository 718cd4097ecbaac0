"""The pipeline against a plain version of each stage, and what the driver's contract says about it."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinsift.llm import packing, pii

from .conftest import plain_shingles
from .test_decontaminate import greedy_tiles, words
from .test_jaccard import brute

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    extra = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", None, "s", 0), (10_002, "12 !", "en", None, 4), (10_003, "Mail me at some.one@host.com or call +49 170 1234567 please and thank you.", "en", "s", 75)], docs.schema)
    docs = docs.unionByName(extra)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{i}")
        out.append((docs, docs := spark.read.parquet(f"{folder}/{i}")))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(outputs):
    names = outputs[0][0].columns
    assert all(after.columns == names for _, after in outputs[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_language(outputs):
    before, after = map(by_id, outputs[0])
    assert set(before) - set(after) == {i for i, r in before.items() if not re.search(r"[^\W\d_]", r["text"] or "")} and len(before) - len(after) == 3
    assert all(after[i] == before[i] for i in after)


def test_near_duplicates(outputs):
    before, after = map(by_id, outputs[1])
    ids = sorted(before)
    _, roots = brute([before[i]["text"] for i in ids])
    assert set(after) == {ids[r] for r in roots} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after) and plain_shingles("a b") != plain_shingles("a c")


def test_decontamination(spark, outputs):
    before, after = map(by_id, outputs[2])
    bench = [words(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = [{tuple(b[i : i + 4]) for i in range(len(b) - 3)} for b in bench]
    gone = set()
    for i, row in before.items():
        own = words(row["text"])
        seen = {tuple(own[j : j + 4]) for j in range(len(own) - 3)}
        for item, known in zip(bench, grams, strict=True):
            if len(known & seen) * 4 >= len(item) * 0.5 and sum(greedy_tiles(own, item, 4)) >= 0.5 * len(item):
                gone.add(i)
    assert set(before) - set(after) == gone and gone


def test_pii(outputs):
    before, after = map(by_id, outputs[3])
    assert set(before) == set(after)
    for i, row in after.items():
        assert pii.rule_spans(row["text"]) == [] and row["n_chars"] == len(row["text"])
        if not re.search("[0-9@]", before[i]["text"]):
            assert row["text"] == before[i]["text"]
    assert after[10_003]["text"] == "Mail me at [EMAIL] or call [PHONE] please and thank you."


def test_packing(outputs):
    before, after = outputs[4]
    tokens = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert tokens == {i: len(packing.token_ids(r["text"])) for i, r in by_id(before).items()}


def test_run(spark, outputs):
    frame = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert frame.where("doc_id < 10000").count() > 0 and set(key) <= set(frame.columns)
