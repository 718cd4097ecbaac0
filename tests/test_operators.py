import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.operators import cache, changes, exclusions, knn, ranking
from twinsift.sources.globs import GlobSet


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_knn_paths_and_ties(spark, broadcast, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 7)
    values = np.random.default_rng(1).standard_normal((40, 5))
    values[5] = values[3] * 2
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)] + [(98, None), (99, [0.0] * 5)]
    data = vectors(spark, rows)
    found = {(r["query_id"], r["rank"]): r["id"] for r in knn.knn(data, data, 4, broadcast_values=broadcast).collect()}
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    distance = np.round(1 - unit @ unit.T, 6) + 0.0
    for q in range(40):
        for rank, i in enumerate(np.lexsort((np.arange(40), distance[q]))[:4], 1):
            assert found[q, rank] == i
    assert found[5, 1] == 3 and len(found) == 160
    assert {(r["query_id"], r["rank"]): r["id"] for r in knn.knn_sql(data, data, 4).collect()} == found


def test_knn_of_nothing(spark):
    data = vectors(spark, [])
    assert knn.knn(data, data, 3).count() == 0 and knn.threshold_join(data, 0.5).count() == 0


def near_pairs(unit, k=None, threshold=None):
    """Brute force in double precision: (query, id, rank), or (a, b)."""
    distance = np.round(1 - unit @ unit.T, 6) + 0.0
    if k is None:
        return {(int(a), int(b)) for a, b in zip(*np.nonzero(distance <= threshold), strict=True) if a < b}
    return {(q, int(i), rank) for q in range(len(unit)) for rank, i in enumerate(np.lexsort((np.arange(len(unit)), distance[q]))[:k], 1)}


@pytest.mark.parametrize("name", [int, str])
def test_vectors_travel_in_slices(spark, monkeypatch, name):
    """Many blocks and slices, with ties across them; rows travel packed and the driver collects none of them."""
    for constant, value in (("BLOCK_ROWS", 60), ("SLICE_ROWS", 16), ("STEP_ROWS", 25), ("STEP_PAIRS", 9)):
        monkeypatch.setattr(knn, constant, value)
    values = np.random.default_rng(2).standard_normal((500, 12)).astype(np.float32)
    values[100:160], values[300:340] = values[7], values[8] * 2
    unit = knn.unit_rows(values)
    key = (lambda i: i) if name is int else (lambda i: f"{i:03}")
    data = spark.createDataFrame([(key(i), v.tolist()) for i, v in enumerate(values)], f"id {'long' if name is int else 'string'}, embedding array<float>").repartition(3)
    packed = knn._slices(data.select("id", data["embedding"].alias("v")), 5, 16, True).collect()
    assert sorted(i for row in packed for i in row["ids"]) == [key(i) for i in range(500)] and max(len(row["ids"]) for row in packed) <= 16
    per_part = [sum(len(row["ids"]) for row in packed if row["part"] == part) for part in range(5)]
    assert 50 < min(per_part) and max(per_part) < 150
    monkeypatch.setattr(type(data), "toPandas", lambda self: pytest.fail("the driver collects rows"))
    assert {(int(r["query_id"]), int(r["id"]), r["rank"]) for r in knn.knn(data, data, 7, broadcast_values=0).collect()} == near_pairs(unit, 7)
    few = knn.knn(data.where("cast(id as int) < 9"), data, 600, broadcast_values=0)
    assert few.count() == 9 * 500
    found = [(int(r["a_id"]), int(r["b_id"])) for r in knn.threshold_join(data, 0.4).collect()]
    assert len(found) == len(set(found)) and set(found) == near_pairs(unit, threshold=0.4)


def test_index_beyond_a_few_megabytes_is_not_broadcast(spark, monkeypatch):
    """20,000 vectors of 64, which each worker of an executor would hold."""
    monkeypatch.setattr(knn, "_with_matrix", lambda *_: pytest.fail("the index travels whole"))
    data = spark.range(20_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin(F.col("id") * j).cast("float")).alias("embedding"))
    found = knn.knn(data.where("id in (5, 77, 19000)"), data, 2).collect()
    assert len(found) == 6 and all(r["id"] == r["query_id"] for r in found if r["rank"] == 1)


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, file_path string, function_name string, chunk_type string, context string, signature_hash string, tokens array<string>, embedding array<float>")


def test_scan_rules(spark):
    a, near, far = [1.0, 0.0], [0.99, 0.1], [0.0, 1.0]
    rows = [
        ("a", "x.ts", "f", "function", None, "h1", ["t"], a),
        ("b", "y.ts", "g", "function", None, "h2", ["t"], a),
        ("c", "x.ts", "<block:2>", "block", "f", "h3", ["t"], near),
        ("d", "z.ts", "k", "function", None, "h4", [], far),
    ]
    data = chunk_rows(spark, rows)
    found = {(r["a_id"], r["b_id"]): r for r in ranking.scan(data).collect()}
    assert set(found) == {("a", "b"), ("b", "c")}  # a and c are a function and its block
    assert found["a", "b"]["similarity"] == "identical" and found["a", "b"]["distance"] == 0
    rules = exclusions.Exclusions()
    assert rules.add_pair(exclusions.PairExclusion(exclusions.Side("", "", "h2"), exclusions.Side("", "", "h1")))
    assert not rules.add_pair(exclusions.PairExclusion(exclusions.Side("", "", "h1"), exclusions.Side("", "", "h2")))
    assert {(r["a_id"], r["b_id"]) for r in ranking.scan(data, rules=rules).collect()} == {("b", "c")}
    rules = exclusions.Exclusions(files=[exclusions.FileExclusion("y.*")])
    assert ranking.scan(data, rules=rules).count() == 0
    rules = exclusions.Exclusions(file_pairs=[exclusions.FilePairExclusion("y.ts", "x.ts")])
    assert ranking.scan(data, rules=rules).count() == 0


def test_query_keeps_queries_without_candidates(spark):
    rows = [("a", "x.ts", "f", "function", None, "h1", ["t"], [1.0, 0.0]), ("b", "y.ts", "g", "function", None, "h2", ["t"], [1.0, 0.0]), ("d", "z.ts", "k", "function", None, "h4", [], [0.0, 1.0])]
    data = chunk_rows(spark, rows)
    found = {r["id"]: [c["id"] for c in r["candidates"]] for r in ranking.nested(data, ranking.query(data, data)).collect()}
    assert found == {"a": ["b"], "b": ["a"], "d": []}


def test_neighbours_are_found_once(spark):
    """The pairs are joined several times; a plan that holds the search would run it again for each."""
    rows = [(f"c{i}", f"f{i}.ts", f"n{i}", "function", None, f"h{i}", ["t", "t", "u"][: i + 1], [1.0, i / 9]) for i in range(3)]
    data = chunk_rows(spark, rows)
    for found in (ranking.scan(data, top=None), ranking.query(data, data)):
        assert "MapInArrow" not in found._jdf.queryExecution().toString()
        near = found.where("jaccard < 1").select("jaccard").distinct().collect()
        assert [r["jaccard"] for r in near] == [0.5]  # a repeated token counts once


GLOB_CASES = [
    (["*.log"], "a/b.log", True), (["/a.ts"], "x/a.ts", False), (["a/b.ts"], "x/a/b.ts", False), (["gen/"], "x/gen/y/z.ts", True), (["gen/"], "gen", False),
    (["**/gen/*.ts"], "x/y/gen/a.ts", True), (["src/**"], "src/a/b.ts", True), (["src/**/x.ts"], "src/x.ts", True), (["a?c.ts"], "abc.ts", True), (["[ab].ts"], "b.ts", True),
    (["[!ab].ts"], "b.ts", False), (["*.ts", "!keep.ts"], "keep.ts", False), (["*.ts", "!keep.ts"], "x/other.ts", True), (["gen/", "!gen/a.ts"], "gen/a.ts", False), (["# x", "", "a\\ b"], "a b", True), (["*"], "a/b", True), (["src"], "a/src/b/c.ts", True),
]


@pytest.mark.parametrize("lines,path,ignored", GLOB_CASES)
def test_globs(spark, lines, path, ignored):
    assert GlobSet(lines).ignores(path) is ignored
    assert spark.createDataFrame([(path,)], "p string").select(GlobSet(lines).matches(F.col("p"))).first()[0] is ignored


def test_exclusion_file(tmp_path):
    rules = exclusions.Exclusions()
    assert rules.add_group(["b", "a", "c"], "same", "2024-01-01") == 3 and rules.add_group(["a", "b"], "", "") == 0
    assert rules.add_file(exclusions.FileExclusion("*.gen.ts")) and not rules.add_file(exclusions.FileExclusion("*.gen.ts"))
    exclusions.save(str(tmp_path), rules)
    assert exclusions.read(str(tmp_path)) == rules
    path = tmp_path / exclusions.FILE_NAME
    path.write_text('{"version": 1, "exclusions": []}')
    assert exclusions.read(str(tmp_path)) == exclusions.Exclusions()
    for bad in ('{"version": 2, "exclusions": []}', "{", "[]"):
        path.write_text(bad)
        with pytest.warns(UserWarning):
            assert exclusions.read(str(tmp_path)) == exclusions.Exclusions()


def test_file_changes(spark):
    schema = "file_path string, content_hash string, mtime_ms long"
    current = spark.createDataFrame([("a", "1", 1), ("b", "2", 9), ("c", "3", 9), ("n", "4", 1)], schema)
    tracked = spark.createDataFrame([("a", "x", 1), ("b", "2", 1), ("c", "x", 1), ("d", "5", 1)], schema)
    found = dict(map(tuple, changes.file_changes(current, tracked).collect()))
    assert found == {"a": "unchanged", "b": "unchanged", "c": "modified", "n": "added", "d": "deleted"}
    assert dict(map(tuple, changes.file_changes(current, tracked, trust_mtime=False).collect()))["a"] == "modified"
    assert dict(map(tuple, changes.file_changes(current, tracked, force=True).collect())) == {"a": "added", "b": "added", "c": "added", "n": "added", "d": "deleted"}
    assert "d" not in dict(map(tuple, changes.file_changes(current, tracked, prefix="a").collect()))


def test_compare_chunks(spark):
    schema = "file_path string, name string, content_hash string, position int, chunk_type string"
    old = spark.createDataFrame([("f", "same", "1", 1, "function"), ("f", "edit", "2", 2, "function"), ("f", "gone", "3", 3, "function"), ("f", "twice", "4", 4, "function"), ("f", "twice", "5", 5, "function"), ("f", "<block:9>", "6", 6, "block")], schema)
    new = spark.createDataFrame([("f", "same", "1", 1, "function"), ("f", "edit", "x", 2, "function"), ("f", "fresh", "7", 3, "function"), ("f", "twice", "5", 4, "function"), ("f", "<block:12>", "6", 6, "block")], schema)
    found = {r["name"]: r["status"] for r in changes.compare_chunks(old, new).collect()}
    assert found == {"same": "unchanged", "edit": "modified", "gone": "removed", "fresh": "added", "twice": "unchanged", "<block:12>": "unchanged"}


def test_cache(spark):
    store = spark.createDataFrame([("1", [1.0]), ("2", [2.0])], "content_hash string, embedding array<float>")
    chunks = spark.createDataFrame([("1", "a"), ("3", "c"), ("3", "c")], "content_hash string, source_text string")
    assert [tuple(r) for r in cache.misses(chunks, store).collect()] == [("3", "c")]
    put = cache.put(store, spark.createDataFrame([("2", [9.0]), ("3", [3.0])], "content_hash string, embedding array<float>"))
    assert {r[0]: r[1] for r in put.collect()} == {"1": [1.0], "2": [9.0], "3": [3.0]}
    used = cache.referenced([chunks])
    assert [r[0] for r in cache.prune(store, used).collect()] == ["1"]
    assert tuple(cache.prune_summary(store, used).first()) == (2, 1, 1)
