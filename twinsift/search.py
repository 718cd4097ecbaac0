"""Questions to a project's index: source texts, the whole index, and what a diff adds or changes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunker import LANGUAGES, parse_files
from .embedding import Embedder, embed_texts
from .index import Index
from .operators import changes, exclusions, ranking
from .sources import repository

VIRTUAL_NAME = "input.ts"


def _with_vectors(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    hashed = chunks.where("id is not null").withColumn("content_hash", F.sha2("source_text", 256))
    texts = hashed.groupBy("content_hash").agg(F.min("source_text").alias("source_text"))
    return hashed.join(embed_texts(texts, embedder), "content_hash").persist()


def _function(row) -> dict:
    return {"id": row["id"], "filePath": row["file_path"], "functionName": row["function_name"], "startLine": row["start_line"], "endLine": row["end_line"], "signature": row["signature"], "chunkType": row["chunk_type"], "context": row["context"], "signatureHash": row["signature_hash"]}


_SHOWN = ["id", "file_path", "function_name", "start_line", "end_line", "signature", "chunk_type", "context", "signature_hash"]


def _answer(index: Index, embedder: Embedder, queries: DataFrame, top: int, threshold: float, removed: DataFrame | None = None) -> list[dict]:
    """Every query chunk with its candidates; what is removed by a diff drops out after the cut."""
    stored, rules = index.embedded(), exclusions.read(index.root)
    found = ranking.query(queries, stored, top, threshold, rules, index.root)
    if removed is not None:
        found = changes.without_removed(found, removed)
    details = stored.select(*_SHOWN).withColumnsRenamed({c: f"c_{c}" for c in _SHOWN})
    rows = found.join(details, F.col("id") == F.col("c_id")).select("query_id", "rank", "raw_distance", "distance", "jaccard", "similarity", *details.columns).collect()
    by_query: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: r["rank"]):
        candidate = _function({c: row[f"c_{c}"] for c in _SHOWN}) | {"rawDistance": row["raw_distance"], "distance": row["distance"], "jaccard": row["jaccard"], "similarity": row["similarity"]}
        by_query.setdefault(row["query_id"], []).append(candidate)
    return [_function(row) | {"candidates": by_query.get(row["id"], [])} for row in queries.select(*_SHOWN).orderBy("file_path", "start_line", "id").collect()]


def query_source(index: Index, embedder: Embedder, source: str, name: str = VIRTUAL_NAME, top: int = ranking.QUERY_TOP, threshold: float = ranking.QUERY_THRESHOLD) -> dict:
    """Similar chunks for each chunk of a source text; `name` decides the language."""
    index.require()
    spark = index.spark
    parsed = parse_files(spark.createDataFrame([(name, source)], "file_path string, source string")).persist()
    errors = [row["error"] for row in parsed.where("error is not null").select("error").collect()]
    notes = index.warnings(embedder.model)
    if not parsed.where("id is not null").limit(1).count():
        return {"functions": [], "parseErrors": errors, "warnings": [*notes, "No functions found in input."], "totalIndexed": 0}
    queries = _with_vectors(parsed.drop("error"), embedder)
    return {"functions": _answer(index, embedder, queries, top, threshold), "parseErrors": errors, "warnings": notes, "totalIndexed": index.chunks().count()}


def scan(index: Index, threshold: float = ranking.SCAN_THRESHOLD, top: int = ranking.SCAN_TOP) -> dict:
    """The most similar pairs of the index."""
    index.require()
    stored, rules = index.embedded(), exclusions.read(index.root)
    pairs = ranking.scan(stored, threshold, top, rules, index.root).select("a_id", "b_id", "raw_distance", "distance", "jaccard", "similarity")
    for side in "ab":
        pairs = pairs.join(stored.select(*(F.col(c).alias(f"{side}_{c}") for c in _SHOWN)), f"{side}_id")
    rows = pairs.orderBy("distance", "a_id", "b_id").collect()
    matches = [{"a": _function({c: row[f"a_{c}"] for c in _SHOWN}), "b": _function({c: row[f"b_{c}"] for c in _SHOWN}), "rawDistance": row["raw_distance"], "distance": row["distance"], "jaccard": row["jaccard"], "similarity": row["similarity"]} for row in rows]
    scanned = stored if not rules.files else stored.where(~exclusions.is_excluded_file(F.col("file_path"), rules.globs(), index.root))
    return {"matches": matches, "pairsFound": len(matches), "chunksScanned": scanned.count(), "warnings": index.warnings()}


def _versions(index: Index, diff: DataFrame, new: str | None, old: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of the new and of the old side of a diff's source files; sides are revisions, or None for the work tree."""
    endings = sorted({ending for language in LANGUAGES for ending in language.extensions})
    entries = diff.where(functools.reduce(Column.__or__, (F.col("path").endswith(ending) for ending in endings)))
    sides = []
    for revision, skip in ((new, "Deleted"), (old, "Added")):
        files = repository.read_versions(entries.where(F.col("status") != skip), index.root, revision)
        sides.append(parse_files(files, excluded=False).where("id is not null").drop("error").withColumn("content_hash", F.sha2("source_text", 256)).persist())
    return sides[0], sides[1]


def _query_diff(index: Index, embedder: Embedder, diff: DataFrame, new_of: str | None, old_of: str, top: int, threshold: float) -> dict:
    new, old = _versions(index, diff, new_of, old_of)
    side = lambda rows: rows.select("file_path", F.col("function_name").alias("name"), "content_hash", F.col("start_line").alias("position"), "chunk_type")
    compared = changes.compare_chunks(side(old), side(new)).persist()
    wanted = compared.where("status in ('added', 'modified')").select("file_path", F.col("name").alias("function_name")).distinct()
    queries = _with_vectors(new.drop("content_hash").join(wanted, ["file_path", "function_name"], "left_semi"), embedder)
    answers = _answer(index, embedder, queries, top, threshold, compared.where("status = 'removed'")) if queries.limit(1).count() else []
    counts = {row["status"]: row["n"] for row in compared.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"functions": answers, "changes": counts, "warnings": index.warnings(embedder.model), "totalIndexed": index.chunks().count()}


def query_working_tree(index: Index, embedder: Embedder, top: int = ranking.QUERY_TOP, threshold: float = ranking.QUERY_THRESHOLD) -> dict:
    """Similar chunks for what the work tree adds or changes against HEAD."""
    root = index.require().root
    return _query_diff(index, embedder, repository.diff_working_tree(index.spark, root), None, "HEAD", top, threshold)


def query_commit(index: Index, embedder: Embedder, commit: str, top: int = ranking.QUERY_TOP, threshold: float = ranking.QUERY_THRESHOLD) -> dict:
    """The same for what a commit adds or changes against its first parent."""
    root = index.require().root
    return _query_diff(index, embedder, repository.diff_commit(index.spark, root, commit), commit, f"{commit}^", top, threshold)
