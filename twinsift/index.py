"""The index on disk: Parquet snapshots, an embedding cache beside them, and the runs that keep both up to date.

A snapshot is a folder of tables; the file CURRENT names the one in use and is replaced in one step, so readers see whole
snapshots only and a failed run leaves the old one, which stays until the next but one is written. While texts are embedded,
each step appends its vectors to the snapshot's own table of vectors, and the end of a run writes them into the chunks.
Chunks without a vector are what a stopped run left to do. Folders may lie in any store that Spark reaches.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunker import parse_files
from .embedding import Embedder, embed_texts
from .files import Folder
from .operators import cache as caching
from .operators import changes, exclusions
from .schema import CACHED, SCHEMA_VERSION, STORED, TRACKED
from .sources import repository
from .sources.tree import project_root, read_files, source_paths

FOLDER, CACHE_FOLDER = ".twinsift", "twinsift-cache"
STEP = 4096


class IndexStateError(RuntimeError):
    """The index can't be used as it is."""


@dataclass
class IndexResult:
    files_scanned: int = 0
    added: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    functions_indexed: int = 0
    embedded: int = 0
    cached: int = 0
    status: str = "complete"
    warnings: list[str] = field(default_factory=list)

    def as_json(self) -> dict:
        return {camel(k): v for k, v in asdict(self).items()}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(word.title() for word in rest)


class Store:
    """Folders of Parquet below a root, with a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    @property
    def current(self) -> str | None:
        """The name of the snapshot in use."""
        return self.folder.read("CURRENT").strip() if self.folder.exists("CURRENT") else None

    def meta(self) -> dict:
        name = self.current
        found = json.loads(self.folder.read(f"{name}/meta.json")) if name else {}
        if found.get("schema_version", 0) > SCHEMA_VERSION:
            raise IndexStateError(f"the index has schema version {found['schema_version']}, this program knows {SCHEMA_VERSION}")
        return found

    def read(self, name: str, schema) -> DataFrame:
        snapshot = self.current
        if snapshot is None or not self.folder.exists(f"{snapshot}/{name}"):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.parquet(self.folder.at(f"{snapshot}/{name}"))
        for f in schema.fields:  # columns that older snapshots lack
            if f.name not in found.columns:
                found = found.withColumn(f.name, F.lit(None).cast(f.dataType))
        return found.select(*schema.fieldNames())

    def append(self, name: str, rows: DataFrame) -> None:
        """More rows for a table of the snapshot in use."""
        rows.write.mode("append").parquet(self.folder.at(f"{self.current}/{name}"))

    def write(self, tables: dict[str, DataFrame], meta: dict) -> None:
        """A new snapshot; the pointer moves when all of it is there. The one before stays for those who still read it."""
        old, fresh = self.current, f"snapshot-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(self.folder.at(f"{fresh}/{name}"))
        self.folder.write(f"{fresh}/meta.json", json.dumps(meta))
        pointer = f"CURRENT.{uuid.uuid4().hex}"
        self.folder.write(pointer, fresh)
        self.folder.move(pointer, "CURRENT")
        for name in self.folder.names():
            if name.startswith("snapshot-") and name not in (old, fresh):
                self.folder.delete(name)


class Index:
    """A project's index."""

    def __init__(self, spark: SparkSession, start: str, folder: str | None = None):
        self.spark, self.root = spark, project_root(start)
        self.store = Store(spark, folder or str(Path(self.root) / FOLDER))
        shared = repository.common_dir(self.root) if repository.is_repository(self.root) else None
        self.cache = Store(spark, str(Path(shared) / CACHE_FOLDER)) if shared else None

    def exists(self) -> bool:
        return self.store.current is not None

    def require(self) -> Index:
        if not self.exists():
            raise IndexStateError("no index; run `index` first")
        return self

    def chunks(self) -> DataFrame:
        """The chunks, also with the vectors that a run has made so far."""
        chunks, name = self.store.read("chunks", STORED), self.store.current
        if name is None or not self.store.folder.exists(f"{name}/vectors"):
            return chunks
        return changes.with_embeddings(chunks, self.store.read("vectors", CACHED).dropDuplicates(["content_hash"]))

    def tracked(self) -> DataFrame:
        return self.store.read("files", TRACKED)

    def with_signature(self, signature_hash: str) -> DataFrame:
        """The chunks of a signature hash."""
        return self.chunks().where(F.col("signature_hash") == signature_hash)

    def embedded(self) -> DataFrame:
        return self.chunks().where("embedding is not null")

    def warnings(self, model: str | None = None) -> list[str]:
        meta, out = self.store.meta(), []
        if note := repository.staleness(self.root, meta.get("head_commit")):
            out.append(note)
        if model and meta.get("model_name") and meta["model_name"] != model:
            out.append(f"index was built with {meta['model_name']}, not {model}")
        return out

    # --- planning

    def plan(self, prefix: str = "", force: bool = False, hash_all: bool = False) -> tuple[DataFrame, DataFrame]:
        """(current files with sources, their changes) for the files below prefix."""
        rules = exclusions.read(self.root)
        paths = source_paths(self.root, prefix, rules.globs())
        files = read_files(self.spark, self.root, paths).withColumn("content_hash", F.sha2("source", 256))
        return files, changes.file_changes(files, self.tracked(), force, prefix, not hash_all)

    def dry_run(self, prefix: str = "", force: bool = False) -> dict:
        _, diff = self.plan(prefix, force)
        return {row["status"]: row["files"] for row in diff.groupBy("status").agg(F.count(F.lit(1)).alias("files")).collect()}

    # --- running

    def run(self, embedder: Embedder, prefix: str = "", force: bool = False, progress: Callable[[int, int], None] | None = None, cancelled: Callable[[], bool] | None = None) -> IndexResult:
        meta = self.store.meta()
        if meta.get("model_name") not in (None, embedder.model) and not force:
            raise IndexStateError(f"index was built with {meta['model_name']}; use force to build it anew with {embedder.model}")
        result, store = IndexResult(), self._cache_for(embedder, force)
        files, diff = self.plan(prefix, force)
        files, diff = files.persist(), diff.persist()
        try:
            counts = {row["status"]: row["n"] for row in diff.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
            result.added, result.modified, result.deleted, result.unchanged = (counts.get(k, 0) for k in ("added", "modified", "deleted", "unchanged"))
            result.files_scanned = result.added + result.modified + result.unchanged
            changed = files.join(diff.where("status in ('added', 'modified')"), "file_path", "left_semi")
            fresh = parse_files(changed.where("source is not null")).where("id is not null").drop("error")
            old = self.chunks().where("false") if force and not prefix else self.chunks()
            merged = changes.merge_chunks(old, fresh.withColumn("content_hash", F.sha2("source_text", 256)), diff)
            now = {**meta, "schema_version": SCHEMA_VERSION, "model_name": embedder.model, "model_dimensions": embedder.dimensions, "last_indexed_at": datetime.now(timezone.utc).isoformat(), "head_commit": repository.head(self.root)}
            now.setdefault("created_at", now["last_indexed_at"])
            tracked = changes.merge_tracked(self.tracked(), files.where("source is not null"), diff, F.lit(now["last_indexed_at"]).cast("timestamp"))
            self.store.write({"chunks": merged, "files": tracked}, now)
        finally:
            files.unpersist()
            diff.unpersist()
        self._embed(embedder, now, store, result, progress, cancelled)
        result.functions_indexed = self.chunks().count()
        return result

    def _cache_for(self, embedder: Embedder, force: bool) -> Store | None:
        settings = {"model_name": embedder.model, "dimensions": embedder.dimensions, "max_input_bytes": embedder.max_bytes}
        if self.cache is None:
            return None
        known = self.cache.meta()
        if known and known != settings and not force:
            raise IndexStateError(f"the embedding cache was made with {known.get('model_name')} of {known.get('dimensions')} dimensions; use force to build it anew")
        if not known or known != settings or force:
            self.cache.write({"vectors": self.spark.createDataFrame([], CACHED)}, settings)
        return self.cache

    def _embed(self, embedder: Embedder, meta: dict, store: Store | None, result: IndexResult, progress, cancelled) -> None:
        """Vectors for chunks that have none: from the cache, or made in steps, each of which is kept as soon as it is done."""
        while left := (missing := self.chunks().where("embedding is null")).count():
            if cancelled and cancelled():
                result.status = "cancelled"
                break
            if store is not None:
                hits = store.read("vectors", CACHED).join(missing.select("content_hash").distinct(), "content_hash", "left_semi")
                found = missing.join(hits.select("content_hash"), "content_hash", "left_semi").count()
                if found:
                    result.cached += found
                    self.store.append("vectors", hits)
                    continue
            todo = missing.groupBy("content_hash").agg(F.min("source_text").alias("source_text")).orderBy("content_hash").limit(STEP)
            vectors = embed_texts(todo, embedder).persist()
            try:
                result.embedded += vectors.count()
                self.store.append("vectors", vectors)
                if store is not None:
                    store.append("vectors", vectors.join(store.read("vectors", CACHED).select("content_hash"), "content_hash", "left_anti"))
            finally:
                vectors.unpersist()
            if progress:
                progress(result.embedded, left)
        if self.store.folder.exists(f"{self.store.current}/vectors"):
            self.store.write({"chunks": self.chunks(), "files": self.tracked()}, meta)

    # --- upkeep

    def status(self) -> dict:
        from .operators.status import chunk_counts

        counts = chunk_counts(self.chunks()).first().asDict() if self.exists() else dict.fromkeys(("chunks", "embedded", "unembedded", "files", "contents"), 0)
        rules, meta = exclusions.read(self.root), self.store.meta()
        cached = self.cache.read("vectors", CACHED).count() if self.cache and self.cache.current else 0
        return {
            "initialized": self.exists(), "totalFunctions": counts["chunks"], "unembedded": counts["unembedded"], "trackedFiles": self.tracked().count(), "model": meta.get("model_name"), "dimensions": meta.get("model_dimensions"),
            "lastIndexedAt": meta.get("last_indexed_at"), "headCommit": meta.get("head_commit"), "exclusions": len(rules.pairs), "fileExclusions": len(rules.files), "filePairExclusions": len(rules.file_pairs),
            "staleExclusions": len(self.stale(rules)), "cacheEntries": cached, "warnings": self.warnings(),
        }

    def stale(self, rules: exclusions.Exclusions) -> list[str]:
        if not rules.pairs:
            return []
        pairs = self.spark.createDataFrame([(e.a.signatureHash, e.b.signatureHash) for e in rules.pairs], "a_hash string, b_hash string")
        return sorted(row[0] for row in exclusions.stale(pairs, self.chunks()).collect())

    def prune_cache(self) -> dict:
        """Drop cached vectors that no work tree's index refers to."""
        if self.cache is None or self.cache.current is None:
            return {"entriesRemoved": 0, "bytesFreed": 0}
        before, size = self.cache.read("vectors", CACHED), self.cache.folder.size(self.cache.current)
        indexes = []
        for tree in repository.worktrees(self.root) or [self.root]:
            other = Store(self.spark, str(Path(tree) / FOLDER))
            if other.current is not None:
                indexes.append(other.read("chunks", STORED))
            elif Path(tree).exists() and (Path(tree) / FOLDER).exists():
                warnings.warn(f"{tree} has no readable index", stacklevel=2)
        hashes = caching.referenced(indexes) if indexes else self.spark.createDataFrame([], "content_hash string")
        count = before.count()
        self.cache.write({"vectors": caching.prune(before, hashes)}, self.cache.meta())
        return {"entriesRemoved": count - self.cache.read("vectors", CACHED).count(), "bytesFreed": max(0, size - self.cache.folder.size(self.cache.current))}
