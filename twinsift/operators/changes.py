"""Change detection and merges between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_changes(current: DataFrame, tracked: DataFrame, force: bool = False, prefix: str = "", trust_mtime: bool = True) -> DataFrame:
    """(file_path, status): added, modified, unchanged or deleted, by modification time and then content hash.

    Both sides have (file_path, content_hash, mtime_ms). Tracked files outside prefix aren't looked at. With force, all
    current files are added and the others deleted.
    """
    old = tracked.where(F.col("file_path").startswith(prefix)) if prefix else tracked
    old = old.select("file_path", F.col("content_hash").alias("old_hash"), F.col("mtime_ms").alias("old_mtime"), F.lit(True).alias("was"))
    both = current.select("file_path", "content_hash", "mtime_ms", F.lit(True).alias("is")).join(old, "file_path", "full_outer")
    same = F.col("content_hash").eqNullSafe(F.col("old_hash"))
    if trust_mtime:
        same = same | F.col("mtime_ms").eqNullSafe(F.col("old_mtime"))
    status = F.when(F.col("is").isNull(), "deleted")
    status = status.otherwise("added") if force else status.when(F.col("was").isNull(), "added").when(same, "unchanged").otherwise("modified")
    return both.select("file_path", status.alias("status"))


def merge_chunks(old: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot: old chunks of files that stay as they are, and fresh ones of the others without a vector.

    Of fresh chunks with equal ids the last one of the file counts.
    """
    gone = changes.where(F.col("status") != "unchanged").select("file_path")
    kept = old.join(gone, "file_path", "left_anti")
    last = Window.partitionBy("id").orderBy(F.desc("end_line"), F.desc("content_hash"))
    new = fresh.withColumn("content_hash", F.sha2("source_text", 256)).withColumn("embedding", F.lit(None).cast(old.schema["embedding"].dataType))
    new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def merge_tracked(old: DataFrame, current: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """The tracked files after a run; times of unchanged files are taken over as well, but not when they were indexed."""
    names = ["file_path", "content_hash", "mtime_ms", "indexed_at"]
    outside = old.join(changes.select("file_path"), "file_path", "left_anti")
    known = old.select("file_path", F.col("indexed_at").alias("__was")).join(changes.where("status = 'unchanged'"), "file_path", "left_semi")
    seen = current.select("file_path", "content_hash", "mtime_ms").join(known, "file_path", "left")
    return outside.select(*names).unionByName(seen.withColumn("indexed_at", F.coalesce("__was", F.current_timestamp() if now is None else now)).select(*names))


def with_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with vectors of (content_hash, embedding) filled in where they have none."""
    found = embeddings.select("content_hash", F.col("embedding").alias("__e"))
    return chunks.join(found, "content_hash", "left").withColumn("embedding", F.coalesce("embedding", "__e")).select(*chunks.columns)


def compare_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, name, status) of functions by name within a file and of blocks by their text.

    Both sides have (file_path, name, content_hash, position, chunk_type); of equal names of the old side the last
    counts, each of the new side is compared.
    """
    key = F.when(F.col("chunk_type") == "block", F.col("content_hash")).otherwise(F.col("name"))
    last = Window.partitionBy("file_path", "chunk_type", "key").orderBy(F.desc("position"))
    before = old.withColumn("key", key).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    before = before.select("file_path", "chunk_type", "key", F.col("name").alias("old_name"), F.col("content_hash").alias("old_hash"))
    after = new.withColumn("key", key).select("file_path", "chunk_type", "key", F.col("name").alias("new_name"), F.col("content_hash").alias("new_hash"))
    both = after.join(before, ["file_path", "chunk_type", "key"], "full_outer")
    status = F.when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return both.select("file_path", F.coalesce("new_name", "old_name").alias("name"), status.alias("status"))


def without_removed(candidates: DataFrame, removed: DataFrame, path_col: str = "file_path", name_col: str = "function_name") -> DataFrame:
    """Candidates that aren't among the removed (file_path, name)."""
    gone = removed.select(F.col("file_path").alias("__p"), F.col("name").alias("__n")).distinct()
    return candidates.join(gone, (F.col(path_col) == F.col("__p")) & (F.col(name_col) == F.col("__n")), "left_anti")


def name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, status) from lines of a name-status listing; a rename is a deleted and an added file."""
    parts = F.split(column, "\t")
    kind = F.substring(parts[0], 1, 1)
    one = lambda path, status: F.struct(path.alias("path"), F.lit(status).alias("status"))
    at = lambda n: F.try_element_at(parts, F.lit(n))
    found = F.when((kind == "R") & (F.size(parts) >= 3), F.array(one(at(2), "Deleted"), one(at(3), "Added")))
    for letter, status in (("A", "Added"), ("M", "Modified"), ("D", "Deleted")):
        found = found.when((parts[0] == letter) & (F.size(parts) >= 2), F.array(one(at(2), status)))
    return lines.select(F.explode(found).alias("e")).select("e.path", "e.status")
