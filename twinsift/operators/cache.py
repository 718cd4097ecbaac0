"""The content-addressed embedding cache: look-ups, additions and pruning, as joins on content hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with `cached`, the cache's vector for their content, null on a miss."""
    return chunks.join(cache.select("content_hash", F.col("embedding").alias("cached")), "content_hash", "left")


def misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """(content_hash, text) of contents that need a vector, each once."""
    absent = chunks.join(cache.select("content_hash"), "content_hash", "left_anti")
    return absent.groupBy("content_hash").agg(F.min("source_text").alias("source_text"))


def put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh vectors; they replace older ones of the same content."""
    columns = ["content_hash", "embedding"]
    return cache.join(fresh.select("content_hash"), "content_hash", "left_anti").select(*columns).unionByName(fresh.select(*columns).dropDuplicates(["content_hash"]))


def referenced(indexes: list[DataFrame]) -> DataFrame:
    """Content hashes that any index of any work tree refers to."""
    return reduce(DataFrame.union, [index.select("content_hash") for index in indexes]).distinct()


def prune(cache: DataFrame, hashes: DataFrame) -> DataFrame:
    """The entries that are still referred to."""
    return cache.join(hashes, "content_hash", "left_semi")


def prune_summary(cache: DataFrame, hashes: DataFrame) -> DataFrame:
    """(entries_before, entries_removed, entries_kept)."""
    marked = cache.select("content_hash").join(hashes.select("content_hash", F.lit(1).alias("used")), "content_hash", "left")
    return marked.agg(F.count(F.lit(1)).alias("entries_before"), F.count_if(F.col("used").isNull()).alias("entries_removed"), F.count("used").alias("entries_kept"))
