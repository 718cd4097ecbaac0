"""Index health in one pass over the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(chunks, embedded, unembedded, files, contents)."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count("embedding").alias("embedded"),
        F.count_if(F.col("embedding").isNull()).alias("unembedded"),
        F.countDistinct("file_path").alias("files"),
        F.countDistinct("content_hash").alias("contents"),
    )


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def exact_duplicates(chunks: DataFrame, id_col: str = "id", hash_col: str = "content_hash") -> DataFrame:
    """(content_hash, copies, first_id) of contents that occur more than once."""
    return chunks.groupBy(F.col(hash_col).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")
