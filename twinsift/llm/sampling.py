"""Bounded samples of rows, the same whatever the partitioning: those with the smallest hashed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of_id(column: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def by_hash(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """At most about `size` rows of `rows` (more only if ids are repeated); only ids are sorted, not rows."""
    hashed = F.xxhash64(id_col)
    bound = rows.select(hashed.alias("h")).orderBy("h").limit(size).agg(F.max("h")).first()[0]
    return rows.where(hashed <= F.lit(bound)) if bound is not None else rows.limit(0)


def by_hash_of_each(rows: DataFrame, id_col: str, group_col: str, size: int, least: int) -> tuple[DataFrame, dict[str, int]]:
    """(by_hash's rows and about `least` of each group, or all of a smaller group; how many rows each group has).

    The hashes are evenly spread, so a group's size tells which hashes are so few; its smallest one is always taken.
    """
    hashed = F.xxhash64(id_col)
    bound = rows.select(hashed.alias("h")).orderBy("h").limit(size).agg(F.max("h")).first()[0]
    groups = rows.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("low")).collect() if bound is not None else []
    if not groups:
        return rows.limit(0), {}
    spread = lambda n: -(1 << 63) + (1 << 64) * least // n if n > least else (1 << 63) - 1
    bounds = rows.sparkSession.createDataFrame([(g[group_col], max(bound, g["low"], spread(g["n"]))) for g in groups], f"`{group_col}` string, bound long")
    return rows.join(F.broadcast(bounds), group_col).where(hashed <= F.col("bound")).drop("bound"), {g[group_col]: g["n"] for g in groups}
