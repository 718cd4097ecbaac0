"""Connected components of a link table, distributed: alternating large-star and small-star rounds.

A round joins the links of each node with the node's smallest neighbour. A node of very many links would bring them all
to one task, so those that have more than one in HOT_SHARE of all links (there can't be more than 2 * HOT_SHARE of them)
are split by their neighbour into SALTS parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOT_SHARE, SALTS, LEAST_HOT = 500, 64, 100


def _with_least(links: DataFrame, hot: list[int]) -> DataFrame:
    """links (part, u, v) with m, the smallest v of the same u; those of hot nodes are salted."""
    least = links.groupBy("part", "u").agg(F.min("v").alias("m"))
    if not hot:
        return links.join(least, ["part", "u"])
    is_hot = F.col("u").isin(hot)
    dealt = links.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, ["part", "u", "salt"]).select("part", "u", "v", "m")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("part", F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, hot: list[int]) -> DataFrame:
    return _with_least(_both_ways(edges), hot).where("v > u").select("part", F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, hot: list[int]) -> DataFrame:
    met = _with_least(edges, hot)
    pairs = F.array(F.struct("part", "u", F.col("m").alias("v")), F.struct("part", F.col("v").alias("u"), F.col("m").alias("v")))
    return met.select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()


def _state(edges: DataFrame, total: int) -> tuple[int, int, list[int]]:
    """(links, digest of them, nodes of more than a share of total links); links of a node only become fewer in a round."""
    nodes = _both_ways(edges).groupBy("part", "u").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("part", "u", "v")).alias("x"))
    many = F.collect_set(F.when(F.col("n") > max(LEAST_HOT, total // HOT_SHARE), F.col("u")))
    links, digest, hot = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor("x"), many).first()
    return links, digest, hot


def components(links: DataFrame, part: str | None = None) -> DataFrame:
    """(node, root[, part]) for every node that occurs in links (u, v[, part]); root is the smallest node of its component.

    With `part`, a column of small numbers, the links of each part are a graph of its own; all go through the same rounds.
    """
    parts = F.lit(0) if part is None else F.col(part).cast("int")
    edges = links.where("u <> v").select(parts.alias("part"), F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges, 2 * edges.count())
    while before[0]:
        edges = materialize(_small_star(_large_star(edges, before[2]), before[2]), "edges")
        after = _state(edges, before[0])
        if after[:2] == before[:2]:
            break
        before = after
    roots = edges.select("part", F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    nodes = edges.select("part", F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    return nodes.drop("part") if part is None else nodes.withColumnRenamed("part", part)
