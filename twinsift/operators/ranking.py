"""Similarity scan and query: neighbours, related-chunk rules, exclusions, token overlap, tiers and ranks.

Both keep the order of steps that decides results: neighbours are ranked against the whole index first and filtered
afterwards, so related or excluded neighbours still use up places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import materialize
from .exclusions import Exclusions, is_excluded_file, pairs_frame, without_pairs
from .knn import knn

SCAN_NEIGHBOURS, OVERFETCH = 6, 3
SCAN_THRESHOLD, SCAN_TOP, QUERY_THRESHOLD, QUERY_TOP = 0.25, 50, 0.3, 5
DECIMALS = 6
COMBINED_DECIMALS = 8  # products of rounded values by one decimal: nothing lies half-way

INFO = ["file_path", "function_name", "chunk_type", "context", "signature_hash", "tokens"]


def is_related(a: str, b: str) -> Column:
    """Chunks of one file that are a block and its function, or two blocks of one function."""
    c = lambda side, name: F.col(f"{side}{name}")
    child = lambda x, y: (c(x, "chunk_type") == "block") & (c(y, "chunk_type") == "function") & c(x, "context").eqNullSafe(c(y, "function_name"))
    siblings = (c(a, "chunk_type") == "block") & (c(b, "chunk_type") == "block") & c(a, "context").isNotNull() & c(a, "context").eqNullSafe(c(b, "context"))
    return (c(a, "file_path") == c(b, "file_path")) & (child(a, b) | child(b, a) | siblings)


def info(chunks: DataFrame, prefix: str, key: str, names: list[str] = INFO) -> DataFrame:
    """What ranking needs of a chunk, without its vector and text."""
    return chunks.select(F.col("id").alias(key), *(F.col(name).alias(f"{prefix}{name}") for name in names))


def _ids(pairs: DataFrame) -> DataFrame:
    """The ids that occur in pairs (a_id, b_id)."""
    return pairs.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct()


def tokens_of(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens) of some chunks, without repeats, as a table: they are made once, however often they are joined."""
    return materialize(chunks.select("id", F.array_distinct("tokens").alias("tokens")).join(ids, "id", "left_semi"), "tokens")


def with_jaccard(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the overlap of two columns of tokens without repeats; what both share is computed once for each pair."""
    pairs = pairs.withColumn("__common", F.size(F.array_intersect(a, b))).withColumn("__both", F.size(a) + F.size(b) - F.col("__common"))
    ratio = F.when(F.col("__both") == 0, 1.0).otherwise(F.col("__common") / F.greatest("__both", F.lit(1)))
    return pairs.withColumn("jaccard", F.round(ratio, DECIMALS)).drop("__common", "__both")


def _with_sides(pairs: DataFrame, chunks: DataFrame, names: list[str]) -> DataFrame:
    """pairs (a_id, b_id) with columns of both chunks."""
    for side in "ab":
        pairs = pairs.join(chunks.select(F.col("id").alias(f"{side}_id"), *(F.col(name).alias(f"{side}_{name}") for name in names)), f"{side}_id")
    return pairs


def apply_rules(pairs: DataFrame, rules: Exclusions | None, a: str, b: str, root: str = "", both: bool = False) -> DataFrame:
    """Without pairs that signature, file-pair or file rules exclude; file rules look at b, or at both sides."""
    if rules is None:
        return pairs
    spark = pairs.sparkSession
    if rules.pairs:
        pairs = without_pairs(pairs, F.col(f"{a}signature_hash"), F.col(f"{b}signature_hash"), pairs_frame(spark, rules.signature_pairs()))
    if rules.file_pairs:
        path = lambda side: scalars.relative_path(F.col(f"{side}file_path"), root) if root else F.col(f"{side}file_path")
        pairs = without_pairs(pairs, path(a), path(b), pairs_frame(spark, rules.path_pairs()))
    if rules.files:
        for side in (a, b) if both else (b,):
            pairs = pairs.where(~is_excluded_file(F.col(f"{side}file_path"), rules.globs(), root))
    return pairs


def scan(chunks: DataFrame, threshold: float = SCAN_THRESHOLD, top: int | None = SCAN_TOP, rules: Exclusions | None = None, root: str = "", neighbours: int = SCAN_NEIGHBOURS) -> DataFrame:
    """Similar pairs of the index (a_id < b_id) by combined distance: each row's nearest neighbours, itself included."""
    queries = chunks
    if rules is not None and rules.files:
        queries = chunks.where(~is_excluded_file(F.col("file_path"), rules.globs(), root))
    found = knn(queries.select("id", "embedding"), chunks.select("id", "embedding"), neighbours)
    # Both directions of a pair have the same distance and fate, so one is enough; what the rules and the overlap need is
    # only made for the chunks of the pairs that are left.
    near = materialize(found.where((F.col("distance") <= threshold) & (F.col("query_id") != F.col("id"))).select("query_id", "id", "distance"), "neighbours")
    near = near.groupBy(F.least("query_id", "id").alias("a_id"), F.greatest("query_id", "id").alias("b_id")).agg(F.min("distance").alias("raw_distance"))
    plain = [c for c in INFO if c != "tokens"]
    pairs = _with_sides(near, chunks, plain).where(~is_related("a_", "b_"))
    kept = materialize(apply_rules(pairs, rules, "a_", "b_", root, both=True), "pairs")
    kept = _with_sides(kept, tokens_of(chunks, _ids(kept)), ["tokens"])
    kept = with_jaccard(kept, "a_tokens", "b_tokens")
    distance = F.round(scalars.combined(F.col("raw_distance"), F.col("jaccard")), COMBINED_DECIMALS)
    scored = kept.select("a_id", "b_id", "raw_distance", "jaccard", *(f"{side}_{name}" for name in ("file_path", "function_name") for side in "ab")).withColumn("distance", distance).withColumn("similarity", scalars.tier(F.col("distance")))
    return scored if top is None else scored.orderBy("distance", "a_id", "b_id").limit(top)


def query(queries: DataFrame, index: DataFrame, top: int = QUERY_TOP, threshold: float = QUERY_THRESHOLD, rules: Exclusions | None = None, root: str = "") -> DataFrame:
    """(query_id, id, rank, raw_distance, jaccard, distance, similarity, ...): the best candidates of each query chunk."""
    found = knn(queries.select("id", "embedding"), index.select("id", "embedding"), OVERFETCH * top)
    near = found.where((F.col("distance") <= threshold) & (F.col("query_id") != F.col("id"))).select("query_id", "id", F.col("distance").alias("raw_distance"))
    near = materialize(near, "neighbours")
    plain = [c for c in INFO if c != "tokens"]
    pairs = near.join(info(queries, "q_", "query_id", plain), "query_id").join(info(index, "n_", "id", plain), "id").where(~is_related("q_", "n_"))
    kept = materialize(apply_rules(pairs, rules, "q_", "n_", root), "pairs")
    asked, left = kept.select(F.col("query_id").alias("id")).distinct(), kept.select("id").distinct()
    own, other = [tokens_of(index, asked.union(left).distinct())] * 2 if queries is index else (tokens_of(queries, asked), tokens_of(index, left))
    kept = kept.join(info(own, "q_", "query_id", ["tokens"]), "query_id").join(info(other, "n_", "id", ["tokens"]), "id")
    scored = with_jaccard(kept, "q_tokens", "n_tokens")
    scored = scored.withColumn("distance", F.round(scalars.combined(F.col("raw_distance"), F.col("jaccard")), COMBINED_DECIMALS))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "raw_distance", "id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "id", "rank", "raw_distance", "jaccard", "distance", scalars.tier(F.col("distance")).alias("similarity"), F.col("n_file_path").alias("file_path"), F.col("n_function_name").alias("function_name"))


def nested(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, candidates): every query chunk with its candidates by rank, an empty list where there are none."""
    fields = [c for c in candidates.columns if c != "query_id"]
    listed = candidates.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in fields if c != "rank")))).alias("candidates"))
    empty = F.array().cast(listed.schema["candidates"].dataType)
    return queries.select("id").join(listed, "id", "left").select("id", F.coalesce("candidates", empty).alias("candidates"))


def by_tier(pairs: DataFrame) -> DataFrame:
    """(similarity, tier_rank, pairs): how many pairs each tier has, in the tiers' order."""
    rank = F.array_position(F.array(*map(F.lit, scalars.TIER_ORDER)), F.col("similarity"))
    return pairs.groupBy("similarity").agg(F.count(F.lit(1)).alias("pairs")).select("similarity", rank.cast("int").alias("tier_rank"), "pairs")
