"""The engine's relations, derived from the given tables; each function has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.exclusions import Exclusions, FileExclusion, FilePairExclusion, PairExclusion, Side
from ..session import spread

THRESHOLD = 0.7

RULES = Exclusions(
    pairs=[PairExclusion(Side("", "", "fn_0"), Side("", "", "fn_1"))],
    files=[FileExclusion("src1?"), FileExclusion("!src12")],
    file_pairs=[FilePairExclusion("src2", "src3"), FilePairExclusion("src0", "src5"), FilePairExclusion("src0", "src0")],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks without vectors."""
    n = F.col("doc_id")
    block = n % 3 == 0
    return spread(table(spark, sf_dir, "documents")).select(
        n.alias("id"),
        F.col("source").alias("file_path"),
        F.concat(F.lit("fn_"), (n % 50).cast("string")).alias("function_name"),
        F.when(block, "block").otherwise("function").alias("chunk_type"),
        F.when(block, F.concat(F.lit("fn_"), ((n + 20) % 50).cast("string"))).alias("context"),
        F.concat(F.lit("fn_"), (n % 50).cast("string")).alias("signature_hash"),
        "text",
        scalars.content_hash(F.col("text")).alias("content_hash"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, with their tokens."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return documents(spark, sf_dir).join(vectors, "id").withColumn("tokens", scalars.tokens_of(F.col("text"))).drop("text")


DOCUMENTS_SQL = """
docs AS (SELECT doc_id AS id, source AS file_path, 'fn_' || (doc_id % 50) AS function_name,
         CASE WHEN doc_id % 3 = 0 THEN 'block' ELSE 'function' END AS chunk_type,
         CASE WHEN doc_id % 3 = 0 THEN 'fn_' || ((doc_id + 20) % 50) END AS context,
         'fn_' || (doc_id % 50) AS signature_hash, text, sha256(text) AS content_hash FROM documents)"""

TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: strlen(w) > 1))"

CHUNKS_SQL = f"""{DOCUMENTS_SQL},
chunks AS (SELECT docs.* EXCLUDE (text), {TOKENS_SQL} AS tokens, CAST(embedding AS DOUBLE[]) AS v FROM docs JOIN embeddings ON vec_id = id)"""


def distance_sql(a: str, b: str) -> str:
    return f"(round(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6) + CAST(0 AS DOUBLE))"


def jaccard_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    both = f"(len({a}) + len({b}) - {common})"
    return f"round(CASE WHEN {both} = 0 THEN CAST(1 AS DOUBLE) ELSE {common} / CAST({both} AS DOUBLE) END, 6)"


def combined_sql(distance: str, overlap: str) -> str:
    return f"round({distance} * CAST(0.7 AS DOUBLE) + (1 - {overlap}) * (1 - CAST(0.7 AS DOUBLE)), 8)"


def tier_sql(distance: str) -> str:
    return "CASE " + " ".join(f"WHEN {distance} <= {bound} THEN '{name}'" for bound, name in scalars.TIERS) + f" ELSE '{scalars.LAST_TIER}' END"


def related_sql(a: str, b: str) -> str:
    child = lambda x, y: f"({x}.chunk_type = 'block' AND {y}.chunk_type = 'function' AND {x}.context = {y}.function_name)"
    siblings = f"({a}.chunk_type = 'block' AND {b}.chunk_type = 'block' AND {a}.context = {b}.context)"
    return f"({a}.file_path = {b}.file_path AND coalesce({child(a, b)} OR {child(b, a)} OR {siblings}, false))"
