"""A corpus pipeline over `documents`: language, near duplicates, benchmark contamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of docs, among which are doc_id, text, lang and n_chars; further ones stay.

Defined cases: null and empty texts and those without a letter go in the first stage; rows of equal or near texts are one
document each, the one with the smallest id (rows whose ids are all null: any one); rows that share an id but not a text
are documents of their own; a text that only the language stage can't tell, as too short, stays; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import decontaminate, jaccard, language, packing, pii
from twinsift.session import materialize, spread


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in no learned language; learns from the stage's own labelled rows."""
    return language.only_identified(docs, language.train(docs, F.lit(True)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component, once."""
    return jaccard.keep_one(docs, jaccard.near_duplicates(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least half of a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and updates their lengths."""
    return pii.mask_pii(docs, pii.fit(docs), length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, sparing=True)  # beside what the stages before have left in the executors


STAGES = [
    ("language", identified_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", masked_pii),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
