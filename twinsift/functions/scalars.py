"""Scalar functions as Column expressions; all run inside the JVM except the byte cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHA = 0.7
TIERS = [(0.01, "identical"), (0.05, "nearly identical"), (0.12, "very similar"), (0.20, "similar")]
LAST_TIER = "weak"
TIER_ORDER = [*(name for _, name in TIERS), LAST_TIER]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: Unicode's white space, as a class of Java's and Python's expressions.
WHITE_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def normal_type(value: Column, missing: str) -> Column:
    """Type text without white space, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit(missing)), f"{WHITE_SPACE}+", ""))


def signature_hash(name: Column, params: Column, return_type: Column) -> Column:
    """First 16 hex digits over the name, the parameter types and the return type; params is an array of (name, type)."""
    types = F.array_join(F.transform(params, lambda p: normal_type(p["type"], "any")), ",")
    return F.substring(F.sha2(F.concat(F.lower(F.regexp_replace(name, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")), F.lit("("), types, F.lit("):"), normal_type(return_type, "void")), 256), 1, 16)


def chunk_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, line.cast("string"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, in double precision; null if a vector is zero."""
    return F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets: 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def combined(distance: Column, overlap: Column, alpha: float = ALPHA) -> Column:
    return distance * alpha + (1 - overlap) * (1 - alpha)


def tier(distance: Column) -> Column:
    out = F
    for bound, name in TIERS:
        out = out.when(distance <= bound, name)
    return out.otherwise(LAST_TIER)


def line_count(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1


def tokens_of(text: Column) -> Column:
    """Sorted distinct lower-case word tokens of more than one byte."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), 0)))


def signature_text(params: Column, return_type: Column) -> Column:
    """`(a: T, b) => R`."""
    listed = F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")))), ", ")
    return F.concat(F.lit("("), listed, F.lit(")"), F.coalesce(F.concat(F.lit(" => "), return_type), F.lit("")))


def block_signature(lines: Column) -> Column:
    return F.format_string("<block> (%d lines)", lines)


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def similarity_text(distance: Column) -> Column:
    """Similarity with two decimals."""
    return F.format_string("%.2f", F.lit(1.0) - distance)


def similarity_percent(distance: Column) -> Column:
    """Similarity in whole percent, cut off."""
    return ((F.lit(1.0) - distance) * 100).cast("int")


def display_name(name: Column, chunk_type: Column, context: Column) -> Column:
    """Blocks are shown with the function that they are in."""
    return F.when((chunk_type == "block") & context.isNotNull(), F.concat(name, F.lit(" in "), context)).otherwise(name)


@F.pandas_udf(T.StringType())
def cut_bytes(text: pd.Series, limit: pd.Series) -> pd.Series:
    """At most `limit` bytes of UTF-8, ending between characters."""
    return pd.Series([None if t is None else t.encode()[: int(n)].decode(errors="ignore") for t, n in zip(text, limit, strict=True)])


def max_input_bytes(context_tokens: int | None) -> int:
    return 2 * context_tokens if context_tokens else 16_000


def encode_vector(values) -> bytes:
    return np.asarray(values, dtype="<f4").tobytes()


def decode_vector(data: bytes) -> list[float]:
    """32-bit floats, little-endian; bytes of an unfinished last one are ignored."""
    return np.frombuffer(data[: len(data) // 4 * 4], dtype="<f4").tolist()
