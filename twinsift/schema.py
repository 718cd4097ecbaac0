"""Relations of the engine as Spark schemas."""

from pyspark.sql import types as T

PARAM = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("source_text", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("params", T.ArrayType(PARAM)),
        T.StructField("return_type", T.StringType()),
        T.StructField("is_exported", T.BooleanType()),
        T.StructField("signature_hash", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)

#: A chunk as an index keeps it.
STORED = T.StructType([*CHUNK.fields, T.StructField("content_hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

TRACKED = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("mtime_ms", T.LongType()), T.StructField("indexed_at", T.TimestampType())])

CACHED = T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

DIFF = T.StructType([T.StructField("path", T.StringType()), T.StructField("status", T.StringType())])

SCHEMA_VERSION = 4
