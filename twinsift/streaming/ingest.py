"""Keeping an index up to date from a stream of file versions (Structured Streaming, one snapshot for each batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..chunker import parse_files
from ..embedding import Embedder, embed_texts
from ..index import Store
from ..operators import changes
from ..schema import SCHEMA_VERSION, STORED, TRACKED

#: What a stream of file versions has; a null source deletes the file.
VERSIONS = "file_path string, source string, mtime_ms long"


def merge_versions(store: Store, versions: DataFrame, embedder: Embedder) -> None:
    """Bring a snapshot up to date with the newest of the given versions of each file; running it again changes nothing."""
    newest = Window.partitionBy("file_path").orderBy(F.desc("mtime_ms"), F.desc("source"))
    files = versions.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n").withColumn("content_hash", F.sha2("source", 256)).persist()
    try:
        current, tracked = files.where("source is not null"), store.read("files", TRACKED)
        touched = tracked.join(files.select("file_path"), "file_path", "left_semi")
        diff = changes.file_changes(current, touched, trust_mtime=False).persist()
        fresh = parse_files(current.join(diff.where("status in ('added', 'modified')"), "file_path", "left_semi")).where("id is not null").drop("error")
        chunks = changes.merge_chunks(store.read("chunks", STORED), fresh.withColumn("content_hash", F.sha2("source_text", 256)), diff)
        missing = chunks.where("embedding is null").groupBy("content_hash").agg(F.min("source_text").alias("source_text"))
        filled = changes.with_embeddings(chunks, embed_texts(missing, embedder))
        store.write({"chunks": filled, "files": changes.merge_tracked(tracked, current, diff)}, {**store.meta(), "schema_version": SCHEMA_VERSION, "model_name": embedder.model, "model_dimensions": embedder.dimensions})
        diff.unpersist()
    finally:
        files.unpersist()


def follow(versions: DataFrame, folder: str, embedder: Embedder, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that merges every batch of a stream of versions into the index in `folder`."""
    store = Store(versions.sparkSession, folder)
    writer = versions.writeStream.foreachBatch(lambda batch, _: merge_versions(store, batch, embedder)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
