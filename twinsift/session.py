"""Session helpers: shipping the package to executors and shared scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: list[tuple[SparkSession, str]] = []
_temporary: ContextVar[list | None] = ContextVar("temporary", default=None)


#: Bytes of an Arrow batch where the session sets none; long texts must not fill a worker's memory.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable by the executors' Python workers (once for each application), and bound batches."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="twinsift-")) / "twinsift.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def tidy() -> None:
    """In a Python worker at the end of a task: give freed memory back, since the worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to all cores if it would leave most of them idle: a small file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one, which only a local master can share."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='twinsift-checkpoints-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/twinsift/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Within `temporaries()` the table goes when that ends, unless it is to be kept.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    passing = _temporary.get()
    if passing is not None and not keep:
        passing.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporaries() -> Iterator[None]:
    """Tables that are materialized inside, and not kept, are deleted at the end."""
    token = _temporary.set([])
    try:
        yield
    finally:
        for spark, path in _temporary.get():
            drop_path(spark, path)
        _temporary.reset(token)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _scratch:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
