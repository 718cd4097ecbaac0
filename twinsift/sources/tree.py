"""Source trees: which files of a project count, and their texts as a DataFrame."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chunker import LANGUAGES, is_source
from ..session import ship
from .globs import GlobSet, parse_rule

MARKERS = (".git", "package.json")
IGNORE_FILES = (".gitignore", ".ignore")


def project_root(start: str) -> str:
    """The nearest folder from start upwards that has a marker, or start."""
    here = Path(start).resolve()
    return str(next((p for p in (here, *here.parents) if any((p / m).exists() for m in MARKERS)), here))


class _Level:
    """The ignore rules of one folder."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.globs = folder, GlobSet(lines)

    def decides(self, path: str, directory: bool) -> bool | None:
        inner = path[len(self.folder) + 1 :] if self.folder else path
        return self.globs._decides(inner, directory)


def _lines(folder: Path) -> list[str]:
    out = []
    for name in IGNORE_FILES:
        try:
            out += (folder / name).read_text(errors="replace").split("\n")
        except OSError:
            continue
    return [line for line in out if parse_rule(line)]


def source_paths(root: str, prefix: str = "", globs: GlobSet | None = None) -> list[str]:
    """Paths below root, relative to it and sorted, of source files that no rule ignores; hidden ones are left out."""
    top, out = Path(root), []

    def walk(folder: str, levels: list[_Level]) -> None:
        here = top / folder
        lines = _lines(here)
        if not folder and (exclude := top / ".git/info/exclude").is_file():
            lines = [x for x in exclude.read_text(errors="replace").split("\n") if parse_rule(x)] + lines
        levels = [*levels, _Level(folder, lines)] if lines else levels
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.name.startswith(".") or entry.is_symlink():
                continue
            directory = entry.is_dir()
            decided = next((d for level in reversed(levels) if (d := level.decides(path, directory)) is not None), False)
            if decided:
                continue
            if directory:
                walk(path, levels)
            elif is_source(path) and path.startswith(prefix) and not (globs and globs.ignores(path)):
                out.append(path)

    walk("", [])
    return sorted(out)


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(file_path, source, mtime_ms) of files below a root that every executor sees; unreadable ones have a null source."""
    ship(spark)

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch["file_path"]:
                try:
                    full = os.path.join(root, path)
                    with open(full, "rb") as file:
                        rows.append((path, file.read().decode("utf-8"), int(os.stat(full).st_mtime * 1000)))
                except (OSError, UnicodeDecodeError):
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["file_path", "source", "mtime_ms"]).astype({"mtime_ms": "Int64"})

    listed = spark.createDataFrame([(path,) for path in paths], "file_path string")
    return listed.mapInPandas(run, "file_path string, source string, mtime_ms long")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, source, mtime_ms) of all files below a path of any store that Spark reads, source files only."""
    root = path.rstrip("/")
    endings = ",".join(sorted({ending.lstrip(".") for language in LANGUAGES for ending in language.extensions}))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{endings}}}").load(root)
    relative = F.regexp_extract("path", "[^:]*?" + root.split(":", 1)[-1].lstrip("/") + "/(.*)$", 1)
    ship(spark)
    languages = list(LANGUAGES)

    @F.pandas_udf("boolean")
    def keep(paths: pd.Series) -> pd.Series:
        return paths.map(lambda path: is_source(path, languages)).astype(bool)

    return files.select(relative.alias("file_path"), F.expr("try_validate_utf8(cast(content as string))").alias("source"), (F.unix_millis("modificationTime")).alias("mtime_ms")).where(keep("file_path"))
