"""From source files to chunks: functions and blocks with their tokens and signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CHUNK
from ..session import ship
from .python import Python
from .rust import Rust
from .script import JavaScript, TypeScript, TypeScriptJsx
from .tree import Chunker, Language

#: More specific extensions first.
LANGUAGES: list[Language] = [TypeScriptJsx(), TypeScript(), JavaScript(), Rust(), Python()]


def register(language: Language) -> None:
    """Add a language, ahead of the others."""
    LANGUAGES.insert(0, language)


def language_of(path: str, languages: list[Language] | None = None) -> Language | None:
    name = path.rsplit("/", 1)[-1]
    return next((x for x in (LANGUAGES if languages is None else languages) if name.endswith(x.extensions) and not name.startswith(tuple(e for e in x.extensions if name == e))), None)


def is_source(path: str, languages: list[Language] | None = None) -> bool:
    """Whether a file's name is one of a language's and not excluded by it."""
    language = language_of(path, languages)
    return language is not None and not language.is_excluded(path.rsplit("/", 1)[-1])


def parse_source(text: str, path: str, languages: list[Language] | None = None) -> tuple[list[dict], list[str]]:
    """(chunks, errors) of a file's text, by the registered languages unless others are given."""
    language = language_of(path, languages)
    if language is None:
        return [], [f"Unsupported file: {path}"]
    chunker = Chunker(path, text, language.parse(text), language)
    return list(chunker.chunks()), chunker.errors()


PARSED = T.StructType([*CHUNK.fields, T.StructField("error", T.StringType())])


def parse_files(files: DataFrame, path_col: str = "file_path", text_col: str = "source", excluded: bool = True) -> DataFrame:
    """Chunks of all files (see PARSED), and a row with an error for each fault; a null text is one.

    Without `excluded`, files that their language leaves out by name give nothing.
    """
    ship(files.sparkSession)
    names, languages = [field.name for field in PARSED.fields], list(LANGUAGES)  # the driver's, as executors have their own list

    def rows(path: str, text: str | None):
        if not excluded and not is_source(path, languages):
            return []
        if text is None:
            return [{"file_path": path, "error": f"Unreadable file: {path}"}]
        chunks, errors = parse_source(text, path, languages)
        return [*chunks, *({"file_path": path, "error": error} for error in errors)]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                found = [row for path, text in zip(part["path"], part["text"], strict=True) for row in rows(path, text)]
                out = pd.DataFrame(found, columns=names).astype(object)
                yield out.where(out.notna(), None)

    return files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(run, PARSED)


def register_sql(spark: SparkSession, name: str = "chunk_source") -> None:
    """A table function for SQL: chunk_source(path, text)."""
    ship(spark)
    languages = list(LANGUAGES)

    @F.udtf(returnType=PARSED)
    class ChunkSource:
        def eval(self, path: str, text: str):
            chunks, errors = parse_source(text, path, languages) if text is not None else ([], [f"Unreadable file: {path}"])
            for row in [*chunks, *({"file_path": path, "error": error} for error in errors)]:
                params = None if row.get("params") is None else [(p["name"], p["type"]) for p in row["params"]]
                yield tuple(params if field.name == "params" else row.get(field.name) for field in PARSED.fields)

    spark.udtf.register(name, ChunkSource)
