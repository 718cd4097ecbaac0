"""Exclusion rules as anti-joins, and the file that holds them."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import relative_path
from ..sources.globs import GlobSet

FILE_NAME, LEGACY_FILE_NAME = ".twinsift-ignore.json", ".code-ignore.json"
VERSION = 1


@dataclass
class Side:
    path: str
    function: str
    signatureHash: str  # noqa: N815  the file's own spelling


@dataclass
class PairExclusion:
    a: Side
    b: Side
    reason: str = ""
    added: str = ""


@dataclass
class FileExclusion:
    pattern: str
    reason: str = ""
    added: str = ""


@dataclass
class FilePairExclusion:
    a: str
    b: str
    reason: str = ""
    added: str = ""


@dataclass
class Exclusions:
    pairs: list[PairExclusion] = field(default_factory=list)
    files: list[FileExclusion] = field(default_factory=list)
    file_pairs: list[FilePairExclusion] = field(default_factory=list)

    def signature_pairs(self) -> set[tuple[str, str]]:
        return {ordered(e.a.signatureHash, e.b.signatureHash) for e in self.pairs}

    def path_pairs(self) -> set[tuple[str, str]]:
        return {ordered(e.a, e.b) for e in self.file_pairs}

    def add_pair(self, exclusion: PairExclusion) -> bool:
        if ordered(exclusion.a.signatureHash, exclusion.b.signatureHash) in self.signature_pairs():
            return False
        self.pairs.append(exclusion)
        return True

    def add_file(self, exclusion: FileExclusion) -> bool:
        if any(e.pattern == exclusion.pattern for e in self.files):
            return False
        self.files.append(exclusion)
        return True

    def add_file_pair(self, exclusion: FilePairExclusion) -> bool:
        if ordered(exclusion.a, exclusion.b) in self.path_pairs():
            return False
        self.file_pairs.append(FilePairExclusion(*ordered(exclusion.a, exclusion.b), exclusion.reason, exclusion.added))
        return True

    def add_group(self, paths: list[str], reason: str, added: str) -> int:
        """All pairs of a group of files; how many were new."""
        return sum(self.add_file_pair(FilePairExclusion(a, b, reason, added)) for i, a in enumerate(paths) for b in paths[i + 1 :])

    def globs(self) -> GlobSet:
        return GlobSet([e.pattern for e in self.files])


def ordered(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a <= b else (b, a)


def read(root: str) -> Exclusions:
    """The rules of a project; a file that can't be read or has another version counts as empty, with a warning."""
    path = next((p for name in (FILE_NAME, LEGACY_FILE_NAME) if (p := Path(root) / name).exists()), None)
    if path is None:
        return Exclusions()
    try:
        data = json.loads(path.read_text())
        if data["version"] != VERSION:
            raise ValueError(f"version {data['version']}")
        pairs = [PairExclusion(Side(**e["pair"]["a"]), Side(**e["pair"]["b"]), e.get("reason", ""), e.get("added", "")) for e in data["exclusions"]]
        return Exclusions(pairs, [FileExclusion(**e) for e in data.get("fileExclusions", [])], [FilePairExclusion(**e) for e in data.get("filePairExclusions", [])])
    except (OSError, ValueError, KeyError, TypeError) as error:
        warnings.warn(f"{path} is ignored: {error}", stacklevel=2)
        return Exclusions()


def save(root: str, rules: Exclusions) -> None:
    data = {
        "version": VERSION,
        "exclusions": [{"reason": e.reason, "added": e.added, "pair": {"a": asdict(e.a), "b": asdict(e.b)}} for e in rules.pairs],
        "fileExclusions": [asdict(e) for e in rules.files],
        "filePairExclusions": [asdict(e) for e in rules.file_pairs],
    }
    try:
        (Path(root) / FILE_NAME).write_text(json.dumps(data, indent=2) + "\n")
    except OSError as error:
        warnings.warn(f"{FILE_NAME} isn't written: {error}", stacklevel=2)


def pairs_frame(spark: SparkSession, pairs) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in sorted(pairs)], "lo string, hi string")


def without_pairs(rows: DataFrame, a: Column, b: Column, pairs: DataFrame) -> DataFrame:
    """rows without those whose unordered (a, b) is in pairs (lo, hi); rows with a null side stay."""
    return rows.join(pairs.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi")), (F.least(a, b) == F.col("__lo")) & (F.greatest(a, b) == F.col("__hi")) & a.isNotNull() & b.isNotNull(), "left_anti")


def is_excluded_file(path: Column, globs: GlobSet, root: str = "") -> Column:
    return globs.matches(relative_path(path, root) if root else path)


def stale(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(signature_hash) of exclusion sides (a_hash, b_hash) that no chunk has any more."""
    sides = pairs.select(F.explode(F.array("a_hash", "b_hash")).alias("signature_hash")).distinct()
    return sides.join(known.select("signature_hash").distinct(), "signature_hash", "left_anti")


GROUP_PARTS = 16


def group_pairs(paths: DataFrame, existing: DataFrame, path_col: str = "path", group_col: str | None = None) -> DataFrame:
    """(lo, hi): all pairs of paths of the same group that aren't in existing yet.

    The pairs are the result itself, so their number is a group's square; a group's paths are dealt into GROUP_PARTS
    parts on either side, so that they are made by as many tasks as there are pairs of parts.
    """
    group = F.lit(0) if group_col is None else F.col(group_col)
    one = paths.select(group.alias("__g"), F.col(path_col).alias("lo")).distinct()
    part, every = F.pmod(F.xxhash64("lo"), F.lit(GROUP_PARTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(GROUP_PARTS - 1)))
    low = one.withColumn("__a", part).withColumn("__b", every)
    high = one.withColumn("__b", part).withColumn("__a", every).withColumnRenamed("lo", "hi")
    return low.join(high, ["__g", "__a", "__b"]).where("lo < hi").select("lo", "hi").distinct().join(existing, ["lo", "hi"], "left_anti")
