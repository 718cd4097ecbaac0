"""What the command line and the tool server can do, as functions from arguments to results."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import functions as F

from .index import Index
from .operators import exclusions


def today() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d")


def relative(index: Index, path: str) -> str:
    full = Path(path)
    try:
        return full.resolve().relative_to(index.root).as_posix() if full.is_absolute() else full.as_posix().removeprefix("./")
    except ValueError:
        return path


def _side(index: Index, path: str, function: str) -> exclusions.Side:
    path = relative(index, path)
    row = index.require().chunks().where((F.col("file_path") == path) & (F.col("function_name") == function)).orderBy("start_line").select("signature_hash").first()
    if row is None:
        raise ValueError(f"no function {function} in {path}")
    return exclusions.Side(path, function, row["signature_hash"])


def exclude_pair(index: Index, a: tuple[str, str], b: tuple[str, str], reason: str = "") -> dict:
    """Exclude a pair of functions by (path, name)."""
    sides = [_side(index, *side) for side in (a, b)]
    return exclude_sides(index, *((side.path, side.function, side.signatureHash) for side in sides), reason)


def exclude_sides(index: Index, a: tuple[str, str, str], b: tuple[str, str, str], reason: str = "") -> dict:
    """Exclude a pair of functions by (path, name, signature hash)."""
    rules = exclusions.read(index.root)
    one, two = (exclusions.Side(relative(index, path), name, hashed) for path, name, hashed in (a, b))
    added = rules.add_pair(exclusions.PairExclusion(one, two, reason, today()))
    exclusions.save(index.root, rules)
    return {"added": added, "exclusions": len(rules.pairs)}


def exclude_file(index: Index, pattern: str, reason: str = "") -> dict:
    rules = exclusions.read(index.root)
    added = rules.add_file(exclusions.FileExclusion(pattern, reason, today()))
    exclusions.save(index.root, rules)
    return {"added": added, "fileExclusions": len(rules.files)}


def exclude_file_pair(index: Index, a: str, b: str, reason: str = "") -> dict:
    rules = exclusions.read(index.root)
    added = rules.add_file_pair(exclusions.FilePairExclusion(relative(index, a), relative(index, b), reason, today()))
    exclusions.save(index.root, rules)
    return {"added": added, "filePairExclusions": len(rules.file_pairs)}


def exclude_file_group(index: Index, paths: list[str], reason: str = "") -> dict:
    if len(paths) < 2:
        raise ValueError("a group needs two files or more")
    rules = exclusions.read(index.root)
    added = rules.add_group([relative(index, p) for p in paths], reason, today())
    exclusions.save(index.root, rules)
    return {"added": added, "filePairExclusions": len(rules.file_pairs)}
