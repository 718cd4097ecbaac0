"""Version control as a source: diffs, files at a revision, work trees."""

from __future__ import annotations

import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import name_status
from ..session import ship


class GitError(RuntimeError):
    """A git command failed."""


def git(root: str, *arguments: str) -> str | None:
    """Output of a git command in root; None if it fails."""
    done = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *arguments], capture_output=True)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def is_repository(root: str) -> bool:
    return (git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def head(root: str) -> str | None:
    found = git(root, "rev-parse", "HEAD")
    return found.strip() if found else None


def top_level(root: str) -> str | None:
    found = git(root, "rev-parse", "--show-toplevel")
    return found.strip() if found else None


def common_dir(root: str) -> str | None:
    """The folder that all work trees share."""
    found = git(root, "rev-parse", "--git-common-dir")
    return str((Path(root) / found.strip()).resolve()) if found else None


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in text.split("\n")], "value string")


def diff_working_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, status) of the work tree, staged or not, against HEAD."""
    text = git(root, "diff", "--name-status", "HEAD")
    if text is None:
        raise GitError("the work tree can't be compared with HEAD")
    return name_status(_lines(spark, text))


def diff_commit(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """(path, status) of a commit against its first parent, or of all its files if it has none."""
    text = git(root, "diff", "--name-status", "--end-of-options", f"{commit}^", commit, "--")
    if text is None:
        text = git(root, "diff-tree", "--root", "--no-commit-id", "--name-status", "-r", "--end-of-options", commit, "--")
    if text is None:
        raise GitError(f"no commit {commit}")
    return name_status(_lines(spark, text))


def file_at(root: str, revision: str, path: str) -> str | None:
    return git(root, "show", "--end-of-options", f"{revision}:{path}")


def read_versions(paths: DataFrame, root: str, revision: str | None) -> DataFrame:
    """(file_path, source) of the paths, at a revision or in the work tree, of a repository that every executor sees."""
    ship(paths.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [working_file(root, path) if revision is None else file_at(root, revision, path) for path in batch["path"]]
            yield pd.DataFrame({"file_path": batch["path"], "source": texts})

    return paths.select("path").mapInPandas(run, "file_path string, source string").where("source is not null")


def working_file(root: str, path: str) -> str | None:
    try:
        return (Path(root) / path).read_bytes().decode("utf-8", "replace")
    except OSError:
        return None


def worktree_paths(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path) from the lines of a porcelain listing of work trees."""
    return lines.where(F.col(column).startswith("worktree ")).select(F.expr(f"substring({column}, 10)").alias("path"))


def worktrees(root: str) -> list[str]:
    text = git(root, "worktree", "list", "--porcelain") or ""
    return [line.removeprefix("worktree ") for line in text.split("\n") if line.startswith("worktree ")]


def staleness(root: str, indexed_head: str | None) -> str | None:
    """A warning if the index was made at another commit."""
    now = head(root)
    if not indexed_head or not now or now == indexed_head:
        return None
    return f"index was built at {indexed_head[:8]}, HEAD is {now[:8]}"
