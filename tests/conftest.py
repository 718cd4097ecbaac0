import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def project(tmp_path):
    """A git project with a few source files."""
    import subprocess

    files = {
        "src/a.ts": "export function addAll(values: number[]): number {\n  let total = 0;\n  for (const v of values) {\n    total += v;\n  }\n  return total;\n}\n",
        "src/b.ts": "export function sumAll(values: number[]): number {\n  let total = 0;\n  for (const v of values) {\n    total += v;\n  }\n  return total;\n}\n",
        "src/c.py": "def greet(name):\n    message = 'hello ' + name\n    return message\n",
        "src/a.test.ts": "function hidden() {\n  a();\n  b();\n}\n",
        "build/skip.ts": "function skipped() {\n  a();\n  b();\n}\n",
        ".gitignore": "build/\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    env = os.environ | {"GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@example.com", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@example.com"}
    run = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, env=env, check=True, capture_output=True)
    (tmp_path / ".git").exists() or run("init", "-q")
    (tmp_path / ".git/info/exclude").write_text(".twinsift/\n")
    run("add", "-A")
    run("commit", "-qm", "first")
    return tmp_path, run
