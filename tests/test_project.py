"""Index, questions and rules over a project on disk."""

import io
import json

import pytest

from twinsift import cli, commands, embedding, search
from twinsift import index as index_module
from twinsift.index import Index, IndexStateError
from twinsift.rpc import Server
from twinsift.sources import repository
from twinsift.sources.tree import project_root, source_paths


class Counting(embedding.HashingEmbedder):
    calls = 0

    def embed(self, texts):
        type(self).calls += len(texts)
        return super().embed(texts)


def test_listing(project):
    root, _ = project
    assert source_paths(str(root)) == ["src/a.ts", "src/b.ts", "src/c.py"]
    assert project_root(str(root / "src")) == str(root)


def test_index_query_scan_status(spark, project):
    root, _ = project
    index = Index(spark, str(root))
    with pytest.raises(IndexStateError):
        index.require()
    result = index.run(embedding.HashingEmbedder())
    assert (result.added, result.functions_indexed, result.embedded, result.status) == (3, 3, 3, "complete")
    again = index.run(embedding.HashingEmbedder())
    assert (again.added, again.unchanged, again.embedded) == (0, 3, 0)

    pairs = search.scan(index, threshold=0.9)
    assert {(m["a"]["functionName"], m["b"]["functionName"]) for m in pairs["matches"]} >= {("addAll", "sumAll")} and pairs["chunksScanned"] == 3
    found = search.query_source(index, embedding.HashingEmbedder(), (root / "src/a.ts").read_text().replace("addAll", "plus"), threshold=0.9)
    assert found["functions"][0]["functionName"] == "plus" and {c["functionName"] for c in found["functions"][0]["candidates"]} >= {"addAll", "sumAll"}
    assert search.query_source(index, embedding.HashingEmbedder(), "x = 1", "a.py")["warnings"] == ["No functions found in input."]

    status = index.status()
    assert status["totalFunctions"] == 3 and status["unembedded"] == 0 and status["cacheEntries"] == 3 and not status["warnings"]


def test_changes_and_cache(spark, project):
    root, run = project
    index = Index(spark, str(root))
    index.run(embedding.HashingEmbedder())
    (root / "src/a.ts").write_text((root / "src/a.ts").read_text().replace("total", "amount"))
    (root / "src/b.ts").unlink()
    (root / "src/d.py").write_text("def other(x):\n    y = x\n    return y\n")
    assert index.dry_run() == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 1}
    result = index.run(embedding.HashingEmbedder())
    assert (result.added, result.modified, result.deleted, result.unchanged, result.embedded) == (1, 1, 1, 1, 2)
    assert index.status()["cacheEntries"] == 5
    assert index.prune_cache()["entriesRemoved"] == 2
    (root / ".twinsift").rename(root / "old-index")
    Counting.calls = 0
    fresh = Index(spark, str(root)).run(Counting())
    assert fresh.cached == 3 and fresh.embedded == 0


def test_scope_force_and_models(spark, project):
    root, _ = project
    index = Index(spark, str(root))
    index.run(embedding.HashingEmbedder())
    (root / "lib").mkdir()
    (root / "lib/e.py").write_text("def extra(x):\n    y = x\n    return y\n")
    result = index.run(embedding.HashingEmbedder(), prefix="lib/")
    assert (result.added, result.deleted) == (1, 0) and index.chunks().count() == 4
    other = embedding.HashingEmbedder(32, "hashing-32")
    with pytest.raises(IndexStateError):
        index.run(other)
    assert index.run(other, force=True).embedded == 4
    stopped = index.run(embedding.HashingEmbedder(), force=True, cancelled=lambda: True)
    assert stopped.status == "cancelled" and index.embedded().count() == 0
    assert index.run(embedding.HashingEmbedder()).functions_indexed == 4 and index.embedded().count() == 4


def test_no_cache_without_git(spark, tmp_path):
    (tmp_path / "package.json").write_text("{}")
    (tmp_path / "a.py").write_text("def f(a):\n    b = a\n    return b\n")
    index = Index(spark, str(tmp_path))
    assert index.cache is None and index.run(embedding.HashingEmbedder()).embedded == 1


def test_empty_project(spark, tmp_path):
    (tmp_path / "package.json").write_text("{}")
    index = Index(spark, str(tmp_path))
    assert index.run(embedding.HashingEmbedder()).functions_indexed == 0 and search.scan(index)["matches"] == []


def test_diffs(spark, project):
    root, run = project
    index = Index(spark, str(root))
    index.run(embedding.HashingEmbedder())
    (root / "src/a.ts").write_text((root / "src/a.ts").read_text().replace("addAll", "addEvery"))
    found = search.query_working_tree(index, embedding.HashingEmbedder(), threshold=0.9)
    assert [f["functionName"] for f in found["functions"]] == ["addEvery"] and found["changes"] == {"added": 1, "removed": 1}
    assert "addAll" not in {c["functionName"] for c in found["functions"][0]["candidates"]}
    run("commit", "-qam", "second")
    found = search.query_commit(index, embedding.HashingEmbedder(), repository.head(str(root)), threshold=0.9)
    assert [f["functionName"] for f in found["functions"]] == ["addEvery"] and any("HEAD" in w for w in found["warnings"])
    first = repository.git(str(root), "rev-list", "--max-parents=0", "HEAD").strip()
    assert {r["path"] for r in repository.diff_commit(spark, str(root), first).collect()} >= {"src/a.ts", "src/c.py"}
    with pytest.raises(repository.GitError):
        repository.diff_commit(spark, str(root), "nothing")


def test_rules_and_command_line(spark, project, monkeypatch, capsys):
    root, _ = project
    monkeypatch.chdir(root)
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["index"]) == 0 and json.loads(capsys.readouterr().out)["functionsIndexed"] == 3
    assert cli.main(["scan", "--threshold", "0.9", "--top-n", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["pairsFound"] == 1
    assert cli.main(["exclude", "pair", "src/a.ts:addAll", "src/b.ts:sumAll", "--reason", "twins"]) == 0
    capsys.readouterr()
    assert cli.main(["scan", "--threshold", "0.3"]) == 0 and json.loads(capsys.readouterr().out)["pairsFound"] == 0
    for arguments in (["exclude", "file", "*.gen.ts"], ["exclude", "file-pair", "src/a.ts", "src/c.py"], ["exclude", "file-group", "x.ts", "y.ts", "z.ts"], ["status"], ["cache", "prune"], ["git"], ["commit", "HEAD"], ["query", "src/c.py"], ["index", "--dry-run", "--force"]):
        assert cli.main(arguments) == 0, arguments
        json.loads(capsys.readouterr().out)
    index = Index(spark, str(root))
    assert index.status()["filePairExclusions"] == 4 and index.status()["staleExclusions"] == 0
    assert cli.main(["exclude", "pair", "src/a.ts:nothing", "src/b.ts:sumAll"]) == 1 and "nothing" in capsys.readouterr().err
    with pytest.raises(ValueError, match="two files"):
        commands.exclude_file_group(index, ["one.ts"])


def test_tool_server(spark, project):
    root, _ = project
    server = Server(spark, str(root))
    ask = lambda method, params=None, ident=1: server.answer({"jsonrpc": "2.0", "id": ident, "method": method, "params": params})
    tool = lambda name, **arguments: ask("tools/call", {"name": name, "arguments": arguments})["result"]
    assert len(ask("tools/list")["result"]["tools"]) == 9 and ask("initialize")["result"]["serverInfo"]["name"] == "twinsift"
    assert ask("nothing")["error"]["code"] == -32603 and server.answer({"id": 1, "method": "ping"})["error"]["code"] == -32600
    assert server.answer({"jsonrpc": "2.0", "method": "ping"}) is None
    assert tool("scan")["isError"] and tool("nothing")["isError"]
    assert json.loads(tool("index")["content"][0]["text"])["status"] == "started"
    server.runs.thread.join()
    status = json.loads(tool("status")["content"][0]["text"])
    assert status["indexing"]["state"] == "done" and status["totalFunctions"] == 3
    assert json.loads(tool("index_stop")["content"][0]["text"])["status"] == "not running"
    found = json.loads(tool("query", file="src/a.ts", threshold=0.9, topK=3, queryPrefix="", maxInputBytes=9000)["content"][0]["text"])
    assert found["functions"][0]["candidates"]
    for name, arguments in (("add_exclusion", {"queryPath": "src/a.ts", "queryFunction": "addAll", "querySignatureHash": "x", "candidatePath": "src/b.ts", "candidateFunction": "sumAll", "candidateSignatureHash": "y", "reason": "r"}), ("add_file_exclusion", {"pattern": "x/", "reason": "r"}), ("add_file_pair_exclusion", {"fileA": "a", "fileB": "b", "reason": "r"}), ("add_file_group_exclusion", {"files": ["a", "b", "c"], "reason": "r"})):
        assert "isError" not in tool(name, **arguments), name
    out = io.StringIO()
    server.serve(["not json\n", '{"jsonrpc": "2.0", "id": 7, "method": "ping"}\n', '{"jsonrpc": "2.0", "method": "ping"}\n'], out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 7, "result": {}}


def test_snapshots_and_vectors(spark, project):
    """Steps append vectors, the run ends with one table, and a reader's snapshot outlives the next one."""
    root, _ = project
    index = Index(spark, str(root))
    steps = []
    index_module.STEP, kept = 2, index_module.STEP
    try:
        index.run(embedding.HashingEmbedder(), progress=lambda done, left: steps.append((done, index.store.current, index.store.folder.exists(f"{index.store.current}/vectors"), index.embedded().count())))
    finally:
        index_module.STEP = kept
    assert [s[0] for s in steps] == [2, 3] and len({s[1] for s in steps}) == 1 and all(s[2] for s in steps) and [s[3] for s in steps] == [2, 3]
    assert not index.store.folder.exists(f"{index.store.current}/vectors") and index.embedded().count() == 3
    reader = index.chunks()
    first = {r["file_path"]: r["indexed_at"] for r in index.tracked().collect()}
    (root / "src/c.py").write_text("def greet(name):\n    message = 'bye ' + name\n    return message\n")
    stopped = index.run(embedding.HashingEmbedder(), cancelled=lambda: True)
    assert stopped.status == "cancelled" and reader.count() == 3
    second = {r["file_path"]: r["indexed_at"] for r in index.tracked().collect()}
    assert first["src/a.ts"] == second["src/a.ts"] and first["src/c.py"] < second["src/c.py"] and all(first.values())
    assert index.run(embedding.HashingEmbedder()).embedded == 1
    assert len([n for n in index.store.folder.names() if n.startswith("snapshot-")]) == 2
    assert {r["function_name"] for r in index.with_signature(index.chunks().first()["signature_hash"]).collect()}
    index.store.write({"chunks": index.chunks(), "files": index.tracked()}, {"schema_version": 99})
    with pytest.raises(IndexStateError, match="99"):
        index.store.meta()


def test_cache_of_other_settings(spark, project):
    root, _ = project
    index = Index(spark, str(root))
    index.run(embedding.HashingEmbedder())
    with pytest.raises(IndexStateError, match="cache"):
        index.run(embedding.HashingEmbedder(max_bytes=99))
    assert index.run(embedding.HashingEmbedder(max_bytes=99), force=True).embedded == 3


def test_query_prefix_and_tier(monkeypatch):
    assert embedding.query_prefix(None, "nomic-embed-text:v1") == "search_query: " and embedding.query_prefix(None, "other") == "" and embedding.query_prefix("q ", "nomic-embed-text") == "q "
    monkeypatch.setenv("TWINSIFT_QUERY_PREFIX", "env ")
    assert embedding.query_prefix(None, "nomic-embed-text") == "env "
    service = embedding.ServiceEmbedder("m:13b", "http://127.0.0.1:9", max_bytes=3, query_prefix="q: ")
    assert service.tier == "13b" and embedding.ServiceEmbedder("m").tier == "7b" and not service.healthy() and embedding.as_query(service, "abcd") == "q: abc"


def test_option_like_revisions(spark, project):
    root, _ = project
    for name in ("--output=x", "-p"):
        with pytest.raises(repository.GitError):
            repository.diff_commit(spark, str(root), name)
        assert repository.file_at(str(root), name, "src/a.ts") is None
    assert not (root / "x").exists()


def test_model_choice():
    assert embedding.choose_model("x", ["y"]) == "x" and embedding.choose_model(None, [], "z") == "z"
    assert embedding.choose_model(None, ["nomic-embed-text:latest", "nomic-embed-code:7b"]) == "nomic-embed-code:7b"
    with pytest.raises(embedding.EmbedderError):
        embedding.choose_model(None, ["other"])
    with pytest.raises(embedding.EmbedderError):
        embedding.ServiceEmbedder("m", "http://127.0.0.1:9").embed(["x"])
    assert embedding.cut("aéb", 2) == "a"
