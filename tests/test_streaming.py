import json

from twinsift.embedding import HashingEmbedder
from twinsift.index import Store
from twinsift.schema import STORED
from twinsift.streaming.ingest import VERSIONS, follow

SOURCE = "def {}(a):\n    b = a\n    return b\n"


def test_follow(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def put(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("file_path", "source", "mtime_ms"), row, strict=True))) for row in rows))
        query = follow(spark.readStream.schema(VERSIONS).json(str(inbox)), str(tmp_path / "index"), HashingEmbedder(), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        found = Store(spark, str(tmp_path / "index")).read("chunks", STORED)
        assert found.where("embedding is null").count() == 0
        return sorted(row["id"] for row in found.collect())

    assert put("1.json", ("a.py", SOURCE.format("old"), 1), ("a.py", SOURCE.format("new"), 2), ("b.py", SOURCE.format("g"), 1)) == ["a.py:new:1", "b.py:g:1"]
    assert put("2.json", ("b.py", None, 3), ("c.py", SOURCE.format("h"), 3)) == ["a.py:new:1", "c.py:h:1"]
