import json

from tessera import tools
from tessera.api import Workspace


def test_list(spark):
    rows = {r["name"]: r for r in tools.listed(spark).collect()}
    assert len(rows) == 25
    assert {n for n, r in rows.items() if r["destructive"]} == {"artifact.delete", "artifact.gc", "patch.apply"}
    assert sum(not r["read_only"] for r in rows.values()) == 13
    assert rows["symbol.source"]["required"] == ["repository_id", "file_path", "symbol"]


def test_dispatch_and_replies(spark, tmp_path):
    (tmp_path / "a.js").write_text("function one(x) {\n  return two(x);\n}\n")
    work = Workspace(spark, [str(tmp_path)])
    text = lambda reply: reply["content"][0]["text"]
    assert text(tools.call(work, "no.such")) == "Unknown: no.such"
    assert "required" in text(tools.call(work, "file.contracts", {"repository_id": "r"}))
    assert "unknown argument" in text(tools.call(work, "artifact.stats", {"x": 1}))
    missing = tools.call(work, "file.contracts", {"repository_id": "r", "file_path": "a.js"})
    assert missing["isError"] and "NO_INDEX" in text(missing)
    done = tools.call(work, "project.scan", {"repository_id": "r", "path": str(tmp_path)})
    assert not done["isError"] and json.loads(text(done))["rows"][0]["files"] == 1
    rows = json.loads(text(tools.call(work, "file.contracts", {"repository_id": "r", "file_path": "a.js"})))["rows"]
    assert rows[0]["handle"] == "@one" and rows[0]["calls"] == ["two"]
    put = json.loads(text(tools.call(work, "artifact.put", {"content": "kept"})))
    assert json.loads(text(tools.call(work, "artifact.get", {"artifact_id": put}))) == "kept"
