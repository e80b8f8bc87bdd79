import os

import pytest

from tessera.sources import tree


@pytest.fixture
def project(tmp_path):
    files = {
        "src/index.js": "import { helper } from './utils.js';\nexport function main() {\n  helper();\n  local();\n}\nfunction local() {\n}\n",
        "src/utils.js": "export function helper() {\n  return 1;\n}\n",
        "test/test_main.js": "function test_main() {\n  main();\n}\n",
        "node_modules/x/index.js": "function no() {}\n",
        "build/out.js": "function no() {}\n",
        "README.md": "# hi\n",
        "package.json": "{}",
        "notes.txt": "no",
        "bin/tool.py": "def run():\n    return 1\n",
        ".hidden/a.py": "def hidden():\n    pass\n",
    }
    for name, text in files.items():
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    os.symlink(tmp_path / "p" / "src", tmp_path / "p" / "linked")
    return str(tmp_path / "p")


def test_listing_prunes(project):
    paths = lambda *a, **k: [x[0] for x in tree.list_tree(project, *a, **k)]
    assert paths() == [".hidden/a.py", "bin/tool.py", "src/index.js", "src/utils.js", "test/test_main.js"]
    assert paths("all") == [".hidden/a.py", "README.md", "bin/tool.py", "package.json", "src/index.js", "src/utils.js", "test/test_main.js"]
    assert paths("bench", limit=2) == ["bin/tool.py", "src/index.js"]
    assert "node_modules/x/index.js" in paths(exclude=["src"]) and "src/index.js" not in paths(exclude=["src"])
    assert tree.list_tree("/nowhere/at/all") == []


def test_data_source(spark, project):
    got = tree.read_tree(spark, project, repo_id="r", partitions=3)
    rows = got.collect()
    assert sorted(r["path"] for r in rows) == [".hidden/a.py", "bin/tool.py", "src/index.js", "src/utils.js", "test/test_main.js"]
    assert all(r["repo_id"] == "r" and r["size"] == len(r["code"]) for r in rows)


def test_scan_project(spark, project):
    p = tree.scan_project(spark, project, "r")
    names = {r["symbol_id"]: r["qualified_name"] for r in p["symbols"].collect()}
    edges = {(names[r["src_id"]], names[r["dst_id"]]) for r in p["edges"].collect()}
    # A Python body starts with its own header, which counts as a call of itself.
    assert edges == {("main", "helper"), ("main", "local"), ("run", "run"), ("hidden", "hidden")}
    typed = {(names[r["src_id"]], r["type"], names[r["dst_id"]]) for r in p["typed_edges"].collect()}
    assert ("test_main", "tests", "main") in typed and ("main", "calls", "helper") in typed
    assert p["files"].filter("is_entrypoint").count() == 2 and p["files"].filter("is_test").count() == 1
