import time

import pytest

from tessera.api import Rejected, Workspace

MAIN = """import { helper } from './utils.js';
export function validate(x) {
  if (!x) throw new RangeError('no');
  db.save(x);
  return helper(x);
}
class Store {
  async load(id) {
    return await db.get(id);
  }
}
function tiny(a) {
  return a;
}
"""


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    for name, text in {"src/main.js": MAIN, "src/utils.js": "export function helper(y) {\n  return y;\n}\n", "src/test_main.js": "function test_validate() {\n  validate(1);\n}\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture
def work(spark, project):
    w = Workspace(spark, [str(project.parent)])
    w.project_scan("r", str(project))
    return w


def test_guards(spark, project, work):
    with pytest.raises(Rejected, match="NO_ALLOWED_ROOT"):
        Workspace(spark, []).project_scan("r", str(project))
    with pytest.raises(Rejected, match="REPOSITORY_ID_REQUIRED"):
        work.project_scan(" ", str(project))
    with pytest.raises(Rejected, match="PATH_OUTSIDE_ROOT"):
        work.project_scan("q", "/")
    with pytest.raises(Rejected, match="REPOSITORY_ROOT_MISMATCH"):
        work.project_scan("r", str(project / "src"))
    with pytest.raises(Rejected, match="NO_INDEX"):
        work.file_contracts("other", "src/main.js")
    with pytest.raises(Rejected, match="OUTSIDE"):
        work.file_contracts("r", "../../etc/passwd")
    with pytest.raises(Rejected, match="CONTEXT_NOT_FOUND"):
        work.context_inspect("ctx_x")


def test_scan_symbols_and_neighbours(work):
    s = work.project_stats("r").first()
    assert (s["files"], s["symbols"], s["diagnostics"]) == (3, 6, 0)
    handles = {r["handle"]: r for r in work.file_contracts("r", "src/main.js").collect()}
    assert set(handles) == {"@validate", "@Store", "@Store.load", "@tiny"} and handles["@validate"]["throws"] == ["RangeError"]
    assert work.symbol_source("r", "src/main.js", "tiny").first()["body"].startswith("function tiny")
    assert work.symbol_source("r", "src/main.js", "load", "reference").first()["body"] is None
    c = work.symbol_context("r", "src/main.js", "validate", ["callers", "callees", "tests", "sideEffects"])
    assert [r["name"] for r in c["callees"].collect()] == ["helper"] and [r["test_symbol"] for r in c["tests"].collect()] == ["test_validate"]
    assert [r["effect"] for r in c["sideEffects"].collect()] == ["database-write"]
    assert work.project_map("r")["symbols"].count() == 6


def test_context_expand_and_patch(work, project):
    cid = work.context_create("r", {"target": "validate", "taskType": "bugfix"}, "src/main.js", token_budget=420, evidence={"tests": "test_validate fails"})
    assert cid == work.context_create("r", {"target": "validate", "taskType": "bugfix"}, "src/main.js", token_budget=420, evidence={"tests": "test_validate fails"})
    before = work.context_inspect(cid)
    t = work.context_tables(cid)
    assert before["contracts"] + before["removed"] == 4 and before["removed"] > 0 and t["omitted"].count() == before["removed"]
    assert {r["kind"] for r in t["coverage"].collect()} == {"exact_source", "contract", "test"} and t["tests"].count() == 1
    out = work.context_expand(cid, [{"symbol": "tiny", "view": "source"}, {"symbol": "nope"}, {"symbol": "helper", "filePath": "src/utils.js", "view": "source"}]).collect()
    assert [r["status"] for r in out] == ["loaded", "not_found", "loaded"] and sum(r["tokens"] for r in out) > 0
    after = work.context_inspect(cid)
    assert after["revision"] == 2 and after["sources"] > before["sources"] and after["contracts"] >= before["contracts"] + 1
    for edits, code in (([{"operation": "replace_symbol", "symbol": "@nope", "code": ""}], "UNKNOWN_SYMBOL"), ([{"operation": "replace_symbol", "symbol": "@helper", "code": ""}], "CROSS_FILE_EDIT")):
        with pytest.raises(Rejected, match=code):
            work.patch_propose(cid, edits)
    pid = work.patch_propose(cid, [{"operation": "replace_symbol", "symbol": "@tiny", "code": "function tiny(a) {\n  return a + 1;\n}"}])
    assert work.patch_apply(pid)["reason"] == "Patch not validated"
    assert work.patch_validate(pid)["status"] == "inconclusive"
    assert work.patch_validate(pid, dict.fromkeys(("parse", "typecheck", "lint", "tests"), "passed"))["status"] == "valid"
    done = work.patch_apply(pid)
    assert done["status"] == "applied" and "a + 1" in (project / "src/main.js").read_text() and open(done["backup"]).read() == MAIN
    with pytest.raises(Rejected, match="STALE_FILE_SINCE_CONTEXT"):
        work.patch_validate(pid)


def test_refresh_and_watch(work, project):
    assert work.project_refresh("r").count() == 0
    time.sleep(0.6)
    (project / "src/utils.js").write_text("export function helper2(y) {\n}\nexport function more() {\n}\n")
    (project / "src/new.js").write_text("function fresh() {\n  helper2();\n}\n")
    (project / "src/test_main.js").unlink()
    rows = {r["path"]: (r["change"], r["added"], r["deleted"]) for r in work.project_refresh("r").collect()}
    assert rows == {"src/utils.js": ("modified", 2, 1), "src/new.js": ("added", 1, 0), "src/test_main.js": ("deleted", 0, 1)}
    assert work.project_stats("r").first()["symbols"] == 7 and work.project_changed_symbols("r").count() == 3
    query = work.project_watch_start("r", str(project), interval=200)
    (project / "src/late.js").write_text("function late() {\n}\n")
    for _ in range(100):
        if work.project_stats("r").first()["symbols"] == 8:
            break
        time.sleep(0.3)
    assert work.project_watch_status("r").first()["watching"]
    work.project_watch_stop("r")
    assert not query.isActive and work.project_stats("r").first()["symbols"] == 8


def test_artifacts(spark):
    w = Workspace(spark, [])
    assert w.artifact_get("0" * 64) is None
    a, b = w.artifact_put("one", tags=["t"], now="2024-01-01 00:00:00"), w.artifact_put(b"two" * 50_000, ttl=60, now="2024-01-01 00:00:00")
    assert w.artifact_put("one", pin=True) == a and w.artifact_get(a, as_text=True) == "one"
    assert w.store.filter("artifact_id = '%s'" % a).first()["refs"] == 2
    assert w.artifact_get_chunk(b, 2)["total_chunks"] == 3 and w.artifact_get_chunk(b, 3) is None
    assert "---CONTENT---\none\n---END" in w.artifact_copy_text(a) and w.artifact_copy_text("x") is None
    assert w.artifact_list(tag="t").count() == 1 and w.artifact_stats().first()["count"] == 2
    assert w.artifact_pin(a) and not w.artifact_pin("x")
    with pytest.raises(Rejected, match="pinned"):
        w.artifact_delete(a)
    assert w.artifact_gc("2024-01-01 00:00:30") == [] and w.artifact_gc("2024-01-01 01:00:00") == [b]
    w.artifact_pin(a, False)
    assert w.artifact_delete(a) == "deleted" and w.artifact_delete(a) == "unknown" and w.artifact_list().count() == 0
