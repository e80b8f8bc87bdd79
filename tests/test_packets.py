import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import artifacts, loss, packet, patches, ranking
from tessera.storage import checkpoint
from tessera.streaming import incremental


def fold(rows, used, cap):
    out = []
    for ord_, id_, cost in sorted(rows):
        if used + cost <= cap:
            used += cost
            out.append(id_)
    return out


@pytest.mark.parametrize("chunk", [900, 7])
def test_first_fit_is_the_ordered_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(packet, "CHUNK", chunk)
    r = random.Random(chunk)
    rows = [(g, f"{g}-{i}", i, r.choice((1, 5, 9, 30, 200))) for g in ("a", "b", "hot") for i in range({"a": 5, "b": 60, "hot": 900}[g])]
    caps = {"a": (0, 13), "b": (10, 300), "hot": (0, 1500), "none": (5, 10)}
    got = packet.first_fit(spark.createDataFrame(rows, "g string, id string, ord int, cost long"), spark.createDataFrame([(g, u, c) for g, (u, c) in caps.items()], "g string, used long, cap long"), "g", checkpoint).collect()
    for g, (used, cap) in caps.items():
        mine = sorted((x["ord"], x["id"], x["used_after"]) for x in got if x["g"] == g)
        assert [i for _, i, _ in mine] == fold([(o, i, c) for h, i, o, c in rows if h == g], used, cap)
        assert all(u <= cap for _, _, u in mine)


def test_selected_and_omitted_are_all_candidates(spark):
    r = random.Random(1)
    cand = [("c", str(i), i, 10 + r.randint(0, 30), r.randint(1, 400), i % 2 == 0, i % 4, i == 8) for i in range(120)]
    c = spark.createDataFrame(cand, "context_id string, id string, ord int, contract_tokens long, body_tokens long, escalates boolean, risk int, is_target boolean")
    t = spark.createDataFrame([("c", 3000, "safe", 0.9, "bugfix", 20, 5, False)], "context_id string, budget long, mode string, quality_floor double, task_type string, project_tokens long, evidence_tokens long, has_tests boolean")
    out = packet.build(c, t, checkpoint)
    ids = {x["id"] for x in out["selected"].collect()}
    rest = {x["id"] for x in out["omitted"].collect()}
    assert ids | rest == {x[1] for x in cand} and not ids & rest and "8" in ids
    p = out["packets"].first()
    assert p["tokens"] <= 3000 + 5 and p["contracts"] == len(ids) and p["removed"] == len(rest) and "add_tests" in p["hints"]


def test_ranking_prefers_keywords_and_keeps_ties_in_order(spark):
    rows = [("a", "handle", "(x)", 2, 1, 0.9, 100, 0), ("b", "validate", "(x)", 2, 1, 0.9, 100, 1), ("c", "handle", "(x)", 2, 1, 0.9, 100, 2), ("d", "x", "()", 0, 0, None, 5000, 3)]
    c = spark.createDataFrame(rows, "id string, qualified_name string, signature string, callers int, callees int, confidence double, tokens long, input_ord int")
    out = ranking.ranked(ranking.scored(c.withColumn("g", F.lit(1)), ["validate"]), ["g"]).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["b", "a", "c", "d"] and out[-1]["exclude_reason"] == "TOKEN_BUDGET"


def test_handles_and_aliases(spark):
    reg = spark.createDataFrame([("s", "1", "A.f", 0), ("s", "2", "B.f", 1), ("s", "1", "A.f", 2), ("s", "3", "C.f", 3), ("s", "4", "g", 4)], "session string, symbol_id string, qualified_name string, ord int")
    h = ranking.session_handles(reg)
    assert {r["symbol_id"]: r["handle"] for r in h.collect()} == {"1": "@f", "2": "@S1", "3": "@S2", "4": "@g"}
    assert ranking.alias_map(h, F.lit("a.js")).first()["aliases"]["@f"] == "a.js#A.f"


def test_loss_manifest(spark):
    m = spark.createDataFrame([("m", 10, 20, False, False), ("n", 0, 20, True, True)], "manifest_id string, token_budget long, packet_tokens long, target_covered boolean, entrypoints_covered boolean")
    calls = loss.unresolved_calls(spark.createDataFrame([("m", "a", "b")], "manifest_id string, caller string, target string"))
    low = loss.low_confidence(spark.createDataFrame([("m", "x", "effects", 0.4), ("m", "y", "effects", 0.9)], "manifest_id string, symbol_id string, field string, confidence double"))
    out = {r["manifest_id"]: r for r in loss.finalized(m, calls.unionByName(low)).collect()}
    assert out["m"]["risk"] == "critical" and out["m"]["budget_exceeded"] and out["m"]["expansion_hint"] == "requires_expansion: target symbols not covered, 1 unresolved. Use context.expand."
    assert out["n"]["risk"] == "low" and not out["n"]["budget_exceeded"] and out["n"]["expansion_hint"] == "" and low.count() == 1
    assert len(loss.REASONS) == 14


def test_artifacts(spark, tmp_path):
    big = "x" * 150_000
    puts = spark.createDataFrame([(0, "one", "a", 0, True, ["t"]), (1, "one", "b", 9, False, []), (2, big, "a", 1, False, []), (3, "", "a", 0, False, [])], "put_ord int, content string, mime string, ttl long, pinned boolean, tags array<string>").withColumn("created", F.timestamp_seconds(F.lit(1000) + F.col("put_ord")))
    a = artifacts.put(puts)
    rows = {r["put_ord"]: r for r in a.collect()}
    assert set(rows) == {0, 2, 3} and rows[0]["refs"] == 2 and rows[0]["mime"] == "a" and rows[2]["chunk_count"] == 3 and rows[3]["chunk_count"] == 1
    assert sorted(len(r["data"]) for r in artifacts.chunks(a).collect()) == [0, 3, 150_000 - 2 * 65536, 65536, 65536]
    assert "[truncated, 50000 more bytes]" in artifacts.copy_text(a).filter(F.col("artifact_id") == rows[2]["artifact_id"]).first()["copy"]
    left, gone = artifacts.collect_garbage(a, F.timestamp_seconds(F.lit(2000)))
    assert [r["artifact_id"] for r in gone.collect()] == [rows[2]["artifact_id"]] and left.count() == 2
    kept, outcome = artifacts.delete(a, a.select("artifact_id").union(spark.sql("select 'nope'")))
    assert sorted(r["outcome"][:7] for r in outcome.collect()) == ["Cannot ", "deleted", "deleted", "unknown"] and kept.count() == 1
    artifacts.write(a, f"{tmp_path}/store")
    artifacts.write(a.withColumn("put_ord", F.col("put_ord") + 100).withColumn("pinned", F.lit(True)), f"{tmp_path}/store")
    back = artifacts.read(spark, f"{tmp_path}/store")
    assert back.count() == a.count() and back.filter("pinned").count() == a.count() and spark.read.parquet(f"{tmp_path}/store/blobs").count() == a.count()
    again = back.withColumn("put_ord", F.col("put_ord") + 10).drop("refs", "size", "chunk_count", "artifact_id", "hash_prefix", "log_ord")
    assert artifacts.put(again.union(again)).count() == 3
    bad = a.withColumn("content", F.lit(b"tampered"))
    with pytest.raises(Exception, match="Integrity check failed"):
        artifacts.get(bad, a.select("artifact_id")).collect()


def test_splices(spark):
    files = spark.createDataFrame([("p", "a\nb\nc\n"), ("q", "a\nb")], "patch_id string, code string")
    edits = spark.createDataFrame(
        [("p", 0, "replace_symbol", 1, 2, "X"), ("p", 1, "insert_after", None, 3, "Y"), ("p", 2, "insert_before", 3, None, "Z"), ("q", 0, "replace_symbol", None, 1, "X")], "patch_id string, ord int, operation string, start_line int, end_line int, code string"
    )
    out = {r["patch_id"]: r for r in patches.applied(files, edits).collect()}
    assert out["p"]["code_after"] == "X\nZ\nY\nc\n" or out["p"]["code_after"] == "X\nZ\nc\nY\n"
    assert out["p"]["ok"] and not out["q"]["ok"] and out["q"]["code_after"] == "a\nb"


def test_write_file(tmp_path):
    path = tmp_path / "f.js"
    path.write_text("old")
    path.chmod(0o640)
    backup = patches.write_file(str(path), "p1", "new")
    assert path.read_text() == "new" and open(backup).read() == "old" and path.stat().st_mode & 0o777 == 0o640
    with pytest.raises(ValueError):
        patches.write_file(str(path), "../p", "new")


def test_watcher_follows_edits_news_and_deletes(spark, tmp_path):
    w = incremental.Watcher(spark, f"{tmp_path}/index")
    schema = "path string, mtime_ms long, code string"
    listings = [[("a", 1000, "1"), ("b", 1000, "1"), ("d", 1000, "1")], [("a", 1400, "2"), ("b", 2000, "2"), ("c", 5, "1")], [("b", 2000, "2"), ("c", 5, "1")]]
    want = [{"a": "added", "b": "added", "d": "added"}, {"a": "same", "b": "modified", "c": "added", "d": "deleted"}, {"a": "deleted", "b": "same", "c": "same"}]
    for rows, expected in zip(listings, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        w.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", once=True).awaitTermination()
        assert {r["path"]: r["change"] for r in w.state().collect()} == expected
    w.apply(spark.createDataFrame(listings[2], schema), 2)  # the same batch again
    assert {r["path"]: r["change"] for r in w.state().collect()} == want[2] and w.versions() == [0, 1, 2]
    w.stop()
