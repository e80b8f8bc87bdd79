"""How edges are joined."""

from tessera.operators import graph

SYMBOLS = "repo_id string, path string, file_ord long, sym_ord int, symbol_id string, name string, qualified_name string, calls array<string>, extends array<string>, implements array<string>"


def test_named_joins_never_broadcast(spark, tmp_path):
    """Tables that look small by their estimate, as names before they are exploded do, stay off the driver."""
    rows = [("r", f"p{i}", i, 0, f"s{i}", f"K{i}", f"K{i}", ["run"], [f"K{i + 1}"], ["I"]) for i in range(20)]
    spark.createDataFrame(rows, SYMBOLS).write.parquet(str(tmp_path / "symbols"))
    found = graph.typed_edges(spark.read.parquet(str(tmp_path / "symbols")))
    assert found._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 0
    assert {(r["src_id"], r["type"], r["dst_id"]) for r in found.collect()} == {(f"s{i}", "inherits", f"s{i + 1}") for i in range(19)}
