"""Resolution, edges and walks over the derived code corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import graph
from ..registry import query
from ..sources import corpus
from ..storage import checkpoint

CALLS = """
local AS (SELECT * FROM (SELECT c.path, c.src_id, c.call_ord, c.key, s.symbol_id AS dst_id, row_number() OVER (PARTITION BY c.src_id, c.call_ord ORDER BY s.sym_ord) AS r
  FROM sites c JOIN ids s ON s.path = c.path AND (s.name = c.key OR s.qualified_name = c.key OR ends_with(s.qualified_name, concat('.', c.key)))) WHERE r = 1),
imported AS (SELECT * FROM (SELECT c.path, c.src_id, c.call_ord, c.key, s.symbol_id AS dst_id, row_number() OVER (PARTITION BY c.src_id, c.call_ord ORDER BY i.imp_ord, s.sym_ord) AS r
  FROM sites c JOIN resolved i ON i.path = c.path JOIN ids s ON s.path = i.resolved_path AND (s.name = c.key OR s.qualified_name = c.key OR ends_with(s.qualified_name, concat('.', c.key)))) WHERE r = 1),
global AS (SELECT * FROM (SELECT c.path, c.src_id, c.call_ord, c.key, s.symbol_id AS dst_id, row_number() OVER (PARTITION BY c.src_id, c.call_ord ORDER BY s.file_ord, s.sym_ord) AS r FROM sites c JOIN ids s ON s.qualified_name = c.key) WHERE r = 1),
edges AS (SELECT DISTINCT src_id, dst_id FROM (SELECT src_id, dst_id FROM local UNION ALL SELECT src_id, dst_id FROM imported i WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.src_id = i.src_id AND l.call_ord = i.call_ord))),
exact AS (SELECT * FROM (SELECT c.path, c.src_id, c.call_ord, s.symbol_id AS dst_id, row_number() OVER (PARTITION BY c.src_id, c.call_ord ORDER BY s.sym_ord) AS r FROM sites c JOIN ids s ON s.path = c.path AND (s.name = c.key OR s.qualified_name = c.key)) WHERE r = 1),
named AS (SELECT c.path, c.src_id, COALESCE(l.dst_id, g.dst_id) AS dst_id FROM sites c LEFT JOIN exact l ON l.src_id = c.src_id AND l.call_ord = c.call_ord LEFT JOIN global g ON g.src_id = c.src_id AND g.call_ord = c.call_ord WHERE COALESCE(l.dst_id, g.dst_id) IS NOT NULL),
typed AS (SELECT DISTINCT src_id, type, dst_id FROM (SELECT src_id, 'calls' AS type, dst_id FROM named WHERE src_id <> dst_id UNION ALL SELECT src_id, 'tests', dst_id FROM named WHERE contains(path, 'test_')
  UNION ALL SELECT a.symbol_id, 'inherits', b.symbol_id FROM ids a JOIN ids b ON b.qualified_name = a.extends[1]))
"""
WITH = f"WITH {corpus.EXPECTED_SQL}, {CALLS}"


def parsed(spark, sf_dir):
    """The corpus's symbols, written once: every step below reads them several times, and parsing is the costly part."""
    return checkpoint(corpus.symbols(spark, sf_dir))


def parts(spark, sf_dir):
    """Symbols and resolved imports, each written once."""
    i = graph.resolve_imports(corpus.imports(spark, sf_dir), corpus.files(spark, sf_dir).select("repo_id", "path"))
    return parsed(spark, sf_dir), checkpoint(i)


@query("resolve_imports", f"{WITH} SELECT path, imp_ord, specifier, resolved_path, CASE WHEN resolved_path IS NULL THEN 0.4 ELSE 0.95 END::DOUBLE AS confidence FROM resolved")
def resolve_imports(spark, sf_dir):
    return parts(spark, sf_dir)[1].select("path", "imp_ord", "specifier", "resolved_path", "confidence")


def _resolved(found):
    return found.select("path", "src_id", F.col("call_ord").cast("long").alias("call_ord"), "key", "dst_id")


@query("resolve_calls_local", f"{WITH} SELECT path, src_id, call_ord, key, dst_id FROM local")
def resolve_calls_local(spark, sf_dir):
    s = parsed(spark, sf_dir)
    return _resolved(graph.resolve_local(graph.call_sites(s), s))


@query("resolve_calls_imported", f"{WITH} SELECT path, src_id, call_ord, key, dst_id FROM imported")
def resolve_calls_imported(spark, sf_dir):
    s, i = parts(spark, sf_dir)
    return _resolved(graph.resolve_imported(graph.call_sites(s), s, i))


@query("resolve_calls_global", f"{WITH} SELECT path, src_id, call_ord, key, dst_id FROM global")
def resolve_calls_global(spark, sf_dir):
    s = parsed(spark, sf_dir)
    return _resolved(graph.resolve_global(graph.call_sites(s), s))


@query("call_edges", f"{WITH} SELECT src_id, dst_id FROM edges")
def call_edges(spark, sf_dir):
    return graph.call_edges(*parts(spark, sf_dir)).select("src_id", "dst_id")


@query("typed_edges", f"{WITH} SELECT src_id, type, dst_id FROM typed")
def typed_edges(spark, sf_dir):
    return graph.typed_edges(parsed(spark, sf_dir)).select("src_id", "type", "dst_id")


@query("reverse_edges", f"{WITH} SELECT src_id, dst_id, 'callee' AS direction FROM edges UNION ALL SELECT dst_id, src_id, 'caller' FROM edges")
def reverse_edges(spark, sf_dir):
    return graph.with_reverse(graph.call_edges(*parts(spark, sf_dir))).select("src_id", "dst_id", "direction")


@query("tests_theta", f"{WITH} SELECT s.symbol_id AS src_id, t.path AS test_path, t.qualified_name AS test_symbol FROM ids t JOIN ids s ON contains(lower(t.name), lower(s.name)) WHERE contains(t.path, 'test_')")
def tests_theta(spark, sf_dir):
    return graph.test_links(parsed(spark, sf_dir)).select("src_id", "test_path", "test_symbol")


@query("tests_calls", f"{WITH} SELECT src_id, dst_id FROM typed WHERE type = 'tests'")
def tests_calls(spark, sf_dir):
    return graph.typed_edges(parsed(spark, sf_dir)).filter("type = 'tests'").select("src_id", "dst_id")


@query("symbol_tests", f"{WITH} SELECT s.qualified_name, t.qualified_name AS test_symbol, t.path AS file FROM typed e JOIN ids s ON s.symbol_id = e.dst_id JOIN ids t ON t.symbol_id = e.src_id WHERE e.type = 'tests'")
def symbol_tests(spark, sf_dir):
    s = parsed(spark, sf_dir)
    e = graph.typed_edges(s).filter("type = 'tests'")
    named = e.join(s.select(F.col("symbol_id").alias("dst_id"), "qualified_name"), "dst_id").select("qualified_name", F.col("src_id").alias("id"))
    return graph.reference(named, s).select("qualified_name", F.col("name").alias("test_symbol"), "file")


@query("project_scan_stats", f"{WITH} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT symbol_id) FROM ids) AS symbols, CAST(0 AS BIGINT) AS diagnostics, (SELECT count(*) FROM edges) AS edges")
def project_scan_stats(spark, sf_dir):
    s, i = parts(spark, sf_dir)
    counts = [
        corpus.files(spark, sf_dir).agg(F.lit("repo").alias("repo_id"), F.count("*").alias("files")),
        s.agg(F.lit("repo").alias("repo_id"), F.count_distinct("symbol_id").alias("symbols"), F.count("error").alias("diagnostics")),
        graph.call_edges(s, i).agg(F.lit("repo").alias("repo_id"), F.count("*").alias("edges")),
    ]
    return reduce(lambda a, b: a.join(b, "repo_id"), counts).drop("repo_id")


_WANTED = "w AS (SELECT path, name AS symbol FROM ids)"


def wanted(s):
    """Every symbol, by path and name."""
    return s.select("path", F.col("name").alias("symbol")).distinct()


def _around(side, a, b):
    return f"""{WITH}, {_WANTED} SELECT w.path, w.symbol, t.symbol_id AS id, t.qualified_name AS name, t.path AS file, t.kind FROM w JOIN ids s ON s.path = w.path AND s.name = w.symbol JOIN edges e ON e.{a} = s.symbol_id JOIN ids t ON t.symbol_id = e.{b}"""


@query("callers", _around("callers", "dst_id", "src_id"))
def callers(spark, sf_dir):
    s, i = parts(spark, sf_dir)
    return graph.neighbours(graph.call_edges(s, i), s, wanted(s), "callers").select("path", "symbol", "id", "name", "file", "kind")


@query("callees", _around("callees", "src_id", "dst_id"))
def callees(spark, sf_dir):
    s, i = parts(spark, sf_dir)
    return graph.neighbours(graph.call_edges(s, i), s, wanted(s), "callees").select("path", "symbol", "id", "name", "file", "kind")


@query(
    "symbol_context",
    f"""{WITH}, {_WANTED}, b AS (SELECT w.path, w.symbol, s.symbol_id FROM w JOIN ids s ON s.path = w.path AND s.name = w.symbol)
      SELECT path, symbol, 'callers' AS what, e.src_id AS id FROM b JOIN edges e ON e.dst_id = b.symbol_id UNION ALL SELECT path, symbol, 'callees', e.dst_id FROM b JOIN edges e ON e.src_id = b.symbol_id
      UNION ALL SELECT b.path, b.symbol, 'tests', t.symbol_id FROM b JOIN ids x ON x.symbol_id = b.symbol_id JOIN ids t ON contains(lower(t.name), lower(x.name)) WHERE contains(t.path, 'test_')""",
)
def symbol_context(spark, sf_dir):
    s, i = parts(spark, sf_dir)
    e, w = graph.call_edges(s, i), wanted(s)
    both = [graph.neighbours(e, s, w, side).select("path", "symbol", F.lit(side).alias("what"), "id") for side in ("callers", "callees")]
    links = graph.test_links(s)
    ids = s.select(F.col("symbol_id").alias("src_id"), "path", F.col("name").alias("symbol")).join(w, ["path", "symbol"])
    tests = links.join(ids, "src_id").join(s.select(F.col("path").alias("test_path"), F.col("qualified_name").alias("test_symbol"), F.col("symbol_id").alias("id")), ["test_path", "test_symbol"])
    return both[0].unionByName(both[1]).unionByName(tests.select("path", "symbol", F.lit("tests").alias("what"), "id"))


@query("edge_query", f"{WITH} SELECT s.path, s.qualified_name, e.type, e.dst_id AS id, t.qualified_name AS name FROM typed e JOIN ids s ON s.symbol_id = e.src_id JOIN ids t ON t.symbol_id = e.dst_id WHERE e.type = 'inherits'")
def edge_query(spark, sf_dir):
    s = parsed(spark, sf_dir)
    e = graph.typed_edges(s).filter("type = 'inherits'").join(s.select(F.col("symbol_id").alias("src_id"), "path", "qualified_name"), "src_id")
    return graph.reference(e.select("path", "qualified_name", "type", F.col("dst_id").alias("id")), s).select("path", "qualified_name", "type", "id", "name")


@query(
    "edge_degree",
    f"""{WITH} SELECT symbol_id, CAST((SELECT count(*) FROM typed e WHERE e.type = 'calls' AND e.src_id = s.symbol_id) AS BIGINT) AS callees, CAST((SELECT count(*) FROM typed e WHERE e.type = 'calls' AND e.dst_id = s.symbol_id) AS BIGINT) AS callers,
      CAST((SELECT count(*) FROM typed e WHERE e.type = 'inherits' AND e.dst_id = s.symbol_id) AS BIGINT) AS inheritors FROM ids s""",
)
def edge_degree(spark, sf_dir):
    s = parsed(spark, sf_dir)
    return graph.degrees(graph.typed_edges(s), s)


@query("focus_files", f"{WITH} SELECT path FROM files WHERE path LIKE 'src/3/%' OR path = 'src/4/f4.js' ORDER BY file_ord LIMIT 50")
def focus_files(spark, sf_dir):
    return graph.focus_files(corpus.files(spark, sf_dir), ["src/3/", "src/4/f4.js"]).select("path")




def _walk(links):
    return f"""WITH RECURSIVE {corpus.EXPECTED_SQL}, {CALLS}, start AS (SELECT path FROM files WHERE path LIKE 'src/5/f5.js' OR path LIKE 'src/6/%' ORDER BY file_ord LIMIT 5), links AS ({links}),
      walk AS (SELECT path AS node, 0 AS depth FROM start UNION ALL SELECT l.dst, w.depth + 1 FROM walk w JOIN links l ON l.src = w.node WHERE w.depth < 3),
      least AS (SELECT node AS path, min(depth) AS depth FROM walk GROUP BY node)
      SELECT s.path, l.depth, s.symbol_id, s.qualified_name, s.kind, CAST((SELECT count(*) FROM edges e WHERE e.src_id = s.symbol_id) AS BIGINT) AS callees FROM ids s JOIN least l ON l.path = s.path"""


def _slice(spark, sf_dir, by_calls):
    s, i = parts(spark, sf_dir)
    e = graph.call_edges(s, i)
    start = graph.focus_files(corpus.files(spark, sf_dir), ["src/5/f5.js", "src/6"], 5).select(F.col("path").alias("node"))
    links = graph.call_links(e, s) if by_calls else graph.import_links(i)
    return graph.context_slice(start, links, e, s, 3).select("path", "depth", "symbol_id", "qualified_name", "kind", "callees")


@query("slice_imports", _walk("SELECT DISTINCT path AS src, resolved_path AS dst FROM resolved WHERE resolved_path IS NOT NULL"))
def slice_imports(spark, sf_dir):
    return _slice(spark, sf_dir, False)


@query("slice_calls", _walk("SELECT DISTINCT a.path AS src, b.path AS dst FROM edges e JOIN ids a ON a.symbol_id = e.src_id JOIN ids b ON b.symbol_id = e.dst_id"))
def slice_calls(spark, sf_dir):
    return _slice(spark, sf_dir, True)


@query(
    "project_map",
    f"""{WITH}, focus AS (SELECT path FROM files ORDER BY file_ord LIMIT 50), near AS (SELECT path FROM focus UNION SELECT r.resolved_path FROM resolved r JOIN focus f ON f.path = r.path WHERE r.resolved_path IS NOT NULL)
      SELECT s.symbol_id, s.qualified_name, s.path, s.kind, s.signature FROM ids s JOIN near n ON n.path = s.path""",
)
def project_map(spark, sf_dir):
    s, i = parts(spark, sf_dir)
    start = graph.focus_files(corpus.files(spark, sf_dir), ["src"]).select(F.col("path").alias("node"))
    near = graph.walk(start, graph.import_links(i), 1).select(F.col("node").alias("path"))
    return s.join(near, "path").select("symbol_id", "qualified_name", "path", "kind", "signature")


@query(
    "graph_distance",
    f"""{WITH}, pairs AS (SELECT a.symbol_id AS from_id, b.symbol_id AS to_id FROM ids a JOIN ids b ON b.file_ord IN (a.file_ord, a.file_ord + 40, a.file_ord + 80, a.file_ord + 20, a.file_ord + 2)),
      calls AS (SELECT DISTINCT src_id, dst_id FROM typed WHERE type = 'calls'), either AS (SELECT src_id, dst_id FROM calls UNION SELECT dst_id, src_id FROM calls),
      near AS (SELECT src_id, dst_id, 1 AS d FROM either UNION ALL SELECT dst_id, src_id, 2 FROM typed WHERE type = 'inherits' UNION ALL SELECT c.src_id, e.dst_id, 3 FROM calls c JOIN either e ON e.src_id = c.dst_id)
      SELECT from_id, to_id, CAST(CASE WHEN from_id = to_id THEN 0 ELSE COALESCE((SELECT min(d) FROM near n WHERE n.src_id = from_id AND n.dst_id = to_id), 5) END AS INTEGER) AS distance FROM pairs""",
)
def graph_distance(spark, sf_dir):
    s = parsed(spark, sf_dir)
    a = s.select(F.col("symbol_id").alias("from_id"), F.explode(F.array(*[F.col("file_ord") + F.lit(k) for k in (0, 40, 80, 20, 2)])).alias("file_ord"))
    pairs = a.join(s.select("file_ord", F.col("symbol_id").alias("to_id")), "file_ord").select("from_id", "to_id")
    return graph.distances(pairs, graph.typed_edges(s), s)


@query("slice_degrees", _walk("SELECT DISTINCT a.path AS src, b.path AS dst FROM edges e JOIN ids a ON a.symbol_id = e.src_id JOIN ids b ON b.symbol_id = e.dst_id").replace(
    "SELECT s.path, l.depth, s.symbol_id, s.qualified_name, s.kind, CAST((SELECT count(*) FROM edges e WHERE e.src_id = s.symbol_id) AS BIGINT) AS callees FROM",
    "SELECT s.symbol_id, l.depth, CAST((SELECT count(*) FROM typed e WHERE e.type = 'calls' AND e.src_id = s.symbol_id) AS BIGINT) AS callees, CAST((SELECT count(*) FROM typed e WHERE e.type = 'calls' AND e.dst_id = s.symbol_id) AS BIGINT) AS callers, CAST((SELECT count(*) FROM typed e WHERE e.type = 'inherits' AND e.dst_id = s.symbol_id) AS BIGINT) AS inheritors FROM"))
def slice_degrees(spark, sf_dir):
    """Symbols of a slice along calls, with callers and inheritors as well."""
    s, i = parts(spark, sf_dir)
    e = graph.call_edges(s, i)
    start = graph.focus_files(corpus.files(spark, sf_dir), ["src/5/f5.js", "src/6"], 5).select(F.col("path").alias("node"))
    part = graph.context_slice(start, graph.call_links(e, s), e, s, 3)
    return graph.with_degrees(part, graph.typed_edges(s)).select("symbol_id", "depth", "callees", "callers", "inheritors")


@query("callee_names", f"{WITH}, c AS (SELECT DISTINCT src_id, dst_id FROM edges), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src_id ORDER BY dst_id) AS INTEGER) AS ord FROM c) SELECT r.src_id AS symbol_id, r.ord, r.dst_id AS id, t.qualified_name AS name, t.path AS file FROM r JOIN ids t ON t.symbol_id = r.dst_id WHERE r.ord <= 20")
def callee_names(spark, sf_dir):
    s, i = parts(spark, sf_dir)
    return graph.callee_names(graph.call_edges(s, i), s).select("symbol_id", "ord", "id", "name", "file")


@query("symbols_by_id", f"{WITH}, w AS (SELECT symbol_id AS id FROM ids UNION ALL SELECT concat(symbol_id, 'x') FROM ids) SELECT w.id, s.path, s.qualified_name, s.kind, s.start_line, s.end_line FROM w LEFT JOIN ids s ON s.symbol_id = w.id")
def symbols_by_id(spark, sf_dir):
    """Every id, and as many that no symbol has."""
    s = parsed(spark, sf_dir)
    ids = s.select(F.explode(F.array("symbol_id", F.concat("symbol_id", F.lit("x")))).alias("id"))
    return graph.by_id(ids, s).select("id", "path", "qualified_name", "kind", "start_line", "end_line")
