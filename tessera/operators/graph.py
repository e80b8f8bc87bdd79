"""Imports, calls, tests and inheritance as edges, and bounded walks over them.

All lookups are equi-joins on derived keys with a first-match rule by ordinals. A name that
contains another is found by joining on the name's own substrings, not by comparing all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import checkpoint

FILE = ["repo_id", "path"]
MOST_CALLEES = 20  # fixed value: callees listed of a symbol


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with ``resolved_path`` (first of the candidate files that exists; null otherwise) and ``confidence``."""
    spec = F.concat(paths.folder(F.col("path")), F.lit("/"), F.col("specifier"))
    options = F.array(*[F.struct(F.lit(k).alias("k"), F.array_join(paths.resolved(F.concat(spec, F.lit(s))), "/").alias("target")) for k, s in enumerate(paths.IMPORT_SUFFIXES)])
    relative = imports.filter(F.col("specifier").startswith(".")).select(*FILE, "imp_ord", F.inline(options)).filter("target is not null")
    known = files.select("repo_id", F.col("path").alias("target"))
    first = relative.join(known, ["repo_id", "target"]).groupBy(*FILE, "imp_ord").agg(F.min_by("target", "k").alias("resolved_path"))
    out = imports.join(first, [*FILE, "imp_ord"], "left")
    return out.withColumn("confidence", F.when(F.col("resolved_path").isNotNull(), 0.95).otherwise(0.4))


def match_keys(symbols: DataFrame) -> DataFrame:
    """Each symbol under every name it answers to: its name, its qualified name and the dotted ends of that."""
    parts = F.split("qualified_name", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return symbols.select(*FILE, "file_ord", "sym_ord", "symbol_id", F.explode(F.array_distinct(F.concat(F.array("name"), ends))).alias("key"))


def call_sites(symbols: DataFrame) -> DataFrame:
    """One row a call of a symbol: repo_id, path, src_id, src_ord, call_ord, key."""
    return symbols.select(*FILE, F.col("symbol_id").alias("src_id"), F.col("sym_ord").alias("src_ord"), F.posexplode("calls").alias("call_ord", "key"))


SITE = [*FILE, "src_id", "src_ord", "call_ord", "key"]


def resolve_local(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of symbols in the same file: the first that answers to the name."""
    found = match_keys(symbols).groupBy(*FILE, "key").agg(F.min_by("symbol_id", "sym_ord").alias("dst_id"))
    return sites.join(found, [*FILE, "key"])


def resolve_imported(sites: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls of symbols in directly imported files: imports in order, then symbols in order.

    Names are matched against what the imported files hold before calls meet imports, so a file's calls and imports are never paired.
    """
    by_file = match_keys(symbols).groupBy("repo_id", F.col("path").alias("resolved_path"), "key").agg(F.min_by("symbol_id", "sym_ord").alias("dst_id"))
    linked = imports.filter("resolved_path is not null").select(*FILE, "imp_ord", "resolved_path")
    called = sites.select(*FILE, "key").distinct()
    names = linked.join(by_file, ["repo_id", "resolved_path"]).join(called, [*FILE, "key"], "left_semi").groupBy(*FILE, "key").agg(F.min_by("dst_id", "imp_ord").alias("dst_id"))
    return sites.join(names, [*FILE, "key"])


def resolve_global(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by the index of qualified names over all files: the first indexed."""
    index = symbols.groupBy("repo_id", F.col("qualified_name").alias("key")).agg(F.min_by("symbol_id", F.struct("file_ord", "sym_ord")).alias("dst_id"))
    return sites.join(index, ["repo_id", "key"])


def resolve_named(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by name or qualified name in the same file, otherwise by the global index.

    Both sides grow with the symbols, and estimates of exploded names are far too low: the joins shuffle, nothing is broadcast.
    """
    names = symbols.select(*FILE, "sym_ord", "symbol_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"))
    local = names.groupBy(*FILE, "key").agg(F.min_by("symbol_id", "sym_ord").alias("local_id"))
    index = symbols.groupBy("repo_id", F.col("qualified_name").alias("key")).agg(F.min_by("symbol_id", F.struct("file_ord", "sym_ord")).alias("global_id"))
    both = sites.join(local.hint("merge"), [*FILE, "key"], "left").join(index.hint("merge"), ["repo_id", "key"], "left")
    return both.withColumn("dst_id", F.coalesce("local_id", "global_id")).filter("dst_id is not null").drop("local_id", "global_id")


def call_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct (src_id, dst_id): same file first, then imported files. A symbol may call itself."""
    sites = call_sites(symbols)
    local = resolve_local(sites, symbols)
    rest = sites.join(local.select(*SITE), SITE, "left_anti")
    return local.select("repo_id", "src_id", "dst_id").union(resolve_imported(rest, symbols, imports).select("repo_id", "src_id", "dst_id")).distinct()


def typed_edges(symbols: DataFrame) -> DataFrame:
    """Distinct (src_id, type, dst_id): calls without loops, inherits, implements and tests."""

    def sites(c: str) -> DataFrame:
        return symbols.select(*FILE, F.col("symbol_id").alias("src_id"), F.col("sym_ord").alias("src_ord"), F.posexplode(c).alias("call_ord", "key"))

    def edge(found: DataFrame, kind: str) -> DataFrame:
        return found.select("repo_id", "src_id", F.lit(kind).alias("type"), "dst_id")

    calls = resolve_named(sites("calls"), symbols)
    parts = [edge(calls.filter("src_id <> dst_id"), "calls"), edge(resolve_named(sites("extends"), symbols), "inherits"), edge(resolve_named(sites("implements"), symbols), "implements")]
    parts.append(edge(calls.filter(paths.is_test_path(F.col("path"))), "tests"))
    return reduce(DataFrame.union, parts).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    """Callers instead of callees."""
    swapped = {"src_id": "dst_id", "dst_id": "src_id"}
    return edges.select(*[F.col(swapped.get(c, c)).alias(c) for c in edges.columns])


def with_reverse(edges: DataFrame) -> DataFrame:
    """Every edge from both ends, with ``direction``."""
    return edges.withColumn("direction", F.lit("callee")).unionByName(reverse(edges).withColumn("direction", F.lit("caller")))


def test_links(symbols: DataFrame, as_indexed: bool = False) -> DataFrame:
    """Symbols of test files whose name contains the name of another symbol, in any case.

    ``as_indexed``: only sources indexed before the test file or in it.
    """
    name = F.lower("name")
    length = F.length(name)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(F.sequence(F.lit(1), length - i + 1), lambda n: F.substring(name, i, n))))
    tests = symbols.filter(paths.is_test_name(F.col("path"))).select("repo_id", F.col("path").alias("test_path"), F.col("file_ord").alias("test_ord"), F.col("qualified_name").alias("test_symbol"), F.explode(F.array_distinct(pieces)).alias("key"))
    sources = symbols.select("repo_id", F.col("symbol_id").alias("src_id"), F.col("file_ord").alias("src_ord"), name.alias("key"))
    out = tests.join(sources, ["repo_id", "key"])
    return (out.filter("src_ord <= test_ord") if as_indexed else out).select("repo_id", "src_id", "test_path", "test_symbol")


def reference(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ids with the row to show for them; ``unknown`` where there is none."""
    shown = symbols.groupBy(F.col("symbol_id").alias("id")).agg(F.min_by(F.struct("qualified_name", "path", "kind"), F.struct("file_ord", "sym_ord")).alias("s"))
    unknown = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit("unknown"))
    return ids.join(shown, "id", "left").withColumns({"name": unknown("qualified_name"), "file": unknown("path"), "kind": unknown("kind")}).drop("s")


def neighbours(edges: DataFrame, symbols: DataFrame, wanted: DataFrame, side: str) -> DataFrame:
    """``callers`` or ``callees`` of wanted (path, symbol) rows."""
    from .parse import lookup

    e = edges if side == "callees" else reverse(edges)
    ids = lookup(symbols.withColumn("error", F.lit(None).cast("string")), wanted).filter("symbol_id is not null").select("path", "symbol", F.col("symbol_id").alias("src_id"))
    return reference(ids.join(e.select("src_id", F.col("dst_id").alias("id")), "src_id").select("path", "symbol", "id"), symbols)


def degrees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Number of callers, callees and inheritors of every symbol, zeros included."""
    calls, inherits = edges.filter("type = 'calls'"), edges.filter("type = 'inherits'")
    count = lambda e, side, name: e.groupBy(F.col(side).alias("symbol_id")).agg(F.count("*").alias(name))
    out = symbols.select("symbol_id").distinct()
    for part in (count(calls, "src_id", "callees"), count(calls, "dst_id", "callers"), count(inherits, "dst_id", "inheritors")):
        out = out.join(part, "symbol_id", "left")
    return out.na.fill(0, ["callees", "callers", "inheritors"])


def focus_files(files: DataFrame, focus: list[str], limit: int = 50) -> DataFrame:
    """Files that are a focus path or lie under one, the first ``limit`` in order."""
    hit = reduce(Column.__or__, [paths.inside(F.lit(p.rstrip("/")), F.col("path")) for p in focus], F.lit(False))
    return files.filter(hit).orderBy("file_ord", "path").limit(limit)


def walk(start: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` links of the start, each with its least distance. ``links``: src, dst.

    Links and every level are written once, so a level reads the one before it and not all that led there.
    """
    links = checkpoint(links.select("src", "dst"))
    seen = front = checkpoint(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        front = checkpoint(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def import_links(imports: DataFrame) -> DataFrame:
    return imports.filter("resolved_path is not null").select(F.col("path").alias("src"), F.col("resolved_path").alias("dst")).distinct()


def call_links(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links between files by the calls of their symbols."""
    at = symbols.select("symbol_id", "path").distinct()
    return edges.join(at.toDF("src_id", "src"), "src_id").join(at.toDF("dst_id", "dst"), "dst_id").select("src", "dst").distinct()


def context_slice(start: DataFrame, links: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 1) -> DataFrame:
    """Symbols of the files within ``depth`` links, with the number of their callees."""
    files = walk(start, links, depth).withColumnRenamed("node", "path")
    out = symbols.join(files, "path").select("path", "depth", "symbol_id", "qualified_name", "kind")
    return out.join(edges.groupBy(F.col("src_id").alias("symbol_id")).agg(F.count("*").alias("callees")), "symbol_id", "left").na.fill(0, ["callees"])


def with_degrees(part: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols (symbol_id) of a slice with their callers, callees and inheritors; ``edges`` with type."""
    return part.drop("callees").join(degrees(edges, part), "symbol_id", "left")


def callee_names(edges: DataFrame, symbols: DataFrame, limit: int = MOST_CALLEES) -> DataFrame:
    """(symbol_id, ord, id, name, file): the first ``limit`` callees of each symbol, in order of their ids."""
    rank = F.row_number().over(Window.partitionBy("src_id").orderBy("dst_id"))
    first = edges.select("src_id", "dst_id").distinct().withColumn("ord", rank).filter(F.col("ord") <= limit)
    return reference(first.select(F.col("src_id").alias("symbol_id"), "ord", F.col("dst_id").alias("id")), symbols).select("symbol_id", "ord", "id", "name", "file")


def exports(symbols: DataFrame) -> DataFrame:
    """(repo_id, path, names, n): what each file exports, in order of appearance; files without exports have no row."""
    named = symbols.filter("is_exported and error is null and parent is null")
    listed = named.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("sym_ord", "name"))).alias("x"))
    return listed.select(*FILE, F.col("x.name").alias("names"), F.size("x").alias("n"))


def by_id(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """Wanted ids (id) with the first symbol that has each: path, name, kind and lines; nulls where there is none."""
    shown = symbols.groupBy(F.col("symbol_id").alias("id")).agg(F.min_by(F.struct("path", "qualified_name", "kind", "start_line", "end_line"), F.struct("file_ord", "sym_ord")).alias("s"))
    return ids.join(shown, "id", "left").select("id", "s.path", "s.qualified_name", "s.kind", "s.start_line", "s.end_line")


def distances(pairs: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distance of (from_id, to_id): 0 same, 1 caller or callee, 2 inheritor, 3 neighbour of a callee, 5 further or unknown id, 10 not in the graph.

    ``edges``: src_id, type, dst_id.
    """
    calls = edges.filter("type = 'calls'").select("src_id", "dst_id").distinct()
    either = calls.union(reverse(calls).select("src_id", "dst_id")).distinct()
    two = calls.join(either.toDF("dst_id", "end"), "dst_id").select("src_id", F.col("end").alias("dst_id")).distinct()
    ends = [either.withColumn("d", F.lit(1)), edges.filter("type = 'inherits'").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")).withColumn("d", F.lit(2)), two.withColumn("d", F.lit(3))]
    near = reduce(DataFrame.unionByName, ends).groupBy(F.col("src_id").alias("from_id"), F.col("dst_id").alias("to_id")).agg(F.min("d").alias("d"))
    known = symbols.select(F.col("symbol_id").alias("from_id"), F.lit(True).alias("known")).distinct()
    out = pairs.join(near, ["from_id", "to_id"], "left").join(known, "from_id", "left")
    d = F.when(F.col("from_id") == F.col("to_id"), 0).when(F.col("from_id").isNull() | F.col("to_id").isNull(), 5).when(F.col("known").isNull(), 10).otherwise(F.coalesce("d", F.lit(5)))
    return out.withColumn("distance", d).drop("d", "known")


def purge(symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without those of files that are gone (path); edges go at both ends."""
    dead = symbols.join(gone, "path", "left_semi").select("symbol_id").distinct()
    left = edges.join(dead.withColumnRenamed("symbol_id", "src_id"), "src_id", "left_anti").join(dead.withColumnRenamed("symbol_id", "dst_id"), "dst_id", "left_anti")
    return symbols.join(gone, "path", "left_anti"), left
