"""Parsing, contracts and edges over the corpus of Python and TypeScript files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts
from ..operators import graph, parse
from ..registry import query
from ..sources import mixed
from ..storage import checkpoint

WITH = f"WITH {mixed.EXPECTED_SQL}"
_SHOWN = "path, sym_ord, qualified_name, kind, signature, start_line, end_line"


def symbols(spark, sf_dir, language: str, extended: bool = False):
    files = mixed.files(spark, sf_dir).filter(F.col("language") == language)
    return contracts.add_contract(parse.parse_symbols(files, extended)).filter("error is null")


def joined(df, *names: str):
    return df.withColumns({c: F.array_join(c, ",") for c in names})


@query("parse_python", f"{WITH} SELECT {_SHOWN}, array_to_string(extends, ',') AS extends FROM python")
def parse_python(spark, sf_dir):
    return joined(symbols(spark, sf_dir, "python"), "extends").select(*_SHOWN.split(", "), "extends")


@query("parse_typescript", f"{WITH} SELECT {_SHOWN}, array_to_string(extends, ',') AS extends, array_to_string(implements, ',') AS implements FROM basic")
def parse_typescript(spark, sf_dir):
    return joined(symbols(spark, sf_dir, "typescript"), "extends", "implements").select(*_SHOWN.split(", "), "extends", "implements")


@query("parse_typescript_extended", f"{WITH} SELECT {_SHOWN}, is_exported FROM extended")
def parse_typescript_extended(spark, sf_dir):
    return symbols(spark, sf_dir, "typescript", True).select(*_SHOWN.split(", "), "is_exported")


@query(
    "contracts_mixed",
    f"""{WITH}, u AS (SELECT path, sym_ord, calls, throws, effects, is_async FROM python UNION ALL SELECT path, sym_ord, calls, throws, effects, false FROM extended)
      SELECT path, sym_ord, array_to_string(calls, ',') AS calls, array_to_string(throws, ',') AS throws, array_to_string(effects, ',') AS effects, is_async FROM u""",
)
def contracts_mixed(spark, sf_dir):
    both = symbols(spark, sf_dir, "python").unionByName(symbols(spark, sf_dir, "typescript", True))
    flag = F.coalesce(F.col("properties.async"), F.lit(False)).alias("is_async")
    return joined(both, "calls", "throws", "effects").select("path", "sym_ord", "calls", "throws", "effects", flag)


@query(
    "imports_mixed",
    f"""{WITH}, i AS (SELECT path, 0 AS imp_ord, concat('pkg.m', k + 2) AS specifier FROM py UNION ALL SELECT path, 1, 'os' FROM py UNION ALL SELECT path, 0, concat('./t', k + 2) FROM ts UNION ALL SELECT path, 1, concat('../x', k) FROM ts),
      t AS (SELECT i.*, concat(regexp_extract(path, '^(.*)/[^/]*$', 1), substr(specifier, 2), '.ts') AS target FROM i)
      SELECT t.path, imp_ord, specifier, f.path AS resolved_path FROM t LEFT JOIN ts f ON f.path = t.target AND t.specifier LIKE './%'""",
)
def imports_mixed(spark, sf_dir):
    files = mixed.files(spark, sf_dir)
    return graph.resolve_imports(parse.parse_imports(files), files).select("path", "imp_ord", "specifier", "resolved_path")


@query(
    "edges_mixed",
    f"""{WITH}, s AS (SELECT * EXCLUDE (calls, throws, effects, is_async), 'python' AS lang FROM python UNION ALL SELECT *, 'typescript' FROM basic),
      ids AS (SELECT *, concat('sym_', substr(sha256(concat(path, '|', lang, '|', kind, '|', qualified_name, '|', signature, '|')), 1, 12)) AS id FROM s),
      up AS (SELECT id, 'inherits' AS type, unnest(extends) AS name FROM ids UNION ALL SELECT id, 'implements', unnest(implements) FROM ids)
      SELECT up.id AS src_id, up.type, t.id AS dst_id FROM up JOIN ids t ON t.qualified_name = up.name""",
)
def edges_mixed(spark, sf_dir):
    """Classes with what they extend and implement. Symbols are written once: sites, names and index read them, for both types."""
    both = checkpoint(symbols(spark, sf_dir, "python").unionByName(symbols(spark, sf_dir, "typescript")))
    return graph.typed_edges(both).filter("type in ('inherits', 'implements')").select("src_id", "type", "dst_id")


@query("file_exports", f"{WITH} SELECT path, array_to_string(list(qualified_name ORDER BY sym_ord), ',') AS names, CAST(count(*) AS INTEGER) AS n FROM extended WHERE is_exported GROUP BY path")
def file_exports(spark, sf_dir):
    return joined(graph.exports(symbols(spark, sf_dir, "typescript", True)), "names").select("path", "names", "n")


@query("parser_meta", f"{WITH} SELECT path, qualified_name, 'enhanced-regex' AS backend, 0.85::DOUBLE AS confidence, CAST(0 AS INTEGER) AS syntax_errors, false AS fallback FROM (SELECT path, qualified_name FROM python UNION ALL SELECT path, qualified_name FROM basic)")
def parser_meta(spark, sf_dir):
    """Every symbol with what parsed it."""
    s = parse.with_meta(symbols(spark, sf_dir, "python").unionByName(symbols(spark, sf_dir, "typescript")))
    return s.select("path", "qualified_name", "parser.backend", "parser.confidence", F.size("parser.syntax_errors").alias("syntax_errors"), "parser.fallback")
