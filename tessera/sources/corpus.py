"""A code corpus made from ``part`` by a rule, so that what a parser must find is known.

File k (path src/<k mod 20>/f<k>.js) imports and calls f<k+20>, throws, and writes or reads
by k mod 4; every seventh awaits a lock; every tenth (from 5) has a class that extends the
class of file k+10; every fiftieth has a test file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse
from ..functions import contracts

_CODE = """concat('import { f', k + 20, ' } from ''./f', k + 20, '.js'';', chr(10), 'export function f', k, '(a) {', chr(10),
  '  if (a < 0) throw new E', k % 5, '(a);', chr(10), '  db.', CASE k % 4 WHEN 0 THEN 'save' WHEN 1 THEN 'send' WHEN 2 THEN 'get' ELSE 'log' END, '(a);', chr(10),
  CASE WHEN k % 7 = 0 THEN concat('  await lock(a);', chr(10)) ELSE '' END, '  return f', k + 20, '(a);', chr(10), '}', chr(10),
  CASE WHEN k % 10 = 5 THEN concat('export class C', k, ' extends C', k + 10, ' {', chr(10), '  run(a) {', chr(10), '    return f', k, '(a);', chr(10), '  }', chr(10), '}', chr(10)) ELSE '' END)"""
_TEST = "concat('import { f', k, ' } from ''./f', k, '.js'';', chr(10), 'export function test_f', k, '() {', chr(10), '  f', k, '(1);', chr(10), '}', chr(10))"

#: The same files for DuckDB and Spark.
FILES_SQL = f"""
  SELECT 'repo' AS repo_id, concat('src/', k % 20, '/f', k, '.js') AS path, {_CODE} AS code, 2 * k AS file_ord FROM p
  UNION ALL
  SELECT 'repo', concat('src/', k % 20, '/test_f', k, '.js'), {_TEST}, 2 * k + 1 FROM p WHERE k % 50 = 0"""

#: What the parsers must find, written down from the rule (DuckDB).
EXPECTED_SQL = """
p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part),
files AS (@files),
fn AS (SELECT *, concat('src/', k % 20, '/f', k, '.js') AS path, CASE WHEN k % 7 = 0 THEN 7 ELSE 6 END AS stop, CASE k % 4 WHEN 0 THEN 'save' WHEN 1 THEN 'send' WHEN 2 THEN 'get' ELSE 'log' END AS verb FROM p),
symbols AS (
  SELECT path, 2 * k AS file_ord, 0 AS sym_ord, concat('f', k) AS name, concat('f', k) AS qualified_name, 'function' AS kind, '(a)' AS signature, 2 AS start_line, stop AS end_line,
    concat('export function f', k, '(a) {', chr(10), '  if (a < 0) throw new E', k % 5, '(a);', chr(10), '  db.', verb, '(a);', chr(10), CASE WHEN k % 7 = 0 THEN concat('  await lock(a);', chr(10)) ELSE '' END, '  return f', k + 20, '(a);', chr(10), '}') AS body,
    [x FOR x IN ['if', concat('E', k % 5), concat('db.', verb), CASE WHEN k % 7 = 0 THEN 'lock' END, concat('f', k + 20)] IF x IS NOT NULL] AS calls,
    [concat('E', k % 5)] AS throws, CASE k % 4 WHEN 0 THEN ['database-write'] WHEN 1 THEN ['network-write'] WHEN 2 THEN ['network-read'] ELSE CAST([] AS VARCHAR[]) END AS effects, k % 7 = 0 AS locked, CAST([] AS VARCHAR[]) AS extends
  FROM fn
  UNION ALL
  SELECT path, 2 * k, 1, concat('C', k), concat('C', k), 'class', '(a)', stop + 1, stop + 5, concat('export class C', k, ' extends C', k + 10, ' {', chr(10), '  run(a) {', chr(10), '    return f', k, '(a);', chr(10), '  }', chr(10), '}'),
    ['run', concat('f', k)], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false, [concat('C', k + 10)] FROM fn WHERE k % 10 = 5
  UNION ALL
  SELECT path, 2 * k, 2, 'run', concat('C', k, '.run'), 'method', '(a)', stop + 2, stop + 4, concat('run(a) {', chr(10), '    return f', k, '(a);', chr(10), '  }'), [concat('f', k)], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false, CAST([] AS VARCHAR[]) FROM fn WHERE k % 10 = 5
  UNION ALL
  SELECT concat('src/', k % 20, '/test_f', k, '.js'), 2 * k + 1, 0, concat('test_f', k), concat('test_f', k), 'function', '()', 2, 4, concat('export function test_f', k, '() {', chr(10), '  f', k, '(1);', chr(10), '}'), [concat('f', k)], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false, CAST([] AS VARCHAR[]) FROM p WHERE k % 50 = 0
),
ids AS (SELECT *, concat('sym_', substr(sha256(concat(path, '|javascript|', kind, '|', qualified_name, '|', signature, '|')), 1, 12)) AS symbol_id, substr(sha256(concat(signature, '::', body)), 1, 12) AS symbol_revision FROM symbols),
imports AS (
  SELECT path, 0 AS imp_ord, concat('./f', k + 20, '.js') AS specifier, concat('src/', k % 20, '/f', k + 20, '.js') AS target FROM fn
  UNION ALL
  SELECT concat('src/', k % 20, '/test_f', k, '.js'), 0, concat('./f', k, '.js'), concat('src/', k % 20, '/f', k, '.js') FROM p WHERE k % 50 = 0
),
resolved AS (SELECT i.path, i.imp_ord, i.specifier, f.path AS resolved_path FROM imports i LEFT JOIN files f ON f.path = i.target),
sites AS (SELECT path, symbol_id AS src_id, sym_ord AS src_ord, unnest(calls) AS key, unnest(range(len(calls))) AS call_ord FROM ids)
""".replace("@files", FILES_SQL)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, code, file_ord and what follows from the path."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"))
    sources = part.selectExpr("'repo' AS repo_id", "concat('src/', k % 20, '/f', k, '.js') AS path", f"{_CODE} AS code", "2 * k AS file_ord")
    tests = part.filter("k % 50 = 0").selectExpr("'repo' AS repo_id", "concat('src/', k % 20, '/test_f', k, '.js') AS path", f"{_TEST} AS code", "2 * k + 1 AS file_ord")
    return parse.with_file_facts(sources.unionByName(tests))


def symbols(spark: SparkSession, sf_dir: str, extended: bool = False) -> DataFrame:
    """Parsed symbols of the corpus with their contracts."""
    return contracts.add_contract(parse.parse_symbols(files(spark, sf_dir), extended)).filter("error is null")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_imports(files(spark, sf_dir))
