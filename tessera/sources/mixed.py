"""A second corpus, of Python and TypeScript files made from ``customer`` by a rule.

Customer k gives py/<k mod 10>/p<k>.py where k is odd, else ts/<k mod 10>/t<k>.ts. The classes of a file extend those of
file k + 2. Comments, strings with brackets, type parameters, generators, arrows, enums and three effects occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse


def _lines(*lines: str) -> str:
    """An SQL expression of a file; ``{k + 2}`` in a line stands for that number, in Spark and DuckDB alike."""
    parts = []
    for line in lines:
        for i, part in enumerate(line.replace("'", "''").replace("{{", "\x01").replace("}}", "\x02").split("{")):
            expr, _, rest = part.partition("}") if i else ("", "", part)
            parts += [expr] * bool(expr) + ["'" + rest.replace("\x01", "{").replace("\x02", "}") + "'"] * bool(rest)
        parts.append("chr(10)")
    return f"concat({', '.join(parts)})"


PYTHON = _lines(
    "from pkg.m{k + 2} import g{k}", "import os", "", "class P{k}(P{k + 2}, abc.Base):", '    """', "    def no():", '    """', "    def run(self, x):", "        return g{k}(x)", "",
    "    async def stop(self):", "        raise E{k % 5}(self)", "", "def top{k}(a,", "        b):", "    # def not_me():", "    return P{k}(a)",
)
TYPESCRIPT = _lines(
    "import {{ a }} from './t{k + 2}';", 'const q{k} = require("../x{k}");', "/* function no() {{", "}} */", "export interface I{k} extends J {{", "  a: string;", "}}", "export type T{k} = string | number;",
    "export abstract class K{k}<T> extends K{k + 2}<T> implements I{k}, M {{", "  run(a: T): void {{", "    fs.writeFile(a);", "  }}", "  static make(x) {{", "    return new Map([[x, '}}']]);", "  }}", "}}",
    "export enum Z{k} {{", "  A, B", "}}", "export const up{k} = (x) => x * {k};", "export const LIMIT{k} = {k};", "let count{k} = 0;", "export function* gen{k}(n) {{", "  cache.update(n);", "  fs.readFile(n);",
    "  child.exec(n);", "  throw new Bad{k % 3}(n);", "}}",
)

#: What the parsers must find, written down from the rule (DuckDB).
EXPECTED_SQL = """
c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer),
py AS (SELECT k, concat('py/', k % 10, '/p', k, '.py') AS path FROM c WHERE k % 2 = 1),
ts AS (SELECT k, concat('ts/', k % 10, '/t', k, '.ts') AS path FROM c WHERE k % 2 = 0),
none AS (SELECT CAST([] AS VARCHAR[]) AS l),
python AS (
  SELECT path, 0 AS sym_ord, concat('P', k) AS qualified_name, 'class' AS kind, concat('(P', k + 2, ', abc.Base)') AS signature, 4 AS start_line, 12 AS end_line, [concat('P', k + 2), 'abc.Base'] AS extends, l AS implements,
    [concat('P', k), 'no', 'run', concat('g', k), 'stop', concat('E', k % 5)] AS calls, l AS throws, l AS effects, true AS is_async FROM py, none
  UNION ALL SELECT path, 1, concat('P', k, '.run'), 'function', '(self, x)', 8, 9, l, l, ['run', concat('g', k)], l, l, false FROM py, none
  UNION ALL SELECT path, 2, concat('P', k, '.stop'), 'async_function', '(self)', 11, 12, l, l, ['stop', concat('E', k % 5)], l, l, true FROM py, none
  UNION ALL SELECT path, 3, concat('top', k), 'function', '(a, b)', 14, 17, l, l, [concat('top', k), 'not_me', concat('P', k)], l, l, false FROM py, none
),
basic AS (
  SELECT path, 0 AS sym_ord, concat('I', k) AS qualified_name, 'interface' AS kind, '()' AS signature, 5 AS start_line, 7 AS end_line, l AS extends, l AS implements FROM ts, none
  UNION ALL SELECT path, 1, concat('T', k), 'type', '()', 8, 8, l, l FROM ts, none
  UNION ALL SELECT path, 2, concat('K', k), 'class', '(a: T)', 9, 16, [concat('K', k + 2)], [concat('I', k), 'M'] FROM ts, none
  UNION ALL SELECT path, 3, concat('K', k, '.run'), 'method', '(a: T)', 10, 12, l, l FROM ts, none
),
extended AS (
  SELECT path, 0 AS sym_ord, concat('q', k) AS qualified_name, 'constant' AS kind, concat('const q', k) AS signature, 2 AS start_line, 2 AS end_line, false AS is_exported, ['require'] AS calls, l AS throws, l AS effects FROM ts, none
  UNION ALL SELECT path, 1, concat('I', k), 'interface', concat('interface I', k), 5, 7, true, l, l, l FROM ts, none
  UNION ALL SELECT path, 2, concat('T', k), 'type', concat('type T', k), 8, 8, true, l, l, l FROM ts, none
  UNION ALL SELECT path, 3, concat('K', k), 'class', concat('class K', k), 9, 16, true, ['run', 'fs.writeFile', 'make', 'Map'], l, ['filesystem-write'] FROM ts, none
  UNION ALL SELECT path, 4, concat('K', k, '.make'), 'method', concat('K', k, '.make(x)'), 13, 15, false, ['Map'], l, l FROM ts, none
  UNION ALL SELECT path, 5, concat('Z', k), 'enum', concat('enum Z', k), 17, 19, true, l, l, l FROM ts, none
  UNION ALL SELECT path, 6, concat('up', k), 'arrow_function', concat('up', k, '(x)'), 20, 20, true, l, l, l FROM ts, none
  UNION ALL SELECT path, 7, concat('LIMIT', k), 'constant', concat('const LIMIT', k), 21, 21, true, l, l, l FROM ts, none
  UNION ALL SELECT path, 8, concat('count', k), 'variable', concat('let count', k), 22, 22, false, l, l, l FROM ts, none
  UNION ALL SELECT path, 9, concat('gen', k), 'function', concat('generator gen', k, '(n)'), 23, 28, true, ['cache.update', 'fs.readFile', 'child.exec', concat('Bad', k % 3)], [concat('Bad', k % 3)], ['database-write', 'process-spawn'] FROM ts, none
)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, code, file_ord and what follows from the path."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    odd = F.col("k") % 2 == 1
    path = F.when(odd, F.expr("concat('py/', k % 10, '/p', k, '.py')")).otherwise(F.expr("concat('ts/', k % 10, '/t', k, '.ts')"))
    return parse.with_file_facts(c.select(F.lit("mixed").alias("repo_id"), path.alias("path"), F.when(odd, F.expr(PYTHON)).otherwise(F.expr(TYPESCRIPT)).alias("code"), F.col("k").alias("file_ord")))
