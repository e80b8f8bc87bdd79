"""Identities, revisions and path predicates over documents and derived paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, paths, text
from ..registry import query
from ..sources import corpus

SPACE = text.SPACES


def norm(expression: str) -> str:
    """SQL of a normal signature."""
    return rf"trim(regexp_replace(regexp_replace(COALESCE({expression}, ''), '{SPACE}+', ' ', 'g'), 'async\s+', '', 'g'))"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("file_revision", "SELECT doc_id, substr(sha256(text), 1, 12) AS file_revision, substr(sha256(text), 1, 12) AS project_revision FROM documents")
def file_revision(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.file_revision(F.col("text")).alias("file_revision"), identity.project_revision(F.col("text")).alias("project_revision"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, concat(substr(sha256(text), 1, 2), '/', sha256(text)) AS blob_path FROM documents")
def content_hash(spark, sf_dir):
    h = identity.content_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash"), identity.blob_path(h).alias("blob_path"))


@query(
    "symbol_id",
    f"""SELECT doc_id, concat('sym_', substr(sha256(concat('src/', replace(source, '\\', '/'), '/d', doc_id, '.js|', lang, '|function|run', doc_id, '|', {norm("substr(text, 1, 40)")}, '|',
      CASE WHEN doc_id % 3 > 0 THEN concat('#', doc_id % 3) ELSE '' END)), 1, 12)) AS symbol_id,
      concat('sym_', substr(sha256(concat('|', lang, '||run', doc_id, '||')), 1, 12)) AS coarse_id FROM documents""",
)
def symbol_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src\\"), F.col("source"), F.lit("/d"), F.col("doc_id"), F.lit(".js"))
    name = F.concat(F.lit("run"), F.col("doc_id"))
    return d.select(
        "doc_id", identity.symbol_id(path, F.col("lang"), F.lit("function"), name, F.substring("text", 1, 40), F.col("doc_id") % 3).alias("symbol_id"), identity.compat_symbol_id(F.col("lang"), name).alias("coarse_id")
    )


@query("symbol_revision", "SELECT doc_id, substr(sha256(concat('run(', lang, ')::', text)), 1, 12) AS symbol_revision, CASE WHEN doc_id % 5 = 0 THEN '000000000000' ELSE substr(sha256(text), 1, 12) END AS subtree_revision FROM documents")
def symbol_revision(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    subtree = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))
    return d.select("doc_id", identity.symbol_revision(F.col("text"), F.concat(F.lit("run("), "lang", F.lit(")"))).alias("symbol_revision"), identity.subtree_revision(subtree).alias("subtree_revision"))


@query("normalize_signature", f"SELECT doc_id, {norm('text')} AS signature FROM documents")
def normalize_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.normal_signature(F.col("text")).alias("signature"))


_MESSY = "CASE page_id % 6 WHEN 0 THEN concat('./a//b/../p', page_id, '.js') WHEN 1 THEN concat('/repo/x/./p', page_id, '.js') WHEN 2 THEN concat('../../p', page_id) WHEN 3 THEN '.' WHEN 4 THEN concat('/other/p', page_id) ELSE concat('d/', page_id, '/../../../p') END"


@query(
    "canonical_path",
    f"""WITH m AS (SELECT page_id, {_MESSY} AS raw FROM pages),
    s AS (SELECT *, CASE page_id % 6 WHEN 0 THEN concat('a/p', page_id, '.js') WHEN 1 THEN concat('x/p', page_id, '.js') ELSE NULL END AS path FROM m)
    SELECT page_id, raw, path, CASE WHEN path IS NOT NULL THEN NULL WHEN raw = '.' THEN concat('INVALID_REPOSITORY_PATH: ', raw) ELSE concat('PATH_OUTSIDE_REPOSITORY: ', raw) END AS error FROM s""",
)
def canonical_path(spark, sf_dir):
    made = table(spark, sf_dir, "pages").select("page_id", F.expr(_MESSY).alias("raw"))
    return made.withColumn("c", paths.canonical(F.lit("/repo"), F.col("raw"))).select("page_id", "raw", "c.path", "c.error")


@query("path_containment", "SELECT path, path LIKE 'src/1/%' AS inside, substr(path, 1, 5) = 'src/1' AS prefix_only FROM (SELECT concat('src/', p_partkey % 20, '/f', p_partkey, '.js') AS path FROM part UNION ALL SELECT 'src/1')")
def path_containment(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.expr("concat('src/', p_partkey % 20, '/f', p_partkey, '.js')").alias("path")).union(spark.sql("SELECT 'src/1'"))
    return p.select("path", (paths.inside(F.lit("src/1"), F.col("path")) & (F.col("path") != "src/1")).alias("inside"), F.col("path").startswith("src/1").alias("prefix_only"))


_NAMES = "element_at({array}, CAST(1 + p_partkey % 24 AS INT))"
_LIST = ["index.js", "a.test.ts", "b.spec.jsx", "test_c.py", "d_test.py", "main.TS", "e.mjs", "f.cjs", "g.mts", "h.pyi", "i.go", "j.rs", "k.sh", "package.json", "l.yaml", "m.yml", "n.md", "o.txt", "Makefile", ".env.example", "p.tsx", "cli.jsx", "q.PY", "setup.py"]
_DIRS = ["src", "src/test", "lib/__tests__", "bin", "node_modules/x", "app/dist/y", "tests", "scripts"]
_PATHS = "SELECT p_partkey, concat({dirs}, '/', {names}) AS path FROM part"
PATHS_SQL = _PATHS.format(dirs=f"list_extract({_DIRS}, CAST(1 + p_partkey // 24 % 8 AS INT))", names=f"list_extract({_LIST}, CAST(1 + p_partkey % 24 AS INT))")


def some_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))
    return p.select("p_partkey", F.concat(pick(_DIRS, F.floor(F.col("p_partkey") / 24) % 8), F.lit("/"), pick(_LIST, F.col("p_partkey") % 24)).alias("path"))


_LANG = """CASE lower(regexp_extract(path, '[^/.][^/]*\\.([^./]+)$', 1)) WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'tsx' THEN 'tsx'
  WHEN 'jsx' THEN 'jsx' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'sh' THEN 'bash' WHEN 'json' THEN 'json' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'md' THEN 'markdown' ELSE 'text' END"""


@query("language_detect", f"SELECT p_partkey, path, {_LANG} AS language FROM ({PATHS_SQL})")
def language_detect(spark, sf_dir):
    return some_paths(spark, sf_dir).withColumn("language", paths.language(F.col("path")))


@query("code_file_scan", f"SELECT p_partkey, path, {_LANG} AS language FROM ({PATHS_SQL}) WHERE {_LANG} NOT IN ('text', 'json', 'yaml', 'markdown') AND NOT list_has_any(string_split(path, '/'), ['node_modules', '.git', '__pycache__', 'dist', 'build', '.cache'])")
def code_file_scan(spark, sf_dir):
    p = some_paths(spark, sf_dir)
    return p.filter(paths.is_code(F.col("path")) & ~paths.excluded(F.col("path"))).withColumn("language", paths.language(F.col("path")))


@query("config_files", f"SELECT p_partkey, path FROM ({PATHS_SQL}) WHERE regexp_extract(path, '([^/]*)$', 1) IN ('package.json', 'tsconfig.json', 'pyproject.toml', 'setup.py', 'config.yaml', 'config.yml', '.env.example', 'jest.config.js')")
def config_files(spark, sf_dir):
    return some_paths(spark, sf_dir).filter(paths.is_config(F.col("path")))


@query("test_predicate_name", f"SELECT p_partkey, path, contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, 'test_') OR contains(path, '_test.') AS is_test FROM ({PATHS_SQL})")
def test_predicate_name(spark, sf_dir):
    return some_paths(spark, sf_dir).withColumn("is_test", paths.is_test_name(F.col("path")))


@query("test_predicate_path", f"""SELECT p_partkey, path, regexp_matches(path, '\\.(test|spec)\\.[jt]sx?$|test_|_test\\.py$|(^|/)(test|tests|__tests__)/') AS is_test FROM ({PATHS_SQL})""")
def test_predicate_path(spark, sf_dir):
    return some_paths(spark, sf_dir).withColumn("is_test", paths.is_test_path(F.col("path")))


@query("entrypoint_predicate", f"""SELECT p_partkey, path, regexp_matches(path, '(^|/)((index|main|app|server|cli|bin|entry|start|run)\\.[jt]sx?$|(bin|cli|scripts)/)') AS is_entrypoint FROM ({PATHS_SQL})""")
def entrypoint_predicate(spark, sf_dir):
    return some_paths(spark, sf_dir).withColumn("is_entrypoint", paths.is_entrypoint(F.col("path")))


@query("test_candidates", """SELECT p_partkey, unnest([concat('src/f', p_partkey, '.test.js'), concat('src/f', p_partkey, '.spec.js'), concat('test/f', p_partkey, '.js'), concat('__tests__/f', p_partkey, '.js'), concat('test/f', p_partkey, '.test.js')]) AS candidate, unnest(range(5)) AS ord FROM part""")
def test_candidates(spark, sf_dir):
    path = F.expr("concat('src/f', p_partkey, '.js')")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(paths.test_candidates(path)).alias("ord", "candidate")).withColumn("ord", F.col("ord").cast("long"))


@query("freshness", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'STALE_FILE' WHEN doc_id % 4 = 2 THEN 'STALE_SYMBOL' END AS error FROM documents")
def freshness(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    own = identity.symbol_revision(F.col("text"), F.lit("()"))
    was = F.when(F.col("doc_id") % 4 == 2, F.lit("000000000000")).when(F.col("doc_id") % 4 == 3, F.lit("")).otherwise(own)
    return d.select("doc_id", identity.freshness(identity.file_revision(old), identity.file_revision(F.col("text")), was, own).alias("error"))


@query("retrieval_ids", "SELECT doc_id, concat('file:', lower(substr(hex(CAST(concat(source, '/', doc_id) AS BLOB)), 1, 12))) AS file_id, concat('sym:', substr(sha256(text), 1, 12)) AS symbol_id FROM documents")
def retrieval_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", identity.file_retrieval_id(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("file_id"), identity.symbol_retrieval_id(text.sha256_short(F.col("text"))).alias("symbol_id"))


@query("entrypoints", f"WITH {corpus.EXPECTED_SQL}, e AS (SELECT f.path, s.symbol_id FROM files f LEFT JOIN ids s ON s.path = f.path AND s.kind <> 'method') SELECT path, count(symbol_id) AS exported FROM e WHERE regexp_matches(path, '(^|/)(bin|cli|scripts)/|/f1\\.js$') GROUP BY path")
def entrypoints(spark, sf_dir):
    """Entrypoints with the number of symbols they export; here f1 of the corpus is moved to a bin folder's rules."""
    files = corpus.files(spark, sf_dir).filter(F.col("is_entrypoint") | F.col("path").rlike(r"/f1\.js$"))
    exported = corpus.symbols(spark, sf_dir).filter("is_exported").groupBy("path").agg(F.count("*").alias("exported"))
    return files.select("path").join(exported, "path", "left").select("path", F.coalesce("exported", F.lit(0)).cast("long").alias("exported"))
