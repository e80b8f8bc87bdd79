"""Parsing and contracts over the derived code corpus and over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts
from ..operators import parse
from ..registry import query
from ..sources import corpus
from .identity import table

WITH = f"WITH {corpus.EXPECTED_SQL}"


@query("parse_symbols", f"{WITH} SELECT path, sym_ord, name, qualified_name, kind, signature, start_line, end_line, body, symbol_id, symbol_revision FROM ids")
def parse_symbols(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("path", "sym_ord", "name", "qualified_name", "kind", "signature", "start_line", "end_line", "body", "symbol_id", "symbol_revision")


@query("parse_extended", f"{WITH} SELECT path, sym_ord, qualified_name, kind, CASE kind WHEN 'class' THEN concat('class ', name, ' extends ', extends[1]) ELSE concat(qualified_name, signature) END AS signature, start_line, end_line, kind <> 'method' AS is_exported FROM ids")
def parse_extended(spark, sf_dir):
    return corpus.symbols(spark, sf_dir, extended=True).select("path", "sym_ord", "qualified_name", "kind", "signature", "start_line", "end_line", "is_exported")


@query("parse_imports", f"{WITH} SELECT path, imp_ord, specifier, concat('import {{ ', regexp_extract(specifier, '/(\\w+)\\.js$', 1), ' }} from ''', specifier, '''') AS raw FROM imports")
def parse_imports(spark, sf_dir):
    return corpus.imports(spark, sf_dir).select("path", "imp_ord", "specifier", "raw")


@query("extract_calls", f"{WITH} SELECT symbol_id, unnest(calls) AS call, unnest(range(len(calls))) AS ord FROM ids")
def extract_calls(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("symbol_id", F.posexplode("calls").alias("ord", "call")).withColumn("ord", F.col("ord").cast("long"))


@query(
    "extract_calls_pages",
    r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(\w+(?:\.\w+)*)\s*\(', 1) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS call, unnest(range(len(l))) AS ord FROM c)
      SELECT page_id, call, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(ord)) - 1 AS BIGINT) AS ord FROM u GROUP BY page_id, call""",
)
def extract_calls_pages(spark, sf_dir):
    found = contracts.calls(F.col("html"), F.lit(""), F.lit("javascript"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ord", "call")).withColumn("ord", F.col("ord").cast("long"))


@query("extract_throws", f"{WITH} SELECT symbol_id, unnest(throws) AS thrown FROM ids")
def extract_throws(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("symbol_id", F.explode("throws").alias("thrown"))


@query("extract_effects", f"{WITH} SELECT symbol_id, array_to_string(effects, ',') AS effects FROM ids")
def extract_effects(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("symbol_id", F.array_join("effects", ",").alias("effects"))


@query(
    "contract_props",
    f"""{WITH} SELECT symbol_id, 'public' AS visibility, locked AS is_async, locked AS uses_locking, false AS transactional, CASE WHEN len(effects) > 0 THEN 0.85 ELSE 0.3 END::DOUBLE AS effects_confidence, 0.5::DOUBLE AS idempotent FROM ids""",
)
def contract_props(spark, sf_dir):
    flag = lambda c: F.coalesce(F.col(f"properties.{c}"), F.lit(False))
    return corpus.symbols(spark, sf_dir).select(
        "symbol_id", "visibility", flag("async").alias("is_async"), flag("uses_locking").alias("uses_locking"), flag("transactional").alias("transactional"), F.col("confidence.effects").alias("effects_confidence"),
        F.col("confidence.idempotent").alias("idempotent"),
    )


@query("symbol_risk", f"{WITH} SELECT symbol_id, CAST(CASE WHEN locked THEN 2 ELSE 0 END + CASE WHEN len(throws) > 0 THEN 1 ELSE 0 END AS INTEGER) AS risk FROM ids")
def symbol_risk(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("symbol_id", contracts.risk_score().cast("int").alias("risk"))


@query("escalation", f"{WITH} SELECT symbol_id, contains(qualified_name, 'f7') OR contains(name, 'f7') OR contains('at f3 (x)', name) OR len(effects) = 0 OR locked AS escalates FROM ids")
def escalation(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("symbol_id", contracts.escalates(F.lit("f7"), F.lit("at f3 (x)"), F.lit("")).alias("escalates"))


@query(
    "file_contracts",
    f"""{WITH} SELECT path, sym_ord, symbol_id AS id, symbol_revision AS revision, concat('@', qualified_name) AS handle, kind, signature, 'public' AS visibility, array_to_string(effects, ',') AS effects, array_to_string(throws, ',') AS throws,
      array_to_string(calls, ',') AS calls, start_line, end_line FROM ids""",
)
def file_contracts(spark, sf_dir):
    out = parse.file_contracts(parse.parse_symbols(corpus.files(spark, sf_dir)))
    return out.drop("properties", "confidence").withColumns({c: F.array_join(c, ",") for c in ("effects", "throws", "calls")})


@query(
    "symbol_source_view",
    f"""{WITH}, v AS (SELECT unnest(['source', 'contract', 'reference']) AS view)
      SELECT path, symbol_id AS id, kind, view, CASE WHEN view = 'source' THEN body END AS body, signature, CASE WHEN view <> 'reference' THEN array_to_string(effects, ',') END AS effects, CASE WHEN view <> 'reference' THEN array_to_string(calls, ',') END AS calls FROM ids, v""",
)
def symbol_source_view(spark, sf_dir):
    s = parse.parse_symbols(corpus.files(spark, sf_dir))
    views = [parse.source_view(s, v) for v in ("source", "contract", "reference")]
    out = views[0].unionByName(views[1]).unionByName(views[2])
    return out.drop("throws").withColumns({c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")) for c in ("effects", "calls")})


@query(
    "symbol_lookup_first",
    f"""{WITH}, w AS (SELECT DISTINCT path, CASE WHEN file_ord % 3 = 0 THEN 'run' WHEN file_ord % 3 = 1 THEN 'missing' ELSE name END AS symbol FROM ids),
      m AS (SELECT w.path, w.symbol, s.symbol_id, s.qualified_name, s.kind, row_number() OVER (PARTITION BY w.path, w.symbol ORDER BY s.sym_ord) AS r FROM w LEFT JOIN ids s ON s.path = w.path AND (s.name = w.symbol OR s.qualified_name = w.symbol))
      SELECT path, symbol, symbol_id, qualified_name, kind FROM m WHERE r = 1""",
)
def symbol_lookup_first(spark, sf_dir):
    s = corpus.symbols(spark, sf_dir)
    wanted = s.select("path", F.when(F.col("file_ord") % 3 == 0, "run").when(F.col("file_ord") % 3 == 1, "missing").otherwise(F.col("name")).alias("symbol")).distinct()
    return parse.lookup(s, wanted)
