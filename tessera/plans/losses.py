"""Loss manifests over documents: one manifest a source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import loss
from ..registry import query
from .identity import table

_REASONS = list(loss.REASONS)
_PICK = f"list_extract({_REASONS}, CAST(1 + doc_id % 14 AS INTEGER))"
_TEXT = "CASE " + " ".join(f"WHEN reason = '{k}' THEN '{v}'" for k, v in loss.REASONS.items()) + " ELSE reason END"

ITEMS = f"""
items AS (
  SELECT source AS manifest_id, 'file' AS kind, concat(source, '/', doc_id) AS item, reason, CASE WHEN doc_id % 2 = 0 THEN 'by hand' ELSE {_TEXT} END AS detail, concat('file:', lower(substr(hex(CAST(concat(source, '/', doc_id) AS BLOB)), 1, 12))) AS retrieval_id, CAST(NULL AS DOUBLE) AS confidence
    FROM (SELECT *, {_PICK} AS reason FROM documents)
  UNION ALL SELECT source, 'symbol', concat('sym_', substr(sha256(text), 1, 12)), reason, {_TEXT}, concat('sym:sym_', substr(sha256(text), 1, 12)), NULL FROM (SELECT *, {_PICK} AS reason FROM documents)
  UNION ALL SELECT d.source, 'unresolved_call', concat('d', d.doc_id, ' -> f', d.doc_id % 17), 'UNRESOLVED', NULL, NULL, NULL FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1
  UNION ALL SELECT d.source, 'parser_fallback', concat(d.source, '/', d.doc_id), 'PARSER_FALLBACK', NULL, NULL, 0.5::DOUBLE + greatest(0.0::DOUBLE, 0.3::DOUBLE - (d.doc_id % 5) * 0.1::DOUBLE) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0
  UNION ALL SELECT d.source, 'low_confidence', concat('d', d.doc_id), 'LOW_CONFIDENCE', 'effects', NULL, 0.25::DOUBLE + 0.5::DOUBLE * l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE 0.25::DOUBLE + 0.5::DOUBLE * l.quality < 0.7
),
manifests AS (SELECT source AS manifest_id, CAST(20000 AS BIGINT) AS token_budget, sum(n_chars) AS packet_tokens, CAST(substr(source, 4) AS BIGINT) % 3 <> 0 AS target_covered, CAST(substr(source, 4) AS BIGINT) % 2 = 0 AS entrypoints_covered FROM documents GROUP BY source),
counts AS (SELECT m.*, count(*) FILTER (WHERE i.kind = 'unresolved_call') AS unresolved, count(*) FILTER (WHERE i.kind = 'parser_fallback') AS fallbacks, count(*) FILTER (WHERE i.kind = 'symbol') AS symbols, count(*) FILTER (WHERE i.kind = 'file') AS files
  FROM manifests m LEFT JOIN items i ON i.manifest_id = m.manifest_id GROUP BY ALL),
final AS (SELECT *, CASE WHEN NOT target_covered AND NOT entrypoints_covered THEN 'critical' WHEN NOT target_covered THEN 'high' WHEN unresolved > 10 THEN 'medium' ELSE 'low' END AS risk, NOT target_covered OR unresolved > 0 OR fallbacks > 0 AS requires_expansion,
  packet_tokens > token_budget AND token_budget > 0 AS budget_exceeded FROM counts)
"""


def parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("manifest_id", F.col("source"))
    reason = F.element_at(F.array(*[F.lit(x) for x in _REASONS]), (F.col("doc_id") % 14 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "doc_id")
    rated = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")  # toxic ones stand for unresolved calls, poor ones for fallbacks
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.lit(0.25) + F.lit(0.5) * F.col("quality")).alias("confidence"))
    name = F.concat(F.lit("d"), "doc_id")
    return {
        "files": loss.excluded_files(d.select("manifest_id", path.alias("path"), reason.alias("reason"), F.when(F.col("doc_id") % 2 == 0, "by hand").otherwise("").alias("detail"))),
        "symbols": loss.excluded_symbols(d.select("manifest_id", F.concat(F.lit("sym_"), identity.file_revision(F.col("text"))).alias("symbol_id"), reason.alias("reason"), F.lit("").alias("detail"))),
        "calls": loss.unresolved_calls(rated.filter("toxic = 1").select("manifest_id", name.alias("caller"), F.concat(F.lit("f"), F.col("doc_id") % 17).alias("target"))),
        "fallbacks": loss.parser_fallbacks(rated.filter("quality = 0").select("manifest_id", path.alias("path"), (F.col("doc_id") % 5).alias("errors"))),
        "unsure": loss.low_confidence(d.join(labels, "doc_id").select("manifest_id", name.alias("symbol_id"), F.lit("effects").alias("field"), "confidence")),
    }


def items(spark, sf_dir):
    return reduce(DataFrame.unionByName, parts(spark, sf_dir).values())


def final(spark, sf_dir):
    n = F.substring("source", 4, 10).cast("long")
    m = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("packet_tokens"))
    m = m.select(F.col("source").alias("manifest_id"), F.lit(20000).cast("long").alias("token_budget"), "packet_tokens", (n % 3 != 0).alias("target_covered"), (n % 2 == 0).alias("entrypoints_covered"))
    return loss.finalized(m, items(spark, sf_dir))


@query("loss_items", f"WITH {ITEMS} SELECT * FROM items")
def loss_items(spark, sf_dir):
    return items(spark, sf_dir)


@query("loss_low_confidence", f"WITH {ITEMS} SELECT * FROM items WHERE kind = 'low_confidence'")
def loss_low_confidence(spark, sf_dir):
    return parts(spark, sf_dir)["unsure"]


@query("fallback_confidence", f"WITH {ITEMS} SELECT item, confidence FROM items WHERE kind = 'parser_fallback'")
def fallback_confidence(spark, sf_dir):
    return parts(spark, sf_dir)["fallbacks"].select("item", "confidence")


@query("reason_text", f"SELECT doc_id, reason, {_TEXT} AS description FROM (SELECT doc_id, CASE WHEN doc_id % 15 = 14 THEN 'OTHER' ELSE list_extract({_REASONS}, CAST(1 + doc_id % 15 AS INTEGER)) END AS reason FROM documents)")
def reason_text(spark, sf_dir):
    reason = F.element_at(F.array(*[F.lit(x) for x in (*_REASONS, "OTHER")]), (F.col("doc_id") % 15 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason")).withColumn("description", loss.description(F.col("reason")))


@query(
    "expansion_hint",
    f"""WITH {ITEMS} SELECT manifest_id, CASE WHEN requires_expansion THEN concat('requires_expansion: ', array_to_string([x FOR x IN [CASE WHEN NOT target_covered THEN 'target symbols not covered' END, CASE WHEN unresolved > 0 THEN concat(unresolved, ' unresolved') END,
      CASE WHEN fallbacks > 0 THEN concat(fallbacks, ' fallbacks') END] IF x IS NOT NULL], ', '), '. Use context.expand.') ELSE '' END AS expansion_hint FROM final""",
)
def expansion_hint(spark, sf_dir):
    return final(spark, sf_dir).select("manifest_id", "expansion_hint")


@query("loss_finalize", f"WITH {ITEMS} SELECT manifest_id, CAST(packet_tokens AS BIGINT) AS packet_tokens, unresolved, fallbacks, symbols, files, risk, requires_expansion, budget_exceeded FROM final")
def loss_finalize(spark, sf_dir):
    return final(spark, sf_dir).select("manifest_id", "packet_tokens", "unresolved", "fallbacks", "symbols", "files", "risk", "requires_expansion", "budget_exceeded")
