"""Scores and ranks of documents taken as candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..registry import query
from .identity import table

KEYWORDS = ["src1", "DE", "7"]

CANDIDATES = """
cand AS (SELECT d.doc_id, d.source, concat(d.source, '.d', d.doc_id) AS qualified_name, concat(d.lang, '(', d.n_chars, ')') AS signature, d.doc_id % 13 AS callers, d.doc_id % 5 AS callees,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE 0.25 + 0.5 * l.quality END::DOUBLE AS confidence, d.doc_id % 12 AS distance, CAST(20 + ceil(length(d.text) * 0.40::DOUBLE) AS BIGINT) AS tokens, d.doc_id AS input_ord
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
parts AS (SELECT *, CAST(CASE WHEN contains(lower(qualified_name), 'src1') OR contains(lower(signature), 'src1') THEN 1 ELSE 0 END + CASE WHEN contains(lower(qualified_name), 'de') OR contains(lower(signature), 'de') THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(qualified_name), '7') OR contains(lower(signature), '7') THEN 1 ELSE 0 END AS INTEGER) AS hits FROM cand),
rel AS (SELECT *, 0.3::DOUBLE + least(0.7::DOUBLE, hits / 3.0::DOUBLE) AS relevance, greatest(0.2::DOUBLE, 1.0::DOUBLE - least(distance, 10) * 0.15::DOUBLE) AS factor,
  CASE WHEN callers + callees > 0 THEN 0.3::DOUBLE + least(0.7::DOUBLE, (callers + callees) / 20.0::DOUBLE) ELSE 0.5::DOUBLE END AS impact, greatest(0.1::DOUBLE, 1.0::DOUBLE - COALESCE(confidence, 0.85::DOUBLE)) AS uncertainty FROM parts),
scored AS (SELECT *, (relevance * factor * 0.4::DOUBLE + impact * 0.3::DOUBLE + uncertainty * 0.3::DOUBLE) / greatest(1.0::DOUBLE, tokens / 100.0::DOUBLE) AS score FROM rel)
"""
WITH = f"WITH {CANDIDATES}"


def candidates(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cost = F.lit(20) + F.ceil(F.length("text") * 0.40)
    out = d.join(labels.select("doc_id", (F.lit(0.25) + F.col("quality") * 0.5).alias("confidence")), "doc_id", "left")
    return out.select(
        "doc_id", "source", F.concat("source", F.lit(".d"), "doc_id").alias("qualified_name"), F.concat("lang", F.lit("("), "n_chars", F.lit(")")).alias("signature"), (F.col("doc_id") % 13).alias("callers"), (F.col("doc_id") % 5).alias("callees"),
        "confidence", (F.col("doc_id") % 12).alias("distance"), cost.cast("long").alias("tokens"), F.col("doc_id").alias("input_ord"),
    )


@query("keyword_hits", f"{WITH} SELECT doc_id, hits FROM parts")
def keyword_hits(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", ranking.keyword_hits(KEYWORDS, F.col("qualified_name"), F.col("signature")).cast("int").alias("hits"))


@query("keyword_relevance", f"{WITH} SELECT doc_id, relevance FROM rel")
def keyword_relevance(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", ranking.relevance(KEYWORDS, F.col("qualified_name"), F.col("signature")).alias("relevance"))


@query("distance_penalty", f"{WITH} SELECT doc_id, distance, factor FROM rel")
def distance_penalty(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", "distance", ranking.distance_factor(F.col("distance")).alias("factor"))


@query("impact", f"{WITH} SELECT doc_id, impact FROM rel")
def impact(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", ranking.impact(F.col("callers"), F.col("callees")).alias("impact"))


@query("uncertainty", f"{WITH} SELECT doc_id, uncertainty FROM rel")
def uncertainty(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", ranking.uncertainty(F.col("confidence")).alias("uncertainty"))


@query("rank_score", f"{WITH} SELECT doc_id, floor(score * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS score, floor(relevance * factor * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS relevance, floor(impact * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS impact, floor(uncertainty * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS uncertainty FROM scored")
def rank_score(spark, sf_dir):
    out = ranking.shown(ranking.scored(candidates(spark, sf_dir), KEYWORDS))
    return out.select("doc_id", ranking.round_half_up(F.col("score"), 6).alias("score"), "relevance", "impact", "uncertainty")


@query("rank_exclude", f"{WITH} SELECT doc_id, CASE WHEN tokens > 2000 THEN 'TOKEN_BUDGET' WHEN score < 0.05 THEN 'LOW_RELEVANCE' WHEN COALESCE(confidence, 0.85) < 0.3 THEN 'LOW_CONFIDENCE' END AS exclude_reason FROM scored")
def rank_exclude(spark, sf_dir):
    return ranking.scored(candidates(spark, sf_dir), KEYWORDS).select("doc_id", "exclude_reason")


@query("final_rank", f"{WITH} SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, input_ord) AS INTEGER) AS rank FROM scored")
def final_rank(spark, sf_dir):
    return ranking.ranked(ranking.scored(candidates(spark, sf_dir), KEYWORDS), ["source"]).select("doc_id", "source", "rank")


@query(
    "handles",
    """WITH r AS (SELECT concat('c', conv_id % 40) AS session, concat('s', conv_id % 7, '_', turn % 9) AS symbol_id, concat('K', conv_id % 7, '.m', turn % 3) AS qualified_name, conv_id * 1000 + turn AS ord FROM conversations),
      f AS (SELECT session, symbol_id, arg_min(qualified_name, ord) AS qualified_name, min(ord) AS ord FROM r GROUP BY ALL), n AS (SELECT *, string_split(qualified_name, '.')[-1] AS short FROM f),
      p AS (SELECT *, row_number() OVER (PARTITION BY session, short ORDER BY ord) AS place FROM n),
      q AS (SELECT *, sum(CASE WHEN place > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ord) AS number FROM p)
      SELECT session, symbol_id, qualified_name, ord, CASE WHEN place > 1 THEN concat('@S', CAST(number AS BIGINT)) ELSE concat('@', short) END AS handle FROM q""",
)
def handles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = c.selectExpr("concat('c', conv_id % 40) AS session", "concat('s', conv_id % 7, '_', turn % 9) AS symbol_id", "concat('K', conv_id % 7, '.m', turn % 3) AS qualified_name", "conv_id * 1000 + turn AS ord")
    return ranking.session_handles(r)


