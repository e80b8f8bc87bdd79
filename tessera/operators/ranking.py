"""Value-per-token ranking: relevance, impact and uncertainty over cost, as columns, and the order they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up

# Fixed values.
EXCLUDE = ("TOKEN_BUDGET", "LOW_RELEVANCE", "LOW_CONFIDENCE")
DEFAULT_CONFIDENCE = 0.85


def keyword_hits(keywords: list[str], name: Column, signature: Column) -> Column:
    """How many keywords occur in a symbol's name or signature, in any case."""
    n, s = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(signature, F.lit("")))
    out = F.lit(0)
    for k in keywords:
        out = out + F.when(n.contains(k.lower()) | s.contains(k.lower()), 1).otherwise(0)
    return out


def relevance(keywords: list[str], name: Column, signature: Column) -> Column:
    if not keywords:
        return F.lit(0.5)
    return F.lit(0.3) + F.least(F.lit(0.7), keyword_hits(keywords, name, signature) / F.lit(float(len(keywords))))


def distance_factor(distance: Column) -> Column:
    """Penalty by the distance to the nearest focus; at most 10 counts."""
    return F.greatest(F.lit(0.2), F.lit(1.0) - F.least(distance, F.lit(10)) * 0.15)


def impact(callers: Column, callees: Column) -> Column:
    """From the numbers of callers and callees."""
    edges = F.coalesce(callers, F.lit(0)) + F.coalesce(callees, F.lit(0))
    return F.when(edges > 0, F.lit(0.3) + F.least(F.lit(0.7), edges / F.lit(20.0))).otherwise(F.lit(0.5))


def uncertainty(confidence: Column) -> Column:
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE)))


def score(relevance_: Column, impact_: Column, uncertainty_: Column, tokens: Column) -> Column:
    return (relevance_ * 0.4 + impact_ * 0.3 + uncertainty_ * 0.3) / F.greatest(F.lit(1.0), tokens / F.lit(100.0))


def exclude_reason(tokens: Column, score_: Column, confidence: Column, max_tokens: int = 2000, relevance_floor: float = 0.05, confidence_floor: float = 0.3) -> Column:
    """Why a candidate should not be in, the first that holds; null if none."""
    sure = F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE))
    return F.when(tokens > max_tokens, EXCLUDE[0]).when(score_ < relevance_floor, EXCLUDE[1]).when(sure < confidence_floor, EXCLUDE[2])


def scored(candidates: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Candidates (qualified_name, signature, callers, callees, confidence, tokens, perhaps distance) with their score."""
    rel = relevance(keywords or [], F.col("qualified_name"), F.col("signature"))
    if "distance" in candidates.columns:
        rel = rel * distance_factor(F.col("distance"))
    out = candidates.withColumns({"relevance": rel, "impact": impact(F.col("callers"), F.col("callees")), "uncertainty": uncertainty(F.col("confidence"))})
    out = out.withColumn("score", score(F.col("relevance"), F.col("impact"), F.col("uncertainty"), F.col("tokens")))
    return out.withColumn("exclude_reason", exclude_reason(F.col("tokens"), F.col("score"), F.col("confidence")))


def ranked(candidates: DataFrame, group: list[str]) -> DataFrame:
    """1-based rank in each group by falling score; ties keep the input's order (input_ord)."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "input_ord")))


def shown(candidates: DataFrame) -> DataFrame:
    """Parts of the score rounded to two digits, as they are reported."""
    return candidates.withColumns({c: round_half_up(F.col(c)) for c in ("relevance", "impact", "uncertainty")})


def session_handles(registrations: DataFrame) -> DataFrame:
    """Short handles (session, symbol_id, qualified_name, ord) -> one handle a symbol of a session.

    The first symbol with a short name gets ``@name``; later ones ``@S1``, ``@S2``, ... in order.
    """
    first = registrations.groupBy("session", "symbol_id").agg(F.min_by("qualified_name", "ord").alias("qualified_name"), F.min("ord").alias("ord"))
    short = F.element_at(F.split("qualified_name", r"\."), -1)
    named = first.withColumn("short", F.when(short == "", F.col("qualified_name")).otherwise(short))
    place = F.row_number().over(Window.partitionBy("session", "short").orderBy("ord"))
    clash = F.col("place") > 1
    number = F.sum(clash.cast("long")).over(Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    out = named.withColumn("place", place).withColumn("number", number)
    handle = F.when(clash, F.concat(F.lit("@S"), F.col("number").cast("string"))).otherwise(F.concat(F.lit("@"), F.col("short")))
    return out.select("session", "symbol_id", "qualified_name", "ord", handle.alias("handle"))


def alias_map(handles: DataFrame, file: Column) -> DataFrame:
    """One map of handles to ``file#qualified name`` a session."""
    entry = F.struct("handle", F.concat(file, F.lit("#"), F.col("qualified_name")))
    return handles.groupBy("session").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("aliases"))
