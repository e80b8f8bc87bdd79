"""Loss manifests: what a packet leaves out, as one long table of items and one row a manifest."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity

# Reasons with their descriptions.
REASONS = {
    "TOKEN_BUDGET": "Excluded to stay within token budget",
    "LOW_RELEVANCE": "Ranked below relevance threshold",
    "GENERATED_FILE": "Generated artifact",
    "BINARY": "Binary file",
    "SECRET": "Contains credentials",
    "DYNAMIC_EDGE": "Dynamic import/call",
    "PARSE_FAILURE": "Parse failed",
    "DUPLICATE": "Duplicate symbol",
    "EXTERNAL_DEPENDENCY": "External dependency",
    "USER_EXCLUDED": "User configuration",
    "PARSER_FALLBACK": "Lower-confidence parser",
    "LOW_CONFIDENCE": "Below confidence threshold",
    "TRUNCATED": "Content truncated",
    "REDACTED": "Security redaction",
}
THRESHOLD = 0.7

ITEM = ("manifest_id", "kind", "item", "reason", "detail", "retrieval_id", "confidence")


def description(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(REASONS.items())])
    return F.coalesce(F.try_element_at(table, reason), reason)


def fallback_confidence(errors: Column) -> Column:
    """Confidence of a fallback parser by its number of syntax errors."""
    return F.lit(0.5) + F.greatest(F.lit(0.0), F.lit(0.3) - errors * 0.1)


def _items(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    typed = {"confidence": "double"}
    return df.select("manifest_id", F.lit(kind).alias("kind"), *[cols.get(c, F.lit(None)).cast(typed.get(c, "string")).alias(c) for c in ITEM[2:]])


def _detail() -> Column:
    return F.coalesce(F.nullif(F.col("detail"), F.lit("")), description(F.col("reason")))


def excluded_files(df: DataFrame) -> DataFrame:
    """Items of (manifest_id, path, reason, detail)."""
    return _items(df, "file", item=F.col("path"), reason=F.col("reason"), detail=_detail(), retrieval_id=identity.file_retrieval_id(F.col("path")))


def excluded_symbols(df: DataFrame) -> DataFrame:
    """Items of (manifest_id, symbol_id, reason, detail)."""
    return _items(df, "symbol", item=F.col("symbol_id"), reason=F.col("reason"), detail=_detail(), retrieval_id=identity.symbol_retrieval_id(F.col("symbol_id")))


def unresolved_calls(df: DataFrame) -> DataFrame:
    """Items of (manifest_id, caller, target)."""
    return _items(df, "unresolved_call", item=F.concat("caller", F.lit(" -> "), "target"), reason=F.lit("UNRESOLVED"))


def parser_fallbacks(df: DataFrame) -> DataFrame:
    """Items of (manifest_id, path, errors)."""
    return _items(df, "parser_fallback", item=F.col("path"), reason=F.lit("PARSER_FALLBACK"), confidence=fallback_confidence(F.col("errors")))


def low_confidence(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Items of (manifest_id, symbol_id, field, confidence) below the threshold."""
    return _items(df.filter(F.col("confidence") < threshold), "low_confidence", item=F.col("symbol_id"), reason=F.lit("LOW_CONFIDENCE"), detail=F.col("field"), confidence=F.col("confidence"))


def risk(target: Column, entrypoints: Column, unresolved: Column) -> Column:
    return F.when(~target & ~entrypoints, "critical").when(~target, "high").when(unresolved > 10, "medium").otherwise("low")


def needs_expansion(target: Column, unresolved: Column, fallbacks: Column) -> Column:
    return ~target | (unresolved > 0) | (fallbacks > 0)


def expansion_hint(target: Column, unresolved: Column, fallbacks: Column) -> Column:
    """Text that says why a packet should be expanded; empty if it need not."""
    reasons = F.concat_ws(
        ", ", F.when(~target, "target symbols not covered"), F.when(unresolved > 0, F.concat(unresolved.cast("string"), F.lit(" unresolved"))), F.when(fallbacks > 0, F.concat(fallbacks.cast("string"), F.lit(" fallbacks")))
    )
    return F.when(needs_expansion(target, unresolved, fallbacks), F.concat(F.lit("requires_expansion: "), reasons, F.lit(". Use context.expand."))).otherwise("")


def finalized(manifests: DataFrame, items: DataFrame) -> DataFrame:
    """Manifests (manifest_id, token_budget, packet_tokens, target_covered, entrypoints_covered) with counts, risk and hint."""
    count = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    counts = items.groupBy("manifest_id").agg(count("unresolved_call", "unresolved"), count("parser_fallback", "fallbacks"), count("symbol", "symbols"), count("file", "files"))
    out = manifests.join(counts, "manifest_id", "left").na.fill(0, ["unresolved", "fallbacks", "symbols", "files"])
    t, e, u, f = F.col("target_covered"), F.col("entrypoints_covered"), F.col("unresolved"), F.col("fallbacks")
    over = (F.col("packet_tokens") > F.col("token_budget")) & (F.col("token_budget") > 0)
    return out.withColumns({"risk": risk(t, e, u), "requires_expansion": needs_expansion(t, u, f), "budget_exceeded": over, "expansion_hint": expansion_hint(t, u, f)})
