"""Token estimates and budgets over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..registry import query
from .identity import table

U16 = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g')))"
_KINDS = "['text', 'code', 'json', 'tool_schema', 'diagnostic', 'other'][CAST(1 + doc_id % 6 AS INT)]"
_RATIO = "CASE doc_id % 6 WHEN 0 THEN 0.75 WHEN 1 THEN 0.40 WHEN 2 THEN 0.55 WHEN 3 THEN 0.60 WHEN 4 THEN 0.65 END::DOUBLE"


def kind():
    return F.element_at(F.array(*[F.lit(x) for x in ("text", "code", "json", "tool_schema", "diagnostic", "other")]), (F.col("doc_id") % 6 + 1).cast("int"))


@query("token_est_packet", f"SELECT doc_id, {_KINDS} AS kind, CAST(COALESCE(greatest(1, ceil({U16.format('text')} * {_RATIO})), 1) AS BIGINT) AS tokens FROM documents")
def token_est_packet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", kind().alias("kind"), tokens.packet_tokens(F.col("text"), kind()).alias("tokens"))


@query("token_est_server", f"SELECT doc_id, {_KINDS} AS kind, CAST(ceil({U16.format('text')} * COALESCE({_RATIO}, 0.70::DOUBLE)) AS BIGINT) AS tokens FROM documents")
def token_est_server(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", kind().alias("kind"), tokens.server_tokens(F.col("text"), kind()).alias("tokens"))


@query(
    "token_est_rank",
    f"""SELECT doc_id, CAST(greatest(10, 20 + ceil(length(lang) * 0.40::DOUBLE) + ceil({U16.format('text')} * 0.40::DOUBLE) + ceil(CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 12 ELSE 27 END * 0.55::DOUBLE) + 5 * (doc_id % 7) + 5 * (doc_id % 2)) AS BIGINT) AS tokens FROM documents""",
)
def token_est_rank(spark, sf_dir):
    effects = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("network-read"))).otherwise(F.array(F.lit("network-write"), F.lit("process-spawn")))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.rank_tokens(F.col("lang"), F.col("text"), effects, F.col("doc_id") % 7, F.col("doc_id") % 2).alias("tokens"))


_MODEL = "CASE doc_id % 4 WHEN 0 THEN 1.25 WHEN 1 THEN 1.30 WHEN 2 THEN 1.20 ELSE 1.35 END::DOUBLE"


@query("token_est_model", f"SELECT doc_id, CAST(ceil({U16.format('text')} / {_MODEL}) AS BIGINT) AS tokens FROM documents")
def token_est_model(spark, sf_dir):
    model = F.element_at(F.array(*[F.lit(x) for x in ("deepseek-v4-pro", "gpt-5.5", "mythos-nano", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.model_tokens(F.col("text"), model).alias("tokens"))


_MODES = ("safe", "balanced", "aggressive", "other")


def modes(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(x) for x in _MODES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias("mode"), (F.col("n_chars") * 7).alias("budget"))


_MODE_SQL = "SELECT doc_id, ['safe', 'balanced', 'aggressive', 'other'][CAST(1 + doc_id % 4 AS INT)] AS mode, n_chars * 7 AS budget FROM documents"


@query(
    "packet_allocate",
    f"""SELECT doc_id, mode, CAST(trunc(budget * CASE mode WHEN 'aggressive' THEN 0.03 ELSE 0.05 END::DOUBLE) AS BIGINT) AS project,
      CAST(trunc(budget * CASE mode WHEN 'safe' THEN 0.40 WHEN 'aggressive' THEN 0.55 ELSE 0.45 END::DOUBLE) AS BIGINT) AS contracts,
      CAST(trunc(budget * CASE mode WHEN 'safe' THEN 0.45 WHEN 'aggressive' THEN 0.35 ELSE 0.40 END::DOUBLE) AS BIGINT) AS sources, CAST(budget AS BIGINT) AS total FROM ({_MODE_SQL})""",
)
def packet_allocate(spark, sf_dir):
    return modes(spark, sf_dir).select("doc_id", "mode", tokens.packet_shares(F.col("budget"), F.col("mode")).alias("s")).select("doc_id", "mode", "s.*")


_FIXED = ", ".join(f"CAST(floor(budget * {share}::DOUBLE) AS BIGINT) AS {name}" for name, share in tokens.FIXED_SHARES.items())


@query(
    "token_allocate",
    f"""WITH a AS (SELECT doc_id, mode, CAST(budget AS BIGINT) AS total, CAST(0 AS BIGINT) AS system_prompt, {_FIXED} FROM ({_MODE_SQL})),
      b AS (SELECT *, total - instructions - task - project_map - evidence - expansion_reserve - output_reserve - tool_calls AS rest FROM a)
      SELECT * EXCLUDE (rest), CAST(floor(rest * CASE mode WHEN 'safe' THEN 0.5 WHEN 'balanced' THEN 0.6 WHEN 'aggressive' THEN 0.75 ELSE 0 END::DOUBLE) AS BIGINT) AS contracts,
        CAST(floor(rest * CASE mode WHEN 'safe' THEN 0.5 WHEN 'balanced' THEN 0.4 WHEN 'aggressive' THEN 0.25 ELSE 0 END::DOUBLE) AS BIGINT) AS sources FROM b""",
)
def token_allocate(spark, sf_dir):
    return modes(spark, sf_dir).select("doc_id", "mode", tokens.full_allocation(F.col("budget"), F.col("mode")).alias("s")).select("doc_id", "mode", "s.*")
