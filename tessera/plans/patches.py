"""Patches over conversations: a conversation is a file of lines, its turns are edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import patches
from ..registry import query
from .identity import table

BASE = """
edits AS (SELECT CAST(conv_id AS VARCHAR) AS patch_id, CAST(turn AS BIGINT) AS ord, ['replace_symbol', 'insert_before', 'insert_after', 'other'][CAST(1 + (conv_id + turn) % CASE WHEN conv_id % 9 = 0 THEN 4 ELSE 3 END AS INTEGER)] AS operation, concat('@s', turn % 6) AS symbol,
  CASE WHEN turn % 5 = 4 THEN NULL ELSE 1 + turn * 2 % 7 END AS start_line, 2 + turn * 2 % 7 + conv_id % 2 AS end_line, concat('new ', turn) AS code, concat('f', conv_id % 3) AS target_file FROM conversations),
syms AS (SELECT concat('@s', k) AS key, 1 + k AS s, 2 + k AS t, concat('f', k % 3) AS file FROM range(5) r(k)),
resolved AS (SELECT e.* EXCLUDE (start_line, end_line), CASE WHEN operation = 'replace_symbol' THEN COALESCE(s.s, e.start_line) ELSE e.start_line END AS start_line, CASE WHEN operation = 'replace_symbol' THEN COALESCE(s.t, e.end_line) ELSE e.end_line END AS end_line,
  CASE WHEN operation = 'replace_symbol' AND s.key IS NULL THEN concat('UNKNOWN_SYMBOL: ', symbol) WHEN operation = 'replace_symbol' AND s.file <> e.target_file THEN concat('CROSS_FILE_EDIT: ', symbol, ' in ', s.file) END AS error FROM edits e LEFT JOIN syms s ON s.key = e.symbol)
"""
WITH = f"WITH {BASE}"


def edits(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS patch_id", "turn AS ord", "element_at(array('replace_symbol', 'insert_before', 'insert_after', 'other'), CAST(1 + (conv_id + turn) % CASE WHEN conv_id % 9 = 0 THEN 4 ELSE 3 END AS INT)) AS operation",
        "concat('@s', turn % 6) AS symbol", "CASE WHEN turn % 5 = 4 THEN NULL ELSE 1 + turn * 2 % 7 END AS start_line", "2 + turn * 2 % 7 + conv_id % 2 AS end_line", "concat('new ', turn) AS code", "concat('f', conv_id % 3) AS target_file",
    )


def resolved(spark, sf_dir):
    syms = spark.range(5).selectExpr("concat('@s', id) AS key", "1 + id AS start", "2 + id AS end", "concat('f', id % 3) AS file")
    return patches.resolve_edits(edits(spark, sf_dir), syms)


@query("edit_resolve", f"{WITH} SELECT patch_id, ord, operation, start_line, end_line, error FROM resolved")
def edit_resolve(spark, sf_dir):
    return resolved(spark, sf_dir).select("patch_id", "ord", "operation", "start_line", "end_line", "error")


@query("edit_order", f"{WITH} SELECT patch_id, array_to_string(list(ord ORDER BY COALESCE(start_line, 0) DESC, ord), ',') AS ords FROM edits GROUP BY patch_id")
def edit_order(spark, sf_dir):
    out = patches.bottom_up(edits(spark, sf_dir))
    return out.select("patch_id", F.array_join(F.transform("edits", lambda e: e["ord"].cast("string")), ",").alias("ords"))


@query("edit_overlap", f"{WITH} SELECT x.patch_id, x.ord AS a, y.ord AS b FROM edits x JOIN edits y ON y.patch_id = x.patch_id AND x.ord < y.ord AND x.start_line <= y.end_line AND y.start_line <= x.end_line WHERE x.start_line > 0 AND y.start_line > 0")
def edit_overlap(spark, sf_dir):
    return patches.overlapping(edits(spark, sf_dir))


_LINES = "list_concat([concat('line ', conv_id)], ['b', 'c', 'd', 'e', 'f', 'g'])"
SPLICE = f"""{WITH}, src AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS patch_id, {_LINES} AS lines FROM conversations),
todo AS (SELECT patch_id, list({{'lines': CAST([] AS VARCHAR[]), 'ok': true, 'op': operation, 's': start_line, 't': end_line, 'code': code}} ORDER BY COALESCE(start_line, 0) DESC, ord) AS l FROM edits GROUP BY patch_id),
folded AS (SELECT s.patch_id, list_reduce(list_prepend({{'lines': s.lines, 'ok': true, 'op': '', 's': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT), 'code': ''}}, t.l), lambda a, x: {{
  'lines': CASE WHEN x.op = 'replace_symbol' AND x.s > 0 AND x.t > 0 THEN list_concat(a.lines[1:least(x.s - 1, len(a.lines))], [x.code], a.lines[least(x.s - 1, len(a.lines)) + greatest(x.t - x.s + 1, 0) + 1:len(a.lines)])
    WHEN x.op = 'insert_before' AND x.s > 0 THEN list_concat(a.lines[1:least(x.s - 1, len(a.lines))], [x.code], a.lines[least(x.s - 1, len(a.lines)) + 1:len(a.lines)])
    WHEN x.op = 'insert_after' AND x.t > 0 THEN list_concat(a.lines[1:least(x.t, len(a.lines))], [x.code], a.lines[least(x.t, len(a.lines)) + 1:len(a.lines)]) ELSE a.lines END,
  'ok': a.ok AND ((x.op = 'replace_symbol' AND COALESCE(x.s, 0) > 0 AND COALESCE(x.t, 0) > 0) OR (x.op = 'insert_before' AND COALESCE(x.s, 0) > 0) OR (x.op = 'insert_after' AND COALESCE(x.t, 0) > 0)), 'op': x.op, 's': x.s, 't': x.t, 'code': x.code}}) AS r
  FROM src s JOIN todo t ON t.patch_id = s.patch_id)"""


def sources(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("patch_id"), F.concat(F.lit("line "), "conv_id", F.lit("\nb\nc\nd\ne\nf\ng")).alias("code"))
    return c.distinct()


@query("splice_lines", f"{SPLICE} SELECT patch_id, array_to_string(r.lines, chr(10)) AS code_after, r.ok AS ok FROM folded")
def splice_lines(spark, sf_dir):
    return patches.applied(sources(spark, sf_dir), edits(spark, sf_dir))


_STEP = "list_extract(['path_check', 'hash_check', 'sandbox_create', 'apply_edits', 'parse', 'typecheck', 'lint', 'tests'], CAST(1 + turn % 8 AS INTEGER))"
STEPS = f"steps AS (SELECT CAST(conv_id AS VARCHAR) AS patch_id, {_STEP} AS step, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'failed' WHEN (conv_id + turn) % 7 = 0 THEN 'skipped' ELSE 'passed' END AS status, turn * 3 AS duration_ms FROM conversations)"


def steps(spark, sf_dir):
    step = F.element_at(F.array(*[F.lit(x) for x in patches.STEPS]), (F.col("turn") % 8 + 1).cast("int"))
    n = F.col("conv_id") + F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("patch_id"), step.alias("step"), F.when(n % 13 == 0, "failed").when(n % 7 == 0, "skipped").otherwise("passed").alias("status"), (F.col("turn") * 3).alias("duration_ms"))


@query(
    "validation_state",
    f"""WITH {STEPS}, s AS (SELECT patch_id, count(*) AS steps, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE step IN ('parse', 'typecheck', 'lint', 'tests') AND status = 'failed') AS failed,
      count(*) FILTER (WHERE step IN ('parse', 'typecheck', 'lint', 'tests') AND status = 'skipped') AS skipped FROM steps GROUP BY patch_id)
      SELECT *, CASE WHEN failed > 0 THEN 'invalid' WHEN skipped > 0 THEN 'inconclusive' ELSE 'valid' END AS state, failed = 0 AND skipped = 0 AS patch_ready FROM s""",
)
def validation_state(spark, sf_dir):
    return patches.validation_state(steps(spark, sf_dir))


@query("validation_summary", f"WITH {STEPS} SELECT patch_id, count(*) AS steps, count(*) FILTER (WHERE status = 'passed') AS passed, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM steps GROUP BY patch_id")
def validation_summary(spark, sf_dir):
    return patches.summary(steps(spark, sf_dir))


@query(
    "propose",
    f"""{WITH}, p AS (SELECT patch_id, concat('c', CAST(patch_id AS BIGINT) % 10) AS context_id, concat('[', string_agg(concat('{{"ord":', ord, ',"operation":"', operation, CASE WHEN start_line IS NULL THEN '"' ELSE concat('","start_line":', start_line) END, ',"end_line":', end_line, ',"code":"', code, '"}}'), ',' ORDER BY ord), ']') AS j,
      arg_min(error, ord) FILTER (WHERE error IS NOT NULL) AS first_error FROM resolved GROUP BY patch_id)
      SELECT patch_id, context_id, substr(sha256(j), 1, 12) AS edits_hash, CASE WHEN CAST(patch_id AS BIGINT) % 10 = 9 THEN concat('Context: ', context_id) WHEN first_error IS NOT NULL THEN first_error WHEN CAST(patch_id AS BIGINT) % 10 = 8 THEN 'CONTEXT_HAS_NO_REPOSITORY_ID'
        WHEN CAST(patch_id AS BIGINT) % 10 = 7 THEN 'PATCH_REPOSITORY_MISMATCH' END AS error FROM p""",
)
def propose(spark, sf_dir):
    contexts = spark.range(9).selectExpr("concat('c', id) AS context_id", "1 AS revision", "CASE WHEN id = 8 THEN '' ELSE 'repo' END AS repository_id", "'/r' AS root", "CASE WHEN id = 7 THEN '/x/f' ELSE '/r/f' END AS file", "'rev' AS file_revision")
    e = resolved(spark, sf_dir).withColumn("context_id", F.concat(F.lit("c"), F.col("patch_id").cast("long") % 10))
    return patches.propose(e, contexts).select("patch_id", "context_id", "edits_hash", "error")


@query(
    "validate_decision",
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'UNKNOWN_PATCH_ID' WHEN 1 THEN 'CONTEXT_EXPIRED' WHEN 2 THEN 'STALE_CONTEXT' WHEN 3 THEN 'PATCH_TAMPERED' WHEN 4 THEN 'PATCH_REPOSITORY_MISMATCH' WHEN 5 THEN 'PATCH_REPOSITORY_MISMATCH' WHEN 6 THEN 'STALE_FILE_SINCE_CONTEXT' END AS decision FROM documents""",
)
def validate_decision(spark, sf_dir):
    k, rev = F.col("doc_id") % 8, identity.file_revision(F.col("text"))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", (k != 0).alias("known"), F.lit(1).alias("context_revision"), F.when(k != 1, F.when(k == 2, 2).otherwise(1)).alias("current_revision"), rev.alias("edits_hash"), F.when(k == 3, F.lit("x")).otherwise(rev).alias("current_hash"), F.lit("/r").alias("root"),
        F.when(k == 4, "/s").otherwise("/r").alias("current_root"), F.when(k == 5, "/rr/f").otherwise("/r/f").alias("file"), rev.alias("expected_file"), F.when(k == 6, F.lit("x")).otherwise(rev).alias("current_file"),
    )
    return d.select("doc_id", patches.decision().alias("decision"))


@query(
    "apply_decision",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Patch not validated' WHEN 1 THEN 'PATH_OUTSIDE_ROOT' WHEN 2 THEN 'STALE_FILE_AT_APPLY' WHEN 3 THEN 'Sandbox missing' WHEN 4 THEN 'SANDBOX_CHANGED_AFTER_VALIDATION' END AS decision FROM documents""",
)
def apply_decision(spark, sf_dir):
    k, rev = F.col("doc_id") % 6, identity.file_revision(F.col("text"))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k == 0, "inconclusive").otherwise("valid").alias("status"), F.lit("/r").alias("root"), F.when(k == 1, "/x").otherwise("/r/f").alias("file"), rev.alias("original_revision"), F.when(k == 2, F.lit("x")).otherwise(rev).alias("current_revision"),
        F.when(k == 4, F.lit("y")).when(k != 3, rev).alias("sandbox_revision"), rev.alias("validated_revision"),
    )
    return d.select("doc_id", patches.apply_decision().alias("decision"))


PIPE = f"""{SPLICE}, m AS (SELECT DISTINCT x.patch_id FROM edits x JOIN edits y ON y.patch_id = x.patch_id AND x.ord < y.ord AND x.start_line <= y.end_line AND y.start_line <= x.end_line WHERE x.start_line > 0 AND y.start_line > 0),
j AS (SELECT f.patch_id, CAST(f.patch_id AS BIGINT) AS n, array_to_string(f.r.lines, chr(10)) AS after, f.r.ok AS ok, m.patch_id IS NOT NULL AS meets FROM folded f LEFT JOIN m ON m.patch_id = f.patch_id),
k AS (SELECT *, CASE WHEN n % 17 = 0 THEN 'PATH_OUTSIDE_ROOT' WHEN n % 13 = 0 THEN 'STALE_FILE' WHEN meets THEN 'OVERLAPPING_EDITS' WHEN NOT ok THEN 'EDIT_FAILED' WHEN n % 11 = 0 THEN 'PARSE_ERROR' WHEN n % 7 = 0 THEN 'TEST_FAILURE' END AS failure FROM j)"""


@query("validate_pipeline", f"{PIPE} SELECT patch_id, CASE WHEN failure IS NOT NULL THEN 'invalid' WHEN n % 5 = 0 THEN 'inconclusive' ELSE 'valid' END AS status, failure, CASE WHEN failure IS NULL THEN substr(sha256(after), 1, 12) END AS patched_revision FROM k")
def validate_pipeline(spark, sf_dir):
    n = F.col("patch_id").cast("long")
    rev = F.when(n % 13 == 0, "x").otherwise(identity.file_revision(F.col("code")))
    p = sources(spark, sf_dir).select("patch_id", F.lit("/r").alias("root"), F.when(n % 17 == 0, "/q/f").otherwise("/r/f").alias("file"), "code", rev.alias("expected_revision"))
    tools = p.select("patch_id", F.when(n % 11 == 0, "failed").otherwise("passed").alias("parse"), F.when(n % 5 == 0, "skipped").otherwise("passed").alias("typecheck"), F.lit("passed").alias("lint"), F.when(n % 7 == 0, "failed").otherwise("passed").alias("tests"))
    return patches.validate(p, edits(spark, sf_dir), tools)


@query("patch_failures", f"{PIPE} SELECT failure, count(*) AS patches FROM k WHERE failure IS NOT NULL GROUP BY failure")
def patch_failures(spark, sf_dir):
    return validate_pipeline(spark, sf_dir).filter("failure is not null").groupBy("failure").agg(F.count("*").alias("patches"))
