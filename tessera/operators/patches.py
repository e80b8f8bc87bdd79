"""Patches as tables: edits resolved to lines, checked for overlap, spliced, and judged by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, paths

# Fixed values.
CRITICAL = ("parse", "typecheck", "lint", "tests")
STEPS = ("path_check", "hash_check", "sandbox_create", "apply_edits", "parse", "typecheck", "lint", "tests")


def resolve_edits(edits: DataFrame, symbols: DataFrame, target_file: str = "target_file") -> DataFrame:
    """Edits (patch_id, ord, operation, symbol, start_line, end_line, code, target_file) with the lines of their symbol and an error.

    ``symbols``: key (a handle or an id, each symbol under both), start, end, file.
    """
    out = edits.join(symbols, F.col("symbol") == F.col("key"), "left")
    replaces = F.col("operation") == "replace_symbol"
    error = F.when(replaces & F.col("key").isNull(), F.concat(F.lit("UNKNOWN_SYMBOL: "), F.coalesce("symbol", F.lit("")))).when(
        replaces & (F.col("file") != F.col(target_file)), F.concat(F.lit("CROSS_FILE_EDIT: "), F.col("symbol"), F.lit(" in "), F.col("file"))
    )
    return out.withColumns({"start_line": F.when(replaces, F.coalesce("start", "start_line")).otherwise(F.col("start_line")), "end_line": F.when(replaces, F.coalesce("end", "end_line")).otherwise(F.col("end_line")), "error": error}).drop("key", "start", "end", "file")


def bottom_up(edits: DataFrame) -> DataFrame:
    """Edits of each patch as one array, last lines first; edits without a start line come last."""
    entry = F.struct((-F.coalesce("start_line", F.lit(0))).alias("k"), "ord", "operation", "start_line", "end_line", "code")
    return edits.groupBy("patch_id").agg(F.array_sort(F.collect_list(entry)).alias("edits"))


def overlapping(edits: DataFrame) -> DataFrame:
    """Pairs (patch_id, a, b) of edits whose line ranges meet. An edit that lacks a line meets nothing.

    The range condition is part of the join on the patch, so only pairs that meet come out of it.
    """
    known = edits.filter("coalesce(start_line, 0) > 0 and coalesce(end_line, 0) > 0").select("patch_id", "ord", "start_line", "end_line")
    other = known.toDF("patch_id", "b", "b_start", "b_end")
    both = known.withColumnRenamed("ord", "a").join(other, "patch_id")
    return both.filter("a < b and start_line <= b_end and b_start <= end_line").select("patch_id", "a", "b")


def splice(lines: Column, edits: Column) -> Column:
    """struct(lines, ok): an array of lines after edits (bottom up). A line that is missing from an edit makes it fail."""
    start = F.struct(lines.alias("lines"), F.lit(True).alias("ok"))

    def cut(x: Column, first: Column, drop: Column, code: Column) -> Column:
        n = F.size(x)
        at = F.least(first - 1, n)
        return F.concat(F.slice(x, 1, at), F.array(code), F.slice(x, at + drop + 1, F.greatest(n - at - drop, F.lit(0))))

    def step(acc, e):
        has_start, has_end = F.coalesce(e["start_line"], F.lit(0)) > 0, F.coalesce(e["end_line"], F.lit(0)) > 0
        span = F.greatest(e["end_line"] - e["start_line"] + 1, F.lit(0))
        done = (
            F.when((e["operation"] == "replace_symbol") & has_start & has_end, cut(acc["lines"], e["start_line"], span, e["code"]))
            .when((e["operation"] == "insert_before") & has_start, cut(acc["lines"], e["start_line"], F.lit(0), e["code"]))
            .when((e["operation"] == "insert_after") & has_end, cut(acc["lines"], e["end_line"] + 1, F.lit(0), e["code"]))
        )
        return F.struct(F.coalesce(done, acc["lines"]).alias("lines"), (acc["ok"] & done.isNotNull()).alias("ok"))

    return F.aggregate(edits, start, step)


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files (patch_id, code) after their edits: code_after and whether every edit could be made."""
    out = files.join(bottom_up(edits), "patch_id").withColumn("s", splice(F.split("code", "\n", -1), F.col("edits")))
    return out.select("patch_id", F.array_join("s.lines", "\n").alias("code_after"), F.col("s.ok").alias("ok"))


def validation_state(steps: DataFrame) -> DataFrame:
    """State of each patch from its steps (patch_id, step, status), with counts."""
    c = F.col("step").isin(*CRITICAL)
    out = steps.groupBy("patch_id").agg(
        F.count("*").alias("steps"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(c & (F.col("status") == "failed")).alias("failed"), F.count_if(c & (F.col("status") == "skipped")).alias("skipped")
    )
    state = F.when(F.col("failed") > 0, "invalid").when(F.col("skipped") > 0, "inconclusive").otherwise("valid")
    return out.withColumn("state", state).withColumn("patch_ready", F.col("state") == "valid")


def summary(steps: DataFrame) -> DataFrame:
    """Number of steps, of passed ones, and their time (duration_ms) of each patch."""
    return steps.groupBy("patch_id").agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "passed").alias("passed"), F.sum("duration_ms").alias("duration_ms"))


def edits_hash(edits: Column) -> Column:
    """Revision of an array of edits, over their canonical JSON."""
    return identity.file_revision(F.to_json(edits))


def propose(edits: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row a patch: resolved edits in order, their hash, what they rest on, and the first error.

    ``edits``: resolved, with context_id. ``contexts``: context_id, revision, repository_id, root, file, file_revision.
    """
    entry = F.struct("ord", "operation", "start_line", "end_line", "code")
    per = edits.groupBy("patch_id", "context_id").agg(F.array_sort(F.collect_list(entry)).alias("edits"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("edit_error"))
    out = per.join(contexts, "context_id", "left")
    error = F.when(F.col("revision").isNull(), F.concat(F.lit("Context: "), "context_id")).when(F.col("edit_error").isNotNull(), F.col("edit_error")).when(F.coalesce("repository_id", F.lit("")) == "", "CONTEXT_HAS_NO_REPOSITORY_ID")
    return out.withColumns({"edits_hash": edits_hash(F.col("edits")), "error": F.when(error.isNull() & ~paths.inside(F.col("root"), F.col("file")), "PATCH_REPOSITORY_MISMATCH").otherwise(error)}).drop("edit_error")


def decision() -> Column:
    """Why a proposed patch cannot be validated, the first reason that holds; null if it can.

    Columns: known, context_revision, current_revision, edits_hash, current_hash, root, current_root, file, expected_file, current_file.
    """
    return (
        F.when(~F.col("known"), "UNKNOWN_PATCH_ID")
        .when(F.col("current_revision").isNull(), "CONTEXT_EXPIRED")
        .when(F.col("current_revision") != F.col("context_revision"), "STALE_CONTEXT")
        .when(F.col("current_hash") != F.col("edits_hash"), "PATCH_TAMPERED")
        .when((F.col("root") != F.col("current_root")) | ~paths.inside(F.col("root"), F.col("file")), "PATCH_REPOSITORY_MISMATCH")
        .when((F.coalesce("expected_file", F.lit("")) != "") & (F.col("expected_file") != F.col("current_file")), "STALE_FILE_SINCE_CONTEXT")
    )


def validate(patches: DataFrame, edits: DataFrame, tools: DataFrame) -> DataFrame:
    """Status and first failure of each patch through all steps.

    ``patches``: patch_id, root, file, code, expected_revision. ``tools``: patch_id, parse, typecheck, lint, tests (passed, failed or skipped).
    """
    done = applied(patches.select("patch_id", "code"), edits)
    meets = overlapping(edits).select("patch_id").distinct().withColumn("meets", F.lit(True))
    out = patches.join(done, "patch_id", "left").join(meets, "patch_id", "left").join(tools, "patch_id", "left")
    stale = (F.coalesce("expected_revision", F.lit("")) != "") & (F.col("expected_revision") != identity.file_revision(F.col("code")))
    names = {"parse": "PARSE_ERROR", "typecheck": "TYPE_ERROR", "lint": "LINT_ERROR", "tests": "TEST_FAILURE"}
    failure = (
        F.when(~paths.safe_patch_id(F.col("patch_id").cast("string")), "INVALID_PATCH_ID")
        .when(~paths.inside(F.col("root"), F.col("file")), "PATH_OUTSIDE_ROOT")
        .when(stale, "STALE_FILE")
        .when(F.coalesce("meets", F.lit(False)), "OVERLAPPING_EDITS")
        .when(~F.coalesce("ok", F.lit(True)), "EDIT_FAILED")
    )
    for step, name in names.items():
        failure = failure.when(F.coalesce(step, F.lit("skipped")) == "failed", name)
    skipped = F.lit(False)
    for step in names:
        skipped = skipped | (F.coalesce(step, F.lit("skipped")) == "skipped")
    out = out.withColumn("failure", failure)
    status = F.when(F.col("failure").isNotNull(), "invalid").when(skipped, "inconclusive").otherwise("valid")
    patched = F.when(F.col("failure").isNull(), identity.file_revision(F.coalesce("code_after", "code")))
    return out.select("patch_id", status.alias("status"), "failure", patched.alias("patched_revision"))


def apply_decision() -> Column:
    """Why a patch is not applied, the first reason that holds; null if it is.

    Columns: status, root, file, original_revision, current_revision, sandbox_revision, validated_revision.
    """
    return (
        F.when(F.coalesce("status", F.lit("")) != "valid", "Patch not validated")
        .when(~paths.inside(F.col("root"), F.col("file")), "PATH_OUTSIDE_ROOT")
        .when(F.col("original_revision").isNotNull() & (F.col("current_revision") != F.col("original_revision")), "STALE_FILE_AT_APPLY")
        .when(F.col("sandbox_revision").isNull(), "Sandbox missing")
        .when(F.col("validated_revision").isNotNull() & (F.col("sandbox_revision") != F.col("validated_revision")), "SANDBOX_CHANGED_AFTER_VALIDATION")
    )


def write_file(path: str, patch_id: str, code: str) -> str:
    """Driver side: replace a file in one step, keeping its mode, with a backup; the backup's path."""
    import os
    import shutil
    import tempfile

    if ".." in patch_id or "/" in patch_id or "\\" in patch_id:
        raise ValueError(f"INVALID_PATCH_ID: {patch_id}")
    backup = f"{path}.bak.{patch_id}"
    mode = os.stat(path).st_mode
    handle, made = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=f".{patch_id}")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(code)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(made, mode)
    shutil.copy2(path, backup)
    os.replace(made, path)
    return backup
