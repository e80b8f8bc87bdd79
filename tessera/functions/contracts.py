"""What a symbol's body says about it: calls, throws, effects, properties, risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists, in their order.
CALL = r"(\w+(?:\.\w+)*)\s*\("
THROW = r"throw\s+(?:new\s+)?(\w+)"
IMPORT = r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]|require\s*\(['"]([^'"]+)['"]\)|from\s+(\S+)\s+import|import\s+(\S+)"""
EFFECTS = (
    ("database-write", r"(?i)\.(?:save|insert|update|delete|create|write|persist|upsert)\s*\("),
    ("network-write", r"\.(?:publish|send|post|put|patch)\s*\("),
    ("network-read", r"\.(?:fetch|get|request)\s*\("),
    ("filesystem-write", r"""(?:writeFile|createWriteStream|open\s*\([^)]*['"]w)"""),
    ("process-spawn", r"(?:spawn|exec|fork|subprocess)"),
)
ASYNC = r"(?:new Promise|async\s|await\s)"
TRANSACTION = r"(?:transaction|BEGIN|COMMIT|ROLLBACK)"
LOCKING = r"(?i)(?:mutex|lock|semaphore|atomic)"
SENSITIVE = r"(?i)auth|perm|acl|role|crypt|token|secret|password|hash"
RISKY = SENSITIVE + r"|payment|transaction|migrate"
PYTHON_BUILTINS = ("print", "len", "range", "str", "int", "list", "dict", "set", "type", "isinstance", "hasattr", "getattr", "setattr", "super", "enumerate", "zip", "map", "filter")


def calls(body: Column, name: Column, language: Column) -> Column:
    """Names called, each once, in order. Python leaves out builtins; other languages the symbol's own name."""
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(CALL), 1))
    builtins = F.array(*[F.lit(x) for x in PYTHON_BUILTINS])
    return F.when(language == "python", F.array_except(found, builtins)).otherwise(F.array_except(found, F.array(name)))


def throws(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(THROW), 1))


def effects(body: Column) -> Column:
    return F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(name)) for name, p in EFFECTS]))


def properties(body: Column) -> Column:
    """struct of three flags, each true or null."""
    flags = (("async", ASYNC), ("transactional", TRANSACTION), ("uses_locking", LOCKING))
    return F.struct(*[F.when(body.rlike(p), F.lit(True)).alias(name) for name, p in flags])


def visibility(name: Column) -> Column:
    return F.when(name.startswith("_"), "private").otherwise("public")


def confidence(found: Column) -> Column:
    """struct of confidences; ``found``: the effects."""
    return F.struct(F.when(F.size(found) > 0, 0.85).otherwise(0.3).alias("effects"), F.lit(0.5).alias("idempotent"), F.lit(0.95).alias("async"))


def add_contract(symbols):
    """Symbols (name, body, language) with visibility, effects, throws, calls, properties and confidence."""
    body = F.coalesce(F.col("body"), F.lit(""))
    out = symbols.withColumns({"visibility": visibility(F.col("name")), "effects": effects(body), "throws": throws(body), "calls": calls(body, F.col("name"), F.col("language")), "properties": properties(body)})
    return out.withColumn("confidence", confidence(F.col("effects")))


def _guarded() -> Column:
    return F.coalesce(F.col("properties.transactional"), F.lit(False)) | F.coalesce(F.col("properties.uses_locking"), F.lit(False))


def risk_score() -> Column:
    """0 to 6, of a symbol with its contract."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    return one(F.col("name").rlike(RISKY), 2) + one(_guarded(), 2) + one(F.size("effects") > 2, 1) + one(F.size("throws") > 0, 1)


def escalates(target: Column, stack_trace: Column, tests: Column) -> Column:
    """Whether a symbol's source is needed besides its contract."""
    has = lambda hay, needle: F.coalesce((hay != "") & hay.contains(needle), F.lit(False))
    named = F.coalesce((target != "") & (F.col("qualified_name").contains(target) | F.col("name").contains(target)), F.lit(False))
    unsure = (F.col("confidence.effects") < 0.5) | (F.col("confidence.idempotent") < 0.4)
    return named | has(stack_trace, F.col("name")) | has(tests, F.col("name")) | unsure | F.col("name").rlike(SENSITIVE) | _guarded()


def imports(code: Column) -> Column:
    """array of struct(specifier, raw), in order of appearance."""
    raw = F.regexp_extract_all(code, F.lit(IMPORT), 0)

    def one(r):
        groups = [F.nullif(F.regexp_extract(r, IMPORT, k), F.lit("")) for k in range(1, 5)]
        return F.struct(F.coalesce(*groups).alias("specifier"), r.alias("raw"))

    return F.transform(raw, one)
