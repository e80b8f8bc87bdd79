"""Path expressions: normal forms, containment, languages and the predicates on names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfc

# Fixed values.
LANGUAGES = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "tsx": "tsx", "jsx": "jsx",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "sh": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown",
}
NOT_CODE = ("text", "json", "yaml", "markdown")
CONFIG_FILES = ("package.json", "tsconfig.json", "pyproject.toml", "setup.py", "config.yaml", "config.yml", ".env.example", "jest.config.js")
EXCLUDED = ("node_modules", ".git", "__pycache__", "dist", "build", ".cache")
EXCLUDED_MORE = (*EXCLUDED, ".next", ".nuxt", "coverage", "backups")
TEST_PARTS = (".test.", ".spec.", "test_", "_test.")
TEST_PATTERNS = (r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$", r"test_", r"_test\.py$", r"(^|/)test/", r"(^|/)tests/", r"(^|/)__tests__/")
ENTRY_PATTERNS = (r"(^|/)(index|main|app|server|cli|bin|entry|start|run)\.[jt]sx?$", r"(^|/)bin/", r"(^|/)cli/", r"(^|/)scripts/")
IMPORT_SUFFIXES = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", "/index.js", "/index.ts")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    """Everything before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def language(path: Column) -> Column:
    """Language by extension, in any case; ``text`` if unknown. A leading dot starts a name, not an extension."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$|^[^/]*[^/.]\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])
    return F.coalesce(F.try_element_at(table, ext), F.lit("text"))


def resolved(path: Column) -> Column:
    """Segments after ``.`` and ``..`` are worked out; null if ``..`` leaves the top."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    none = F.lit(None).cast("array<string>")
    return F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(acc.isNull() | ((s == "..") & (F.size(acc) == 0)), none).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )


def canonical(root: Column, path: Column) -> Column:
    """struct(path, error): a path relative to the repository, with forward slashes, in NFC."""
    absolute = path.startswith("/")
    top, full = resolved(root), resolved(F.when(absolute, path).otherwise(F.concat(root, F.lit("/"), path)))
    n = F.size(top)
    inside = F.coalesce(F.slice(full, 1, F.greatest(n, F.lit(1))) == top, F.lit(False)) & (F.size(full) >= n)
    rest = F.array_join(F.slice(full, n + 1, F.greatest(F.size(full) - n, F.lit(0))), "/")
    error = F.when(~inside, F.concat(F.lit("PATH_OUTSIDE_REPOSITORY: "), path)).when(rest == "", F.concat(F.lit("INVALID_REPOSITORY_PATH: "), path))
    return F.struct(F.when(error.isNull(), nfc(rest)).alias("path"), error.alias("error"))


def inside(root: Column, path: Column) -> Column:
    """Whether a canonical path is the root or lies under it."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def excluded(path: Column, names=EXCLUDED) -> Column:
    """Whether any segment of a path is one of the excluded names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in names]))


def is_code(path: Column) -> Column:
    return ~language(path).isin(*NOT_CODE)


def is_test_name(path: Column) -> Column:
    """Test files by parts of the name."""
    out = F.lit(False)
    for part in TEST_PARTS:
        out = out | path.contains(part)
    return out


def is_test_path(path: Column) -> Column:
    """Test files by patterns on the path within the repository."""
    return path.rlike("|".join(TEST_PATTERNS))


def is_entrypoint(path: Column) -> Column:
    return path.rlike("|".join(ENTRY_PATTERNS))


def is_config(path: Column) -> Column:
    return base_name(path).isin(*CONFIG_FILES)


def test_candidates(path: Column) -> Column:
    """Where the tests of a file may lie, in order."""
    in_test = F.regexp_replace(path, "^src/", "")
    return F.array(
        F.regexp_replace(path, r"\.(js|ts|jsx|tsx)$", ".test.$1"),
        F.regexp_replace(path, r"\.(js|ts)$", ".spec.$1"),
        F.concat(F.lit("test/"), in_test),
        F.concat(F.lit("__tests__/"), in_test),
        F.regexp_replace(F.regexp_replace(path, "^src/", "test/"), r"\.(js|ts)$", ".test.$1"),
    )


def safe_patch_id(c: Column) -> Column:
    """Whether an id (empty ones pass) can be part of a file name: no double dot, no slash of either kind."""
    return ~F.coalesce(c.contains("..") | c.contains("/") | c.contains("\\"), F.lit(False))
