"""Content-derived identities of files and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfc, sha256_short, squeeze

#: Fixed value: the revision of nothing.
NO_REVISION = "000000000000"


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normal_signature(c: Column) -> Column:
    """White space squeezed, ``async`` dropped, trimmed; empty for null."""
    return F.trim(F.regexp_replace(squeeze(_s(c)), r"async\s+", ""))


def symbol_key(path: Column, language: Column, kind: Column, qualified_name: Column, signature: Column, ordinal: Column | None = None) -> Column:
    """The text behind a symbol's identity: six slots joined by a bar, empty ones kept."""
    slash = F.regexp_replace(nfc(_s(path)), r"\\", "/")
    at = F.lit("") if ordinal is None else F.when(ordinal > 0, F.concat(F.lit("#"), ordinal.cast("string"))).otherwise("")
    return F.concat_ws("|", slash, _s(language), _s(kind), _s(qualified_name), normal_signature(signature), at)


def symbol_id(path, language, kind, qualified_name, signature, ordinal=None) -> Column:
    """``sym_`` and 12 hex digits; the same for composed, decomposed and backslash forms of a path."""
    return F.concat(F.lit("sym_"), sha256_short(symbol_key(path, language, kind, qualified_name, signature, ordinal)))


def compat_symbol_id(language: Column, qualified_name: Column) -> Column:
    """The coarse identity that knows language and qualified name only; collides across files."""
    return symbol_id(F.lit(""), language, F.lit(""), qualified_name, F.lit(""))


def symbol_revision(body: Column, signature: Column) -> Column:
    return sha256_short(F.concat(_s(signature), F.lit("::"), _s(body)))


def subtree_revision(subtree: Column) -> Column:
    """Revision of a normalised syntax tree given as text."""
    return F.when(_s(subtree) == "", F.lit(NO_REVISION)).otherwise(sha256_short(_s(subtree)))


def file_revision(content: Column) -> Column:
    return sha256_short(content)


project_revision = file_revision


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def normal_subtree(node: dict | None) -> str:
    """A syntax tree (kind, name, qualifiedName, signature?, children?) as text, depth first."""
    if not node:
        return ""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if not x:
            out.append("")
            continue
        out += [x.get("kind") or "unknown", x.get("name") or "", x.get("qualifiedName") or ""]
        if x.get("signature"):
            out.append(" ".join(x["signature"].split()).replace("async ", "").strip())
        todo.extend(reversed(x.get("children") or []))
    return "|".join(out)


def freshness(expected_file: Column, actual_file: Column, expected_symbol: Column, actual_symbol: Column) -> Column:
    """Null while fresh, else what is stale; an unknown expectation is not checked."""
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(known(expected_file) & ~expected_file.eqNullSafe(actual_file), "STALE_FILE").when(known(expected_symbol) & ~expected_symbol.eqNullSafe(actual_symbol), "STALE_SYMBOL")


def file_retrieval_id(path: Column) -> Column:
    """``file:`` and the first six bytes of the path in hex."""
    return F.concat(F.lit("file:"), F.lower(F.substring(F.hex(F.encode(path, "UTF-8")), 1, 12)))


def symbol_retrieval_id(symbol: Column) -> Column:
    return F.concat(F.lit("sym:"), symbol)


def blob_path(hash_: Column) -> Column:
    """Two-digit folder and name of a stored blob."""
    return F.concat(F.substring(hash_, 1, 2), F.lit("/"), hash_)
