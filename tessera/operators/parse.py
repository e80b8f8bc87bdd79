"""Source files into symbols: two line-oriented parsers as one mapInArrow step.

Which declarations a line makes is a table of patterns a language. Where they end is found by
one tokenising expression that passes over strings and comments, with the line starts of a
file worked out once. Symbols inside a class are qualified by it, by the lines it spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contracts, identity, paths

# Declaration patterns and words that are no names.
BASIC = {
    "javascript": (
        ("function", r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("class", r"^(?:export\s+)?class\s+(\w+)"),
        ("method", r"^(?:static\s+)?(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{"),
    ),
    "typescript": (
        ("function", r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("class", r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("interface", r"^(?:export\s+)?interface\s+(\w+)"),
        ("type", r"^(?:export\s+)?type\s+(\w+)\s*="),
        ("method", r"^(?:static\s+)?(?:async\s+)?(\w+)\s*\([^)]*\)\s*:\s*\w+\s*\{"),
    ),
    "python": (
        ("function", r"^def\s+(\w+)\s*\("),
        ("class", r"^class\s+(\w+)"),
        ("async_function", r"^(?:async\s+)?def\s+(\w+)\s*\("),
    ),
}
FALLBACK = BASIC["javascript"][:2]
CONTROL = (
    "if", "for", "while", "switch", "catch", "with", "do", "else", "try", "finally", "return", "throw", "new", "typeof", "instanceof", "delete",
    "void",
)
EXTENDED_CONTROL = (
    "if", "for", "while", "switch", "catch", "with", "do", "else", "try", "finally", "return", "throw", "await", "yield", "import", "export", "from",
    "new", "delete", "typeof", "instanceof", "void", "in", "of", "case", "default", "break", "continue", "debugger", "class", "extends", "super",
    "static", "get", "set", "public", "private", "protected", "readonly", "abstract", "implements", "interface", "type", "enum", "namespace",
    "declare", "module", "require",
)
FUNCTIONS = (
    r"^(?:export\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(([^)]*)\)",
    r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\s*\(([^)]*)\)\s*=>",
    r"^(\w+)\s*\(([^)]*)\)\s*\{",
)
PYTHON_FUNCTION = r"^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*\S+)?\s*:"
CLASS = r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+(?:\.\w+)*))?"
PYTHON_CLASS = r"^class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:"
VARIABLE = r"^(?:export\s+)?(const|let|var)\s+(\w+)\s*="
TYPES = (("interface", r"^(?:export\s+)?interface\s+(\w+)\s*(?:extends\s[^{]+)?\s*\{"), ("type", r"^(?:export\s+)?type\s+(\w+)\s*="), ("enum", r"^(?:export\s+)?enum\s+(\w+)\s*\{"))
METHOD = r"^(?:static\s+)?(?:async\s+)?(\w+)\s*\(([^)]*)\)\s*\{"
PYTHON_METHOD = r"^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)"

#: Strings and comments are passed over; what is left are the brackets.
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|[{}()]""", re.S)
_TYPE_PARAMETERS = re.compile(r"<[^<>{}]*>")
_CLASS_HEAD = re.compile(r"class\s+\w+(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w.,\s]+?))?\s*(?:\{|$)")
_PYTHON_HEAD = re.compile(r"class\s+\w+\s*\(([^)]*)\)")

SYMBOLS = "sym_ord int, name string, qualified_name string, kind string, signature string, start_line int, end_line int, start_off int, end_off int, body string, is_exported boolean, extends array<string>, implements array<string>, parent string"


class Source:
    """A file's text with the start of each line."""

    def __init__(self, code: str, language: str):
        self.code, self.language, self.lines = code, language, code.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def line_of(self, offset: int) -> int:
        """1-based line of an offset."""
        return bisect_right(self.starts, offset)

    def closing(self, at: int, pair: str) -> tuple[int, int]:
        """First opening bracket of a kind from ``at`` and its closing one; -1 where there is none."""
        depth, opened = 0, -1
        for m in _TOKEN.finditer(self.code, at):
            if m[0] == pair[0]:
                opened = m.start() if opened < 0 else opened
                depth += 1
            elif m[0] == pair[1] and depth:
                depth -= 1
                if not depth:
                    return opened, m.start()
        return opened, -1

    def indented_end(self, i: int) -> int:
        """Last line (0-based) of the block whose header is line i: deeper lines, without blank ones at the end."""
        own = len(self.lines[i]) - len(self.lines[i].lstrip())
        last = i
        for j in range(i + 1, len(self.lines)):
            text = self.lines[j]
            if text.strip():
                if len(text) - len(text.lstrip()) <= own:
                    break
                last = j
        return last

    def block(self, i: int, name_end: int, has_params: bool) -> int:
        """Offset of the last character of a declaration on line i."""
        line_end = self.starts[i] + len(self.lines[i]) - 1
        if self.language == "python":
            j = self.indented_end(i)
            return self.starts[j] + len(self.lines[j]) - 1
        at = name_end
        if has_params:
            _, close = self.closing(at, "()")
            at = close + 1 if close >= 0 else at
        opened, close = self.closing(at, "{}")
        if opened < 0 or ";" in self.code[at:opened]:
            return line_end
        return close if close >= 0 else len(self.code) - 1

    def signature(self, at: int, end: int) -> str:
        """The first group of parentheses of a declaration, white space squeezed."""
        opened, close = self.closing(at, "()")
        if 0 <= opened < end and close >= 0:
            return re.sub(r"\s+", " ", self.code[opened : close + 1]).strip()
        return "()"

    def live_lines(self) -> Iterator[tuple[int, str]]:
        """Lines that are neither in comments nor in free-standing triple-quoted strings, trimmed."""
        i = 0
        while i < len(self.lines):
            text = self.lines[i].strip()
            quote = text[:3] if self.language == "python" and text[:3] in ('"""', "'''") else ""
            if text.startswith("/*") or quote:
                stop, rest = ("*/", text[2:]) if not quote else (quote, text[3:])
                while stop not in rest and i + 1 < len(self.lines):
                    i += 1
                    rest = self.lines[i]
            elif text and not text.startswith(("//", "#")):
                yield i, text
            i += 1


def _names(text: str | None) -> list[str]:
    return [x for x in re.split(r"[,\s]+", text or "") if re.fullmatch(r"[\w.]+", x)]


def _heritage(text: str, language: str) -> tuple[list[str], list[str]]:
    if language == "python":
        m = _PYTHON_HEAD.search(text)
        return _names(m[1]) if m else [], []
    while (plain := _TYPE_PARAMETERS.sub("", text)) != text:  # from the inside out
        text = plain
    m = _CLASS_HEAD.search(text)
    return (_names(m[1]), _names(m[2])) if m else ([], [])


def _row(src: Source, i: int, name: str, kind: str, end: int, outer: list, signature: str, exported: bool) -> dict:
    begin = src.starts[i] + len(src.lines[i]) - len(src.lines[i].lstrip())
    parent = outer[-1][0] if outer else None
    extends, implements = _heritage(src.lines[i], src.language) if kind == "class" else ([], [])
    return {
        "name": name, "qualified_name": f"{parent}.{name}" if parent else name, "kind": kind, "signature": signature, "start_line": i + 1, "end_line": src.line_of(end),
        "start_off": begin, "end_off": end, "body": src.code[begin : end + 1], "is_exported": exported, "extends": extends, "implements": implements, "parent": parent,
    }


def parse_basic(code: str, language: str) -> list[dict]:
    """Functions, classes, methods and, in TypeScript, interfaces and types."""
    src, out, outer = Source(code, language), [], []
    patterns = [(kind, re.compile(p)) for kind, p in BASIC.get(language, FALLBACK)]
    for i, text in src.live_lines():
        while outer and outer[-1][1] < i:
            outer.pop()
        for kind, p in patterns:
            m = p.match(text)
            if not m or (m[1] in CONTROL and kind != "class"):
                continue
            indent = len(src.lines[i]) - len(src.lines[i].lstrip())
            name_end = src.starts[i] + indent + m.end(1)
            end = src.block(i, name_end, kind in ("function", "method", "async_function"))
            row = _row(src, i, m[1], kind, end, outer, src.signature(name_end, end), text.startswith("export"))
            out.append(row)
            if kind == "class":
                outer.append((row["qualified_name"], row["end_line"] - 1))
            break
    return out


def parse_extended(code: str, language: str) -> list[dict]:
    """As ``parse_basic``, with arrow functions, generators, variables, enums and parents of classes."""
    src, out, outer = Source(code, language), [], []
    python = language == "python"
    for i, text in src.live_lines():
        while outer and outer[-1][1] < i:
            outer.pop()
        indent = len(src.lines[i]) - len(src.lines[i].lstrip())
        exported = text.startswith("export")
        plain = re.sub(r"^export\s+default\s+", "export ", text)
        line_end = src.starts[i] + len(src.lines[i]) - 1
        shift = src.starts[i] + indent + len(text) - len(plain)
        if m := re.match(PYTHON_CLASS if python else CLASS, plain):
            if m[1] not in EXTENDED_CONTROL:
                end = src.block(i, shift + m.end(1), False)
                row = _row(src, i, m[1], "class", end, outer, f"class {m[1]} extends {m[2]}" if m[2] else f"class {m[1]}", exported)
                out.append(row)
                outer.append((row["qualified_name"], row["end_line"] - 1))
                continue
        if outer and (m := re.match(PYTHON_METHOD if python else METHOD, plain)) and m[1] not in EXTENDED_CONTROL:
            end = src.block(i, shift + m.end(1), True)
            out.append(_row(src, i, m[1], "method", end, outer, f"{outer[-1][0]}.{m[1]}({m[2]})", False))
            continue
        found = next((m for p in ((PYTHON_FUNCTION,) if python else FUNCTIONS) if (m := re.match(p, plain))), None)
        if found and found[1] not in EXTENDED_CONTROL:
            arrow = "=>" in plain and not re.match(FUNCTIONS[0], plain)
            flags = ("async " if re.search(r"\basync\b", plain[: found.end()]) else "") + ("generator " if re.search(r"function\s*\*", plain) else "")
            end = src.block(i, shift + found.end(1), True)
            if arrow and "{" not in plain[found.end() :]:
                end = line_end
            out.append(_row(src, i, found[1], "arrow_function" if arrow else "function", end, outer, f"{flags}{found[1]}({found[2]})", exported))
            continue
        if m := re.match(VARIABLE, plain):
            out.append(_row(src, i, m[2], "constant" if m[1] == "const" else "variable", line_end, outer, f"{m[1]} {m[2]}", exported))
            continue
        for kind, p in TYPES:
            if m := re.match(p, plain):
                end = line_end if kind == "type" else src.block(i, shift + m.end(1), False)
                out.append(_row(src, i, m[1], kind, end, outer, f"{kind} {m[1]}", exported))
                break
    return out


def parse_symbols(files: DataFrame, extended: bool = False) -> DataFrame:
    """Symbols of files (repo_id, path, code, language, file_ord), with identity, revision and errors as rows.

    A file that cannot be parsed gives one row with ``error`` and no name.
    """
    parser = parse_extended if extended else parse_basic
    texts = pa.list_(pa.string())
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": texts}
    layout = f"repo_id string, path string, language string, file_ord long, {SYMBOLS}, error string"
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in layout.split(", ")])

    def run(batches):
        for batch in batches:
            rows = []
            for f in batch.to_pylist():
                at = {k: f[k] for k in ("repo_id", "path", "language", "file_ord")}
                try:
                    found = parser(f["code"] or "", f["language"])
                except Exception as e:  # a file never stops the scan
                    rows.append(at | {"error": f"{type(e).__name__}: {e}"})
                    continue
                rows += [at | {"sym_ord": k} | x for k, x in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parsed = files.select("repo_id", "path", "code", "language", F.col("file_ord").cast("long")).mapInArrow(run, layout)
    return parsed.withColumns(
        {
            "symbol_id": identity.symbol_id(F.col("path"), F.col("language"), F.col("kind"), F.col("qualified_name"), F.col("signature")),
            "symbol_revision": identity.symbol_revision(F.col("body"), F.col("signature")),
        }
    )


def parse_imports(files: DataFrame) -> DataFrame:
    """Imports of files in order of appearance."""
    return files.select("repo_id", "path", "file_ord", F.posexplode(contracts.imports(F.col("code"))).alias("imp_ord", "imp")).select("repo_id", "path", "file_ord", "imp_ord", "imp.specifier", "imp.raw")


def parser_meta(backend: str = "enhanced-regex", confidence: float = 0.85, errors: tuple = (), fallback: bool = False):
    """What produced the symbols, as a constant struct."""
    return F.struct(F.lit(backend).alias("backend"), F.lit(confidence).alias("confidence"), F.array(*[F.lit(e) for e in errors]).cast("array<string>").alias("syntax_errors"), F.lit(fallback).alias("fallback"))


def with_meta(symbols: DataFrame) -> DataFrame:
    """Symbols with ``parser``: what produced them, or the error of a file that failed."""
    meta = parser_meta()
    failed = F.struct(meta["backend"].alias("backend"), F.lit(0.0).alias("confidence"), F.array("error").alias("syntax_errors"), F.lit(True).alias("fallback"))
    return symbols.withColumn("parser", F.when(F.col("error").isNull(), meta).otherwise(failed))


def with_file_facts(files: DataFrame) -> DataFrame:
    """Files (path, code) with language, revision, size and the predicates on their names."""
    p = F.col("path")
    return files.withColumns(
        {"language": paths.language(p), "file_revision": identity.file_revision(F.col("code")), "size": F.octet_length("code").cast("long"), "is_test": paths.is_test_path(p), "is_entrypoint": paths.is_entrypoint(p)}
    )


def file_contracts(symbols: DataFrame) -> DataFrame:
    """One row a symbol: identity, range and contract."""
    out = contracts.add_contract(symbols.filter("error is null"))
    return out.select(
        "path", "sym_ord", F.col("symbol_id").alias("id"), F.col("symbol_revision").alias("revision"), F.concat(F.lit("@"), F.col("qualified_name")).alias("handle"), "kind", "signature", "visibility", "effects", "throws", "calls",
        "properties", "confidence", "start_line", "end_line",
    )


def source_view(symbols: DataFrame, view: str) -> DataFrame:
    """A symbol as ``source`` (body and contract), ``contract`` or ``reference`` (signature). Columns a view does not show are not read."""
    out = contracts.add_contract(symbols.filter("error is null")).select("path", F.col("symbol_id").alias("id"), "kind", "body", "signature", "effects", "throws", "calls")
    shown = {"source": ("body", "signature", "effects", "throws", "calls"), "contract": ("signature", "effects", "throws", "calls"), "reference": ("signature",)}[view]
    return out.select("path", "id", "kind", F.lit(view).alias("view"), *[c if c in shown else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("body", "signature", "effects", "throws", "calls")])


def lookup(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """First symbol of each wanted (path, symbol) by name or qualified name."""
    keys = symbols.filter("error is null").select("path", "sym_ord", "symbol_id", "qualified_name", "kind", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("symbol"))
    first = F.min_by(F.struct("symbol_id", "qualified_name", "kind"), F.col("sym_ord"))
    found = keys.join(wanted, ["path", "symbol"]).groupBy("path", "symbol").agg(first.alias("s"))
    return wanted.join(found, ["path", "symbol"], "left").select("path", "symbol", "s.symbol_id", "s.qualified_name", "s.kind")
