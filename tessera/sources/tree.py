"""A data source over trees of source files, with whole folders pruned while listing.

``spark.read.format("tessera_tree").option("root", ...)`` gives repo_id, path, code,
mtime_ms, size and file_ord. Links are not followed, excluded names (of files and folders)
are left out before they are opened. The driver opens folders, outermost first, only until
there are a few for each task asked for; the tasks list what lies under theirs and read it.
With a limit, or with paths named by the caller, the driver lists and deals the files by size.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths

SCHEMA = "repo_id string, path string, code string, mtime_ms long, size long, file_ord long"


def _language(name: str) -> str:
    stem, ext = os.path.splitext(name)
    return paths.LANGUAGES.get(ext[1:].lower(), "text") if stem.strip(".") else "text"


def _wanted(path: str, profile: str) -> bool:
    """``code``: languages of code. ``all``: every known language, configuration files and test files. ``bench``: three languages."""
    name = path.rsplit("/", 1)[-1]
    lang = _language(name)
    if profile == "code":
        return lang not in paths.NOT_CODE
    if profile == "bench":
        return name.endswith((".js", ".ts", ".py")) and not any(p.startswith(".") for p in path.split("/"))
    return lang != "text" or name in paths.CONFIG_FILES or any(re.search(p, path) for p in paths.TEST_PATTERNS)


def _entries(root: str, at: str, profile: str, exclude) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Folders and wanted files directly in a folder."""
    folders, files = [], []
    try:
        entries = list(os.scandir(os.path.join(root, at)))
    except OSError:
        return folders, files
    for e in entries:
        path = f"{at}/{e.name}" if at else e.name
        if e.name in exclude or e.is_symlink():
            continue
        if e.is_dir(follow_symlinks=False):
            folders.append(path)
        elif e.is_file(follow_symlinks=False) and _wanted(path, profile):
            st = e.stat(follow_symlinks=False)
            files.append((path, int(st.st_mtime * 1000), st.st_size))
    return folders, files


def _excluded(profile: str, exclude) -> frozenset:
    return frozenset(exclude if exclude is not None else paths.EXCLUDED if profile == "code" else paths.EXCLUDED_MORE)


def list_tree(root: str, profile: str = "code", exclude=None, limit: int | None = None, under: str = "") -> list[tuple[str, int, int]]:
    """(path within the root, mtime in ms, size) of the wanted files under a folder, in order of their path."""
    exclude = _excluded(profile, exclude)
    out, todo = [], [under]
    while todo:
        folders, files = _entries(root, todo.pop(), profile, exclude)
        todo += folders
        out += files
    out.sort()
    return out[:limit]


def units(root: str, profile: str, exclude, wanted: int) -> list[tuple[str, list[tuple[str, int, int]] | None]]:
    """Folders to be listed by tasks, and the files of the folders opened on the way, in order of their path."""
    exclude = _excluded(profile, exclude)
    out, front = [], [""]
    while front and len(front) < wanted:
        inner = []
        for at in front:
            folders, files = _entries(root, at, profile, exclude)
            inner += folders
            out += [(path, [(path, mtime, size)]) for path, mtime, size in files]
        front = inner
    return sorted(out + [(at, None) for at in front])


class _Part(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["root"])
        self.repo = options.get("repo_id", self.root)
        exclude, limit = options.get("exclude"), options.get("limit")
        self.profile, self.exclude = options.get("profile", "code"), exclude.split(",") if exclude else None
        self.limit, self.only = int(limit) if limit else None, options.get("only")
        self.parts = int(options.get("partitions", "8"))

    def partitions(self):
        if self.limit or self.only is not None:
            found = list_tree(self.root, self.profile, self.exclude, self.limit) if self.only is None else self._named()
            todo = [(k, x[0], [x]) for k, x in enumerate(found)]
        else:
            todo = [(k << 32, at, files) for k, (at, files) in enumerate(units(self.root, self.profile, self.exclude, 4 * self.parts))]
        # Largest first to the part with least; a folder to be listed counts as a large file.
        loads, dealt = [0] * max(1, min(self.parts, len(todo))), [[] for _ in range(max(1, min(self.parts, len(todo))))]
        for unit in sorted(todo, key=lambda u: -(u[2][0][2] if u[2] else 1 << 24)):
            k = loads.index(min(loads))
            loads[k] += unit[2][0][2] + 1 if unit[2] else 1 << 24
            dealt[k].append(unit)
        return [_Part(x) for x in dealt]

    def _named(self):
        """Files that are named (path and order are the caller's), as far as they are there."""
        out = []
        for path in json.loads(self.only):
            try:
                st = os.stat(os.path.join(self.root, path), follow_symlinks=False)
            except OSError:
                continue
            out.append((path, int(st.st_mtime * 1000), st.st_size))
        return out

    def read(self, partition):
        for base, at, files in partition.rows:
            for k, (path, mtime, size) in enumerate(list_tree(self.root, self.profile, self.exclude, under=at) if files is None else files):
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                        code = f.read()
                except OSError:  # gone since it was listed
                    continue
                yield self.repo, path, code, mtime, size, base + k


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, profile: str = "code", **options) -> DataFrame:
    """The files of a tree, through the registered source."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tessera_tree").option("root", root).option("profile", profile)
    for k, v in options.items():
        reader = reader.option(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v))
    return reader.load()


def scan_project(spark: SparkSession, root: str, repo_id: str, profile: str = "code"):
    """files, symbols (with contracts), imports and edges of a tree; files that failed are rows of symbols with an error."""
    from ..functions import contracts
    from ..operators import graph, parse

    files = parse.with_file_facts(read_tree(spark, root, profile, repo_id=repo_id).drop("size"))
    symbols = contracts.add_contract(parse.parse_symbols(files))
    imports = graph.resolve_imports(parse.parse_imports(files), files)
    good = symbols.filter("error is null")
    return {"files": files, "symbols": symbols, "imports": imports, "edges": graph.call_edges(good, imports), "typed_edges": graph.typed_edges(good)}
