"""The calls of a workspace as tools: a list with annotations, and one dispatch by name with uniform replies."""

from __future__ import annotations

import json
from dataclasses import dataclass
from inspect import Parameter, signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .api import Rejected, Workspace

#: A reply shows so many rows of a table at most.
REPLY_ROWS = 1000


@dataclass(frozen=True)
class Tool:
    """``changes``: more than answers. ``destroys``: what it does cannot be undone."""

    name: str
    method: str
    title: str
    changes: bool = False
    destroys: bool = False

    def parameters(self) -> dict[str, bool]:
        """Names of the arguments, and whether each must be given."""
        found = list(signature(getattr(Workspace, self.method)).parameters.values())[1:]
        return {p.name: p.default is Parameter.empty for p in found}


# Names of the tools and which of them change or destroy something.
TOOLS = (
    Tool("project.scan", "project_scan", "Index a project", changes=True),
    Tool("project.map", "project_map", "Symbols of the first files and entrypoints"),
    Tool("file.contracts", "file_contracts", "Contracts of a file's symbols"),
    Tool("symbol.source", "symbol_source", "One symbol as source, contract or reference"),
    Tool("symbol.context", "symbol_context", "Callers, callees, tests and effects of a symbol"),
    Tool("project.watch_start", "project_watch_start", "Start to look at a project again and again", changes=True),
    Tool("project.watch_stop", "project_watch_stop", "Stop looking at a project", changes=True),
    Tool("project.watch_status", "project_watch_status", "State of a watch"),
    Tool("project.snapshot", "project_refresh", "Look at a project once more", changes=True),
    Tool("artifact.put", "artifact_put", "Store a content under its hash", changes=True),
    Tool("artifact.get", "artifact_get", "A stored content"),
    Tool("artifact.get_chunk", "artifact_get_chunk", "One chunk of a stored content"),
    Tool("artifact.copy_text", "artifact_copy_text", "A stored content as a text that stands for itself"),
    Tool("artifact.pin", "artifact_pin", "Keep a content from expiring, or no longer", changes=True),
    Tool("artifact.delete", "artifact_delete", "Delete a content", changes=True, destroys=True),
    Tool("artifact.list", "artifact_list", "Stored contents, newest first"),
    Tool("artifact.stats", "artifact_stats", "Numbers and sizes of stored contents"),
    Tool("artifact.gc", "artifact_gc", "Delete what has expired", changes=True, destroys=True),
    Tool("project.changed_symbols", "project_changed_symbols", "The newest changes of a project"),
    Tool("context.create", "context_create", "Build a packet for a task", changes=True),
    Tool("context.expand", "context_expand", "Add symbols to a packet", changes=True),
    Tool("context.inspect", "context_inspect", "What a packet leaves out, and its quality"),
    Tool("patch.propose", "patch_propose", "Propose edits to a packet's file", changes=True),
    Tool("patch.validate", "patch_validate", "Judge proposed edits", changes=True),
    Tool("patch.apply", "patch_apply", "Write judged edits to their file", changes=True, destroys=True),
)


def listed(spark: SparkSession) -> DataFrame:
    """name, title, read_only, destructive and the required arguments of every tool."""
    rows = [(t.name, t.title, not t.changes, t.destroys, [p for p, must in t.parameters().items() if must]) for t in TOOLS]
    return spark.createDataFrame(rows, "name string, title string, read_only boolean, destructive boolean, required array<string>")


def plain(value):
    """A result as JSON values; tables become rows."""
    if isinstance(value, DataFrame):
        rows = [json.loads(r) for r in value.limit(REPLY_ROWS + 1).toJSON().collect()]
        return {"rows": rows[:REPLY_ROWS], "truncated": len(rows) > REPLY_ROWS}
    if isinstance(value, StreamingQuery):
        return {"watching": value.isActive}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, bytes | bytearray):
        return bytes(value).decode("utf-8", "replace")
    return value


def ok(value) -> dict:
    return {"content": [{"type": "text", "text": json.dumps(plain(value), default=str)}], "isError": False}


def failed(message: str) -> dict:
    return {"content": [{"type": "text", "text": message}], "isError": True}


def call(work: Workspace, name: str, arguments: dict | None = None) -> dict:
    """The reply of a tool; guards and unknown names or arguments give an error reply."""
    tool = next((t for t in TOOLS if t.name == name), None)
    if tool is None:
        return failed(f"Unknown: {name}")
    arguments, known = arguments or {}, tool.parameters()
    lacking = [p for p, must in known.items() if must and arguments.get(p) is None]
    if lacking:
        return failed(f"{name}: {lacking[0]} required")
    if extra := sorted(set(arguments) - set(known)):
        return failed(f"{name}: unknown argument {extra[0]}")
    try:
        return ok(getattr(work, tool.method)(**arguments))
    except Rejected as e:
        return failed(f"{name}: {e}")
