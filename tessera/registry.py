"""Every query of the engine by name, with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "packet_build"
MODULES = ("identity", "tokens", "corpus", "mixed", "graph", "ranking", "packets", "losses", "artifacts", "changes", "patches", "tooling")

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and the DuckDB SQL of the same rows."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        import_module(f"tessera.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
