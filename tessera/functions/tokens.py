"""Token estimates and budget shares."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utf16_length

# Fixed values.
RATIOS = {"text": 0.75, "code": 0.40, "json": 0.55, "tool_schema": 0.60, "diagnostic": 0.65}
CHARS_PER_TOKEN = {"deepseek-v4-pro": 1.25, "deepseek-v4-flash": 1.35, "gpt-5.5": 1.30, "gpt-5.6": 1.30, "mimo-v2.5-pro": 1.35, "mythos-nano": 1.20}
OTHER_MODEL = 1.35
PACKET_SHARES = {"safe": (0.05, 0.40, 0.45), "balanced": (0.05, 0.45, 0.40), "aggressive": (0.03, 0.55, 0.35)}
REST_SHARES = {"safe": (0.5, 0.5), "balanced": (0.6, 0.4), "aggressive": (0.75, 0.25)}
FIXED_SHARES = {"instructions": 0.05, "task": 0.03, "project_map": 0.05, "evidence": 0.10, "expansion_reserve": 0.15, "output_reserve": 0.15, "tool_calls": 0.05}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def _length(text: Column) -> Column:
    return F.coalesce(utf16_length(text), F.lit(0))


def packet_tokens(text: Column, kind: str | Column = "json") -> Column:
    """The packet builder's estimate: at least 1; an unknown kind costs 1."""
    if isinstance(kind, str):
        ratio = F.lit(RATIOS.get(kind)).cast("double")
    else:
        ratio = F.try_element_at(_map(RATIOS), kind)
    return F.coalesce(F.greatest(F.lit(1), F.ceil(_length(text) * ratio)), F.lit(1)).cast("long")


def server_tokens(text: Column, kind: str | Column = "text") -> Column:
    """The server's estimate: 0 for empty text, ratio 0.70 for an unknown kind."""
    ratio = F.lit(RATIOS.get(kind, 0.70)) if isinstance(kind, str) else F.coalesce(F.try_element_at(_map(RATIOS), kind), F.lit(0.70))
    return F.ceil(_length(text) * ratio).cast("long")


def model_tokens(text: Column, model: str | Column = "deepseek-v4-pro") -> Column:
    """Characters over a model's characters per token; 0 for empty text."""
    each = F.lit(CHARS_PER_TOKEN.get(model, OTHER_MODEL)) if isinstance(model, str) else F.coalesce(F.try_element_at(_map(CHARS_PER_TOKEN), model), F.lit(OTHER_MODEL))
    return F.ceil(_length(text) / each).cast("long")


def rank_tokens(signature: Column, body: Column, effects: Column, calls: Column, throws: Column) -> Column:
    """The ranking's estimate of a symbol; ``calls`` and ``throws`` are counts, ``effects`` is an array."""
    joined = F.coalesce(F.array_join(effects, " "), F.lit(""))
    return F.greatest(
        F.lit(10),
        F.lit(20) + F.ceil(_length(signature) * 0.40) + F.ceil(_length(body) * 0.40) + F.ceil(_length(joined) * 0.55) + 5 * F.coalesce(calls, F.lit(0)) + 5 * F.coalesce(throws, F.lit(0)),
    ).cast("long")


def packet_shares(total: Column, mode: Column) -> Column:
    """struct(project, contracts, sources, total) of a packet's budget; unknown modes count as balanced."""
    out = []
    for k, name in enumerate(("project", "contracts", "sources")):
        share = F.coalesce(F.try_element_at(_map({m: v[k] for m, v in PACKET_SHARES.items()}), mode), F.lit(PACKET_SHARES["balanced"][k]))
        out.append((total * share).cast("long").alias(name))
    return F.struct(*out, total.cast("long").alias("total"))


def full_allocation(total: Column, mode: Column) -> Column:
    """struct of the eleven shares of a whole budget; unknown modes give contracts and sources nothing."""
    fixed = {name: F.floor(total * share) for name, share in FIXED_SHARES.items()}
    rest = total
    for x in fixed.values():
        rest = rest - x
    two = []
    for k in range(2):
        share = F.coalesce(F.try_element_at(_map({m: v[k] for m, v in REST_SHARES.items()}), mode), F.lit(0.0))
        two.append(F.floor(rest * share))
    order = {"total": total, "system_prompt": F.lit(0), "instructions": fixed["instructions"], "task": fixed["task"], "project_map": fixed["project_map"], "contracts": two[0], "sources": two[1]}
    order |= {k: fixed[k] for k in ("evidence", "expansion_reserve", "output_reserve", "tool_calls")}
    return F.struct(*[x.cast("long").alias(name) for name, x in order.items()])
