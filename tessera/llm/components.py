"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and an aggregation in Spark; nothing but a pair of counters reaches the
driver. Each round is a written table, so lost executors cost one round at most. Up to ``FEW``
edges, counted first, are joined up in one task instead, with the same result: a round of such a
table is all planning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store

FEW = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).filter("a <> b")


def _joined_up(batches):
    """(node, component) of all edges of a task: every node takes the least name around it, and that name's own name, until none moves."""
    parts = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    name = np.arange(len(nodes))
    while True:
        least = np.minimum(name[x], name[y])
        new = name.copy()
        for at in (x, y, name[x], name[y]):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, name):
            break
        name = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[name])], ["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable. ``edges``: a, b of one orderable type."""
    now = _store.materialise(edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.schema["a"].dataType.typeName() == "long" and now.limit(FEW + 1).count() <= FEW:
        return _store.materialise(now.repartition(1).mapInArrow(_joined_up, "node long, component long"), "components")
    state = None
    for _ in range(max_rounds):
        now = _store.materialise(_small_star(_large_star(now).distinct()).distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
