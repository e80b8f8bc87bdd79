"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) weigh 3, 1, 2 in turn and share 150 % of
all sizes; a target stops at twice its source's size and the excess is shared again by
weight. That fixed point is a water level: target = min(cap, weight * level), found from
running sums over the sources ordered by cap / weight.

Sampling: within a source every document expects target / size copies. Documents are laid
out by size and, where sizes tie, by the MD5 of doc_id and text: one total order, the same at
every number of rows. The expected copies are summed along it, one random offset (a hash of
the seed and the source) is added, and a document is emitted once for each integer boundary
its interval crosses. Ranks come from counts per cell plus a rank within the cell. A cell is
one size of one source; a size with more than ``CELL_ROWS`` rows is cut into ranges of the
MD5, so a hot source or a hot size never lands in one task. How it is cut changes no rank.

Defined cases: a null text has size 0 and contributes nothing; a null source is a source of
its own; a source of size 0 has target 0 and no copies; a null doc_id sorts as an empty one; rows
repeated with one doc_id and text count as rows of their own and come in the order of a hash of
all their columns; empty input gives an empty result; other columns are kept by ``mix`` and
ignored by the query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "tessera"
CELL_ROWS = 100_000
#: So many cut sizes are sent to every task at most; beyond, the join shuffles.
FEW_CELLS = 100_000
UNHASHED = re.compile(r"map<|variant")  # types that Spark does not hash
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """mix_source, source_size -> target. One row a source; windows over the sources only."""
    by_name = Window.orderBy(F.col("mix_source").isNull(), "mix_source")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    t = per_source.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").isNull(), "mix_source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    t = t.withColumn("level", level)
    # In this order the level only rises until it stays below cap / weight; the first such row sets it.
    t = t.withColumn("final", F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)[F.lit("level")])
    return t.select("mix_source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("final"))).alias("target"))


def offset(source) -> F.Column:
    """The one random offset of a source in [0, 1), from the seed."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(source, F.lit("\x00null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def laid_out(docs: DataFrame, text: str, source: str, order: str) -> DataFrame:
    """row, order, size, source, place (the source as a key that is never null), mark (MD5 of doc_id and text) and tie."""
    whole = F.col(f"`{text}`").cast("string")
    mark = F.md5(F.concat(F.coalesce(F.col(f"`{order}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(whole, F.lit(""))).cast("binary"))
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not UNHASHED.search(f.dataType.simpleString())])
    place = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))
    return docs.select(F.struct("*").alias("row"), F.col(f"`{order}`").alias("order"), sizes(whole).alias("size"), F.col(f"`{source}`").cast("string").alias("source"), place.alias("place"), mark.alias("mark"), tie.alias("tie"))


def cells(laid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their cell, and the cells: place, source, size, cell, rows, in written form."""
    light = laid.select("place", "source", "size")
    counted = _store.materialise(light.groupBy("place", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    hot = counted.filter(F.col("rows") > CELL_ROWS).select("place", "size", F.ceil(F.col("rows") / CELL_ROWS).cast("long").alias("cuts"))
    hot = _store.materialise(hot, "hot-sizes")
    if hot.isEmpty():
        return laid.withColumn("cell", F.lit(0).cast("long")), counted.withColumn("cell", F.lit(0).cast("long"))
    # The leading 32 bits of the MD5, scaled: cells follow one another in the order of the MD5.
    cell = F.shiftright(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * F.col("cuts"), 32)
    small = hot.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    cut = laid.join(F.broadcast(hot) if small else hot, ["place", "size"], "left").withColumn("cell", F.coalesce(cell, F.lit(0).cast("long"))).drop("cuts")
    return cut, _store.materialise(cut.groupBy("place", "source", "size", "cell").agg(F.count("*").alias("rows")), "cells")


def copies(docs: DataFrame, text: str = "text", source: str = "source", order: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """row (a struct of all columns), order, size, source_size, target and n_copies of each document."""
    d, counted = cells(laid_out(docs, text, source, order))
    goals = targets(counted.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.col("rows") * F.col("size")).alias("source_size")), weights, share, cap)
    # Rows before a cell: those in smaller size classes of its source, and those before it in its class.
    counted = counted.withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"))
    earlier = Window.partitionBy("place").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = counted.groupBy("place", "class").agg(F.sum("rows").alias("rows")).select("place", "class", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "class").orderBy("size", "cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = counted.withColumn("inside", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(classes, ["place", "class"])
    plan = plan.join(goals, plan["source"].eqNullSafe(goals["mix_source"])).select(
        "place", "size", "cell", (F.col("base") + F.col("inside")).alias("first"), "source_size", "target")
    # The same plain keys for the window and the join, so that texts are shuffled once.
    rank = F.row_number().over(Window.partitionBy("place", "size", "cell").orderBy("mark", "tie")) - 1
    d = d.withColumn("rank", rank).join(plan, ["place", "size", "cell"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("first") + F.col("rank")
    u = offset(F.col("source"))
    crossed = F.floor(each * (at + 1) + u) - F.floor(each * at + u)
    return d.select("row", "order", "size", "source_size", "target", F.least(crossed, F.lit(int(-(-cap // 1)))).cast("long").alias("n_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row once per integer boundary crossed, with the columns of the input."""
    drawn = copies(docs, **options).filter(F.col("n_copies") > 0)
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy")).select("row.*")


def op9_systematic(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, repeats counted."""
    docs = _store.table(spark, sf_dir, "documents")
    return copies(docs.select("doc_id", "text", "source")).select(
        F.col("order").alias("doc_id"), "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || COALESCE(text, '')) AS mark FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - COALESCE(sum(cap) OVER o, 0.0::DOUBLE)) / (sum(w) OVER () - COALESCE(sum(w) OVER o, 0.0::DOUBLE)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(level, cap / w) FILTER (WHERE w * level <= cap) AS final FROM l
), g AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, w * final) END AS target FROM l, f
), r AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, mark) - 1 AS pos FROM d
), e AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, r.pos, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS per_doc,
    CAST(('0x' || substr(md5('tessera:' || COALESCE(r.source, chr(0) || 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
), n AS (
  SELECT *, CAST(least(floor(per_doc * (pos + 1) + u) - floor(per_doc * pos + u), 2) AS BIGINT) AS n_copies FROM e
)
SELECT doc_id, size, source_size, target, n_copies * size AS taken, n_copies FROM n
"""
