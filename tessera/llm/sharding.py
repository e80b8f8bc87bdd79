"""Fixed virtual slots: a versioned slot-to-shard map edited when rebalancing.

Records hash into a fixed number of virtual slots by doc_id, text and, where rows repeat
both, the number of the repeat. Bytes are aggregated per slot (partial sums before the
shuffle), and the map from slots to shards is a small table of ``slots`` rows a version.
Version 1 deals slots out in turn. A rebalance writes the next version: slots are visited by
falling size, stay at home while the home has room below the mean load, and otherwise move to
the least loaded shard. Only the map changes; a reader finds a record's shard from its slot
and a map version. ``shard`` keeps the map in a folder: the first call there makes versions 1
and 2, every later one adds a version made of the newest.

All steps are DataFrame functions. The only ordered fold runs over the ``slots`` rows of
the map, a constant. Positions within a shard come from counts per slot and a rank within
a slot, so no task ever holds a whole shard.

Defined cases: a null text has size 1 and checksum 0; rows without a doc_id, with a repeated
one, or repeated as a whole spread over the slots like all others; empty input gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store

SLOTS = 4096
SHARDS = 16


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the virtual slot of each record.

    Rows that repeat doc_id and text are counted and dealt out again under numbers of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    number = lambda digest, digits: F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    rows = _store.doc_text(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), number(F.md5(text.cast("binary")), 15).alias("mark"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32", "mark").agg(F.count("*").alias("copies"))
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy", "mark")
    slot = F.pmod(number(F.md5(name.cast("binary")), 8), F.lit(slots)).cast("int")
    return numbered.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has any."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: slots dealt out in turn, with the bytes and rows of each."""
    spark = sizes.sparkSession
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(sizes, "virtual_slot", "left").select(
        F.lit(1).alias("map_version"), "virtual_slot", F.pmod(F.col("virtual_slot"), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def rebalance(current: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map: largest slots first, at home while the home stays below the mean, else to the least loaded shard.

    A fold over one array with a constant number of entries (the virtual slots).
    """
    entry = F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "shard", "rows")
    folded = current.agg(F.array_sort(F.collect_list(entry)).alias("todo"), F.max("map_version").alias("v"), F.ceil(F.sum("bytes") / shards).cast("long").alias("mean"))

    def step(acc, x):
        home = F.get(acc["loads"], x["shard"])
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        to = F.when((x["shard"] < shards) & (home - x["minus"] <= F.col("mean")), x["shard"]).otherwise(least)
        loads = F.transform(acc["loads"], lambda load, i: F.when(i == to, load - x["minus"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(acc["placed"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), to.alias("shard"), (-x["minus"]).alias("bytes"), x["rows"].alias("rows")))).alias("placed"))

    empty = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>)").alias("placed"),
    )
    done = folded.select((F.col("v") + 1).alias("map_version"), F.aggregate("todo", empty, step)["placed"].alias("placed"))
    return done.select("map_version", F.inline("placed"))


def store_map(map_df: DataFrame, path: str) -> None:
    """Append a version of the map to a stored table partitioned by version."""
    map_df.write.mode("append").partitionBy("map_version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the newest."""
    stored = spark.read.parquet(path)
    version = version if version is not None else stored.agg(F.max("map_version")).first()[0]
    return stored.filter(F.col("map_version") == version)


def place(records: DataFrame, map_df: DataFrame) -> DataFrame:
    """Each record's shard by the map, and its gapless position within the shard.

    The map has a constant number of rows, so broadcasting it is bounded.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = map_df.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("map_version", "virtual_slot", "shard", "first")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("rank", rank).join(F.broadcast(offsets), "virtual_slot").withColumn("slot", (F.col("first") + F.col("rank") - 1).cast("long")).drop("rank", "first")


def shard(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Each record's shard and position by the map stored under ``path``, which gets a new version for these records.

    A map that is there is edited: its slots stay where they are as far as the loads and the number of shards allow.
    """
    spark = docs.sparkSession
    records = _store.materialise(with_slot(docs, slots), "records")
    sizes = slot_sizes(records)
    if not _store.exists(spark, path):
        store_map(first_map(sizes, slots, shards), path)
        now = load_map(spark, path, 1)
    else:
        old = load_map(spark, path).select("map_version", "virtual_slot", "shard")
        now = old.join(sizes, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])
    store_map(rebalance(now, shards), path)
    return place(records, load_map(spark, path))


def op8_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``bytes``, by a rebalanced map of 4,096 virtual slots."""
    path = f"{_store.shared_dir(spark)}/tessera-slot-map-{_store.uuid.uuid4().hex}"
    return shard(_store.table(spark, sf_dir, "documents"), path).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


OP8_SQL = """
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), texts AS (
  SELECT doc_id, COALESCE(text, '') AS text, hex(encode(COALESCE(text, ''))) AS h, CAST(strlen(COALESCE(text, '')) AS BIGINT) AS n FROM documents
), sums AS (
  SELECT doc_id, n + 1 AS size, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS mark,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295::BIGINT) AS text_crc32
  FROM texts, poly
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32, mark) AS copy FROM sums
), slotted AS (
  SELECT doc_id, size, text_crc32, CAST(CAST('0x' || substr(md5(concat(doc_id, '|', copy, '|', mark)), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS virtual_slot FROM numbered
), loads AS (
  SELECT CAST(s.v AS INTEGER) AS virtual_slot, CAST(COALESCE(sum(size), 0) AS BIGINT) AS bytes, count(size) AS rows FROM range(4096) s(v) LEFT JOIN slotted ON virtual_slot = v GROUP BY v
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS n, CAST(ceil(sum(bytes) OVER () / 16.0::DOUBLE) AS BIGINT) AS mean FROM loads
), fold AS (
  SELECT 0::BIGINT AS n, list_resize([0::BIGINT], 16, 0::BIGINT) AS load, NULL::INTEGER AS shard
  UNION ALL
  SELECT n, list_transform(load, lambda x, i: CASE WHEN i - 1 = shard THEN x + bytes ELSE x END), shard
  FROM (
    SELECT o.n, o.bytes, f.load, CAST(CASE WHEN f.load[1 + o.virtual_slot % 16] + o.bytes <= o.mean THEN o.virtual_slot % 16 ELSE list_position(f.load, list_min(f.load)) - 1 END AS INTEGER) AS shard
    FROM fold f JOIN ordered o ON o.n = f.n + 1
  )
), map AS (
  SELECT o.virtual_slot, f.shard, COALESCE(sum(o.rows) OVER (PARTITION BY f.shard ORDER BY o.virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM fold f JOIN ordered o ON o.n = f.n
)
SELECT s.doc_id, s.size, s.text_crc32, 'bytes' AS law, m.shard, CAST(m.first + row_number() OVER (PARTITION BY s.virtual_slot ORDER BY s.doc_id, s.text_crc32, s.size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard,
  s.virtual_slot, CAST(2 AS INTEGER) AS map_version
FROM slotted s JOIN map m ON m.virtual_slot = s.virtual_slot
"""
