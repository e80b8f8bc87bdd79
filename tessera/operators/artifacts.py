"""A content-addressed store as tables: one row a content, events for pins, filters for expiry."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..storage import exists

# Fixed values.
MAX_BYTES = 50 * 1024 * 1024
CHUNK = 64 * 1024
COPY_LIMIT = 100_000
PREVIEW = 5_000
LIST_LIMIT = 50


@F.pandas_udf(BinaryType())
def deflate(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else zlib.compress(bytes(x)))


@F.pandas_udf(BinaryType())
def inflate(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else zlib.decompress(bytes(x)))


def too_large(content: str, limit: int = MAX_BYTES) -> Column:
    """Whether a store refuses a content."""
    return F.coalesce(F.octet_length(F.col(content).cast("binary")) > limit, F.lit(False))


def put(puts: DataFrame) -> DataFrame:
    """Artifacts of puts (put_ord, content, mime, created, ttl, pinned, tags): one row a content, the first put's properties, refs counted.

    Puts of one content are merged before the shuffle, so a content goes over the wire once a partition at most.
    """
    data = puts.withColumn("content", F.col("content").cast("binary")).withColumn("artifact_id", F.sha2("content", 256))
    fits = data.filter(~too_large("content"))
    whole = F.struct(*[c for c in fits.columns if c != "artifact_id"])
    out = fits.groupBy("artifact_id").agg(F.min_by(whole, "put_ord").alias("first"), F.count("*").alias("refs")).select("artifact_id", "first.*", "refs")
    size = F.octet_length("content").cast("long")
    return out.withColumns({"size": size, "chunk_count": F.greatest(F.lit(1), F.ceil(size / CHUNK)).cast("int"), "hash_prefix": F.substring("artifact_id", 1, 2)})


def write(artifacts: DataFrame, path: str, ord_: Column | None = None) -> None:
    """Add versions of artifacts to a store: blobs by the first two digits of their hash, one task a prefix at most, and a log of all else.

    Every write adds rows to the log with the number ``ord_`` (of the put, where none is given); blobs that are there already are not written again.
    """
    spark = artifacts.sparkSession
    blobs = artifacts.select("artifact_id", "hash_prefix", deflate("content").alias("packed"))
    if exists(spark, f"{path}/blobs"):
        blobs = blobs.join(spark.read.parquet(f"{path}/blobs").select("artifact_id"), "artifact_id", "left_anti")
    blobs.repartition("hash_prefix").write.mode("append").partitionBy("hash_prefix").parquet(f"{path}/blobs")
    artifacts.drop("content").withColumn("log_ord", (F.col("put_ord") if ord_ is None else ord_).cast("long")).write.mode("append").parquet(f"{path}/log")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The artifacts of a store: the newest row of the log of each, with its content."""
    blobs = spark.read.parquet(f"{path}/blobs").select("artifact_id", inflate("packed").alias("content"))
    return latest(spark.read.parquet(f"{path}/log"), "artifact_id", "log_ord").join(blobs, "artifact_id")


def get(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (artifact_id) with content, null when unknown; a content that does not match its id is an error."""
    checked = F.when(F.sha2("content", 256) == F.col("artifact_id"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("Integrity check failed: "), F.substring("artifact_id", 1, 12))).cast("binary"))
    return wanted.join(artifacts.select("artifact_id", checked.alias("content")), "artifact_id", "left")


def chunks(artifacts: DataFrame) -> DataFrame:
    """The plain bytes of every artifact in numbered chunks."""
    pieces = F.expr(f"transform(sequence(0, chunk_count - 1), k -> substring(content, k * {CHUNK} + 1, {CHUNK}))")  # cut once, so no row carries the whole
    return artifacts.select("artifact_id", "chunk_count", F.posexplode(pieces).alias("chunk_index", "data")).select("artifact_id", "chunk_index", "chunk_count", "data")


def truncated(text: Column, limit: int = COPY_LIMIT) -> Column:
    rest = F.length(text) - limit
    return F.when(rest > 0, F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated, "), rest.cast("string"), F.lit(" more bytes]"))).otherwise(text)


def copy_text(artifacts: DataFrame) -> DataFrame:
    """Self-contained text of every artifact."""
    text = F.decode("content", "UTF-8")
    parts = ("[ARTIFACT ", F.substring("artifact_id", 1, 12), "]\nHash: ", F.sha2("content", 256), "\nSize: ", F.col("size").cast("string"), " bytes\nMIME: ", F.col("mime"), "\nCreated: ", F.col("created").cast("string"), "\n---CONTENT---\n")
    body = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], truncated(text), F.lit("\n---END ARTIFACT---"))
    return artifacts.select("artifact_id", body.alias("copy"))


def pin(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """Artifacts with the pin of their last event (artifact_id, ord, pin)."""
    last = events.groupBy("artifact_id").agg(F.max_by("pin", "ord").alias("last"))
    return artifacts.join(last, "artifact_id", "left").withColumn("pinned", F.coalesce("last", "pinned")).drop("last")


def delete(artifacts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left after deletion requests (artifact_id), and one row a request with its outcome."""
    asked = requests.select("artifact_id").distinct()
    known = asked.join(artifacts.select("artifact_id", "pinned"), "artifact_id", "left")
    outcome = known.select("artifact_id", F.when(F.col("pinned").isNull(), "unknown").when(F.col("pinned"), "Cannot delete pinned artifact — unpin first").otherwise("deleted").alias("outcome"))
    return artifacts.join(outcome.filter("outcome = 'deleted'"), "artifact_id", "left_anti"), outcome


def expired(now: Column) -> Column:
    """Unpinned, with a time to live, and past it."""
    return ~F.col("pinned") & (F.col("ttl") > 0) & (F.unix_timestamp(F.col("created").cast("timestamp")) + F.col("ttl") < F.unix_timestamp(now.cast("timestamp")))


def collect_garbage(artifacts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What is left, and the ids removed."""
    gone = expired(now)
    return artifacts.filter(~gone), artifacts.filter(gone).select("artifact_id")


def listed(artifacts: DataFrame, pinned: bool = False, tag: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest first; 0 lists all."""
    out = artifacts.filter("pinned") if pinned else artifacts
    out = out.filter(F.array_contains("tags", tag)) if tag else out
    out = out.orderBy(F.desc("created"), "artifact_id")
    return (out.limit(limit) if limit else out).select(F.col("artifact_id"), F.substring("artifact_id", 1, 12).alias("short_id"), "size", "mime", "pinned", "created", "chunk_count")


def stats(artifacts: DataFrame, compressed: Column) -> DataFrame:
    """Counts, sizes and the ratio saved, in percent; ``compressed``: stored bytes of a row."""
    out = artifacts.agg(F.count("*").alias("count"), F.count_if("pinned").alias("pinned"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum(compressed), F.lit(0)).cast("long").alias("compressed_bytes"))
    saved = F.floor((F.lit(1) - F.col("compressed_bytes") / F.col("total_bytes")) * 100 + 0.5)
    return out.withColumn("ratio", F.when(F.col("total_bytes") > 0, saved).otherwise(0).cast("long"))


def latest(log: DataFrame, key: str = "artifact_id", ord_: str = "ord") -> DataFrame:
    """The last row of each key of an append-only metadata log."""
    whole = F.struct(*[c for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(whole, ord_).alias("last")).select(key, "last.*")
