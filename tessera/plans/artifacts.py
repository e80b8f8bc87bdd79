"""The artifact store over documents, each a put."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import artifacts
from ..registry import query
from ..storage import shared_folder
from .identity import table

BASE = """
puts AS (SELECT doc_id AS put_ord, sha256(text) AS artifact_id, text, CAST(strlen(text) AS BIGINT) AS size, 'text/plain' AS mime, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS created, doc_id % 7 * 60 AS ttl, doc_id % 11 = 0 AS pinned, doc_id % 5 = 0 AS diff FROM documents),
firsts AS (SELECT artifact_id, min(put_ord) AS put_ord, count(*) AS refs FROM puts GROUP BY artifact_id),
art AS (SELECT p.*, f.refs, CAST(greatest(1, ceil(p.size / 65536.0::DOUBLE)) AS INTEGER) AS chunk_count FROM puts p JOIN firsts f ON f.artifact_id = p.artifact_id AND f.put_ord = p.put_ord)
"""
WITH = f"WITH {BASE}"
NOW = "2024-01-01 00:10:00"


def stored(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).cast("timestamp_ntz")
    tags = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("diff"))).otherwise(F.array().cast("array<string>"))
    return artifacts.put(d.select(F.col("doc_id").alias("put_ord"), F.col("text").alias("content"), F.lit("text/plain").alias("mime"), created.alias("created"), (F.col("doc_id") % 7 * 60).alias("ttl"), (F.col("doc_id") % 11 == 0).alias("pinned"), tags.alias("tags")))


@query("artifact_put_dedup", f"{WITH} SELECT artifact_id, put_ord, refs, size, chunk_count, mime, ttl, pinned, substr(artifact_id, 1, 2) AS hash_prefix FROM art")
def artifact_put_dedup(spark, sf_dir):
    return stored(spark, sf_dir).select("artifact_id", "put_ord", "refs", "size", "chunk_count", "mime", "ttl", "pinned", "hash_prefix")


@query("artifact_get", f"{WITH}, w AS (SELECT DISTINCT sha256(CASE WHEN doc_id % 4 = 0 THEN concat(text, '?') ELSE text END) AS artifact_id FROM documents) SELECT w.artifact_id, a.text AS content FROM w LEFT JOIN art a ON a.artifact_id = w.artifact_id")
def artifact_get(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    wanted = d.select(F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).cast("binary"), 256).alias("artifact_id")).distinct()
    return artifacts.get(stored(spark, sf_dir), wanted).select("artifact_id", F.decode("content", "UTF-8").alias("content"))


@query("artifact_chunks", f"{WITH}, c AS (SELECT artifact_id, text, size, unnest(range(chunk_count)) AS k FROM art) SELECT artifact_id, CAST(k AS INTEGER) AS chunk_index, least(65536, size - k * 65536) AS bytes FROM c")
def artifact_chunks(spark, sf_dir):
    return artifacts.chunks(stored(spark, sf_dir)).select("artifact_id", "chunk_index", F.octet_length("data").cast("long").alias("bytes"))


@query(
    "artifact_copy_text",
    f"""{WITH} SELECT artifact_id, concat('[ARTIFACT ', substr(artifact_id, 1, 12), ']', chr(10), 'Hash: ', artifact_id, chr(10), 'Size: ', size, ' bytes', chr(10), 'MIME: ', mime, chr(10), 'Created: ', strftime(created, '%Y-%m-%d %H:%M:%S'), chr(10), '---CONTENT---', chr(10),
      CASE WHEN length(text) > 100000 THEN concat(substr(text, 1, 100000), chr(10), '... [truncated, ', length(text) - 100000, ' more bytes]') ELSE text END, chr(10), '---END ARTIFACT---') AS copy FROM art""",
)
def artifact_copy_text(spark, sf_dir):
    return artifacts.copy_text(stored(spark, sf_dir))


@query("text_truncate", "SELECT doc_id, CASE WHEN length(text) > 5000 THEN concat(substr(text, 1, 5000), chr(10), '... [truncated, ', length(text) - 5000, ' more bytes]') ELSE text END AS text FROM documents")
def text_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", artifacts.truncated(F.col("text"), artifacts.PREVIEW).alias("text"))


@query("artifact_pin", f"{WITH}, e AS (SELECT sha256(text) AS artifact_id, doc_id AS ord, doc_id % 3 = 0 AS pin FROM documents), l AS (SELECT artifact_id, arg_max(pin, ord) AS pin FROM e GROUP BY artifact_id) SELECT a.artifact_id, COALESCE(l.pin, a.pinned) AS pinned FROM art a LEFT JOIN l ON l.artifact_id = a.artifact_id")
def artifact_pin(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("artifact_id"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 3 == 0).alias("pin"))
    return artifacts.pin(stored(spark, sf_dir), e).select("artifact_id", "pinned")


@query(
    "artifact_delete",
    f"""{WITH}, r AS (SELECT DISTINCT sha256(CASE WHEN doc_id % 9 = 0 THEN concat(text, '?') ELSE text END) AS artifact_id FROM documents)
      SELECT r.artifact_id, CASE WHEN a.pinned IS NULL THEN 'unknown' WHEN a.pinned THEN 'Cannot delete pinned artifact — unpin first' ELSE 'deleted' END AS outcome FROM r LEFT JOIN art a ON a.artifact_id = r.artifact_id""",
)
def artifact_delete(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = d.select(F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).cast("binary"), 256).alias("artifact_id"))
    return artifacts.delete(stored(spark, sf_dir), r)[1]


@query("artifact_gc", f"{WITH} SELECT artifact_id FROM art WHERE NOT pinned AND ttl > 0 AND created + to_seconds(ttl) < TIMESTAMP '{NOW}'")
def artifact_gc(spark, sf_dir):
    return artifacts.collect_garbage(stored(spark, sf_dir), F.lit(NOW).cast("timestamp"))[1]


@query("artifact_list", f"{WITH} SELECT artifact_id, substr(artifact_id, 1, 12) AS short_id, size, mime, pinned, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, chunk_count FROM art ORDER BY art.created DESC, artifact_id LIMIT 50")
def artifact_list(spark, sf_dir):
    return artifacts.listed(stored(spark, sf_dir)).withColumn("created", F.col("created").cast("string"))


@query("artifact_filter", f"{WITH} SELECT artifact_id, pinned FROM art WHERE pinned AND diff")
def artifact_filter(spark, sf_dir):
    return artifacts.listed(stored(spark, sf_dir), pinned=True, tag="diff", limit=0).select("artifact_id", "pinned")


@query("artifact_stats", f"{WITH} SELECT count(*) AS count, count(*) FILTER (WHERE pinned) AS pinned, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(size // 3) AS BIGINT) AS compressed_bytes, CAST(floor((1 - sum(size // 3) / sum(size)::DOUBLE) * 100 + 0.5::DOUBLE) AS BIGINT) AS ratio FROM art")
def artifact_stats(spark, sf_dir):
    """With a stand-in for stored sizes, a third of the plain ones."""
    return artifacts.stats(stored(spark, sf_dir), F.floor(F.col("size") / 3))


@query("artifact_deflate")
def artifact_deflate(spark, sf_dir):
    """Stored sizes after compression; the round trip is checked."""
    packed = stored(spark, sf_dir).select("artifact_id", "size", artifacts.deflate("content").alias("packed"))
    ok = F.sha2(artifacts.inflate("packed"), 256) == F.col("artifact_id")
    return packed.select("artifact_id", "size", F.octet_length("packed").cast("long").alias("compressed_size"), ok.alias("intact"))


@query("artifact_store", f"{WITH} SELECT artifact_id, CAST(2 AS BIGINT) AS log_ord, size, NOT pinned AS pinned, sha256(text) = artifact_id AS intact FROM art")
def artifact_store(spark, sf_dir):
    """Artifacts written to a store, and once more with other pins: blobs stay as they are, the newer row of the log counts."""
    path = f"{shared_folder(spark)}/tessera-artifacts-{uuid.uuid4().hex}"
    found = stored(spark, sf_dir)
    artifacts.write(found, path, F.lit(1))
    artifacts.write(found.withColumn("pinned", ~F.col("pinned")), path, F.lit(2))
    return artifacts.read(spark, path).select("artifact_id", "log_ord", "size", "pinned", (F.sha2("content", 256) == F.col("artifact_id")).alias("intact"))


@query("artifact_refused", "SELECT doc_id, strlen(text) > 1000 AS refused FROM documents")
def artifact_refused(spark, sf_dir):
    """Which puts a store with a cap of 1,000 bytes refuses."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return d.select("doc_id", artifacts.too_large("content", 1000).alias("refused"))
