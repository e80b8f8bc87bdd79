"""Snapshot differences over events: even events are the listing known, odd ones the listing now."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..registry import query
from ..sources import corpus
from ..storage import shared_folder
from ..streaming import incremental
from .identity import table

BASE = """
e AS (SELECT concat(event_type, '/', user_id, '.js') AS path, epoch_us(ts) // 1000 AS mtime_ms, event_id, concat('s', event_id % 97) AS symbol_id FROM events),
old AS (SELECT path, max(mtime_ms) AS mtime_ms FROM e WHERE event_id % 2 = 0 GROUP BY path),
new AS (SELECT path, max(mtime_ms) AS mtime_ms FROM e WHERE event_id % 2 = 1 GROUP BY path),
diff AS (SELECT * FROM (SELECT COALESCE(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.mtime_ms > o.mtime_ms + 500 THEN 'modified' END AS change FROM old o FULL JOIN new n ON n.path = o.path) WHERE change IS NOT NULL),
olds AS (SELECT DISTINCT path, symbol_id FROM e WHERE event_id % 2 = 0), news AS (SELECT DISTINCT path, symbol_id FROM e WHERE event_id % 2 = 1),
sdiff AS (SELECT * FROM (SELECT COALESCE(o.path, n.path) AS path, COALESCE(o.symbol_id, n.symbol_id) AS symbol_id, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' END AS change FROM olds o FULL JOIN news n ON n.path = o.path AND n.symbol_id = o.symbol_id) WHERE change IS NOT NULL)
"""
WITH = f"WITH {BASE}"


def listing(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), "user_id", F.lit(".js")).alias("path"), ms.alias("mtime_ms"), "event_id", F.concat(F.lit("s"), F.col("event_id") % 97).alias("symbol_id"))


def halves(spark, sf_dir):
    e = listing(spark, sf_dir)
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


@query("listing_snapshot", f"{WITH} SELECT path, mtime_ms FROM old")
def listing_snapshot(spark, sf_dir):
    return incremental.snapshot(halves(spark, sf_dir)[0])


@query("listing_diff", f"{WITH} SELECT path, change FROM diff")
def listing_diff(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return incremental.listing_diff(incremental.snapshot(a), incremental.snapshot(b))


@query("symbol_diff", f"{WITH} SELECT path, symbol_id, change FROM sdiff")
def symbol_diff(spark, sf_dir):
    return incremental.symbol_diff(*halves(spark, sf_dir))


@query("file_change_counts", f"{WITH} SELECT path, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'deleted') AS deleted FROM sdiff GROUP BY path")
def file_change_counts(spark, sf_dir):
    return incremental.change_counts(incremental.symbol_diff(*halves(spark, sf_dir)))


@query("apply_changes", f"{WITH}, kept AS (SELECT * FROM olds o WHERE NOT EXISTS (SELECT 1 FROM diff d WHERE d.path = o.path)), renewed AS (SELECT * FROM news n WHERE EXISTS (SELECT 1 FROM diff d WHERE d.path = n.path AND d.change <> 'deleted')) SELECT path, symbol_id FROM kept UNION ALL SELECT path, symbol_id FROM renewed")
def apply_changes(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    rows = lambda x: x.select("path", "symbol_id").distinct()
    return incremental.apply_changes(rows(a), incremental.listing_diff(incremental.snapshot(a), incremental.snapshot(b)), rows(b))


@query("change_log_tail", "SELECT epoch_us(ts) // 1000 AS batch_ts, concat(event_type, '/', user_id, '.js') AS path FROM events ORDER BY 1 DESC, 2 LIMIT 50")
def change_log_tail(spark, sf_dir):
    return incremental.log_tail(listing(spark, sf_dir).select(F.col("mtime_ms").alias("batch_ts"), "path"))


@query("change_log_retained", f"{WITH}, l AS (SELECT mtime_ms // 60000 AS batch_ts, path, event_id FROM e) SELECT batch_ts, path, event_id FROM l WHERE batch_ts IN (SELECT batch_ts FROM l GROUP BY batch_ts ORDER BY batch_ts DESC LIMIT 200)")
def change_log_retained(spark, sf_dir):
    log = listing(spark, sf_dir).select(F.floor(F.col("mtime_ms") / 60000).cast("long").alias("batch_ts"), "path", "event_id")
    return incremental.retained(log).select("batch_ts", "path", "event_id")


@query("snapshot_counts", f"{WITH} SELECT (SELECT count(*) FROM new) AS files, (SELECT count(DISTINCT symbol_id) FROM news) AS symbols, (SELECT count(*) FROM diff) AS changes")
def snapshot_counts(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    new = incremental.snapshot(b)
    return incremental.status(new, b, incremental.listing_diff(incremental.snapshot(a), new))


@query("file_purge", f"WITH {corpus.EXPECTED_SQL} SELECT symbol_id, path FROM ids WHERE path NOT LIKE 'src/7/%'")
def file_purge(spark, sf_dir):
    s = corpus.symbols(spark, sf_dir)
    gone = corpus.files(spark, sf_dir).filter("path like 'src/7/%'").select("path")
    return graph.purge(s, graph.typed_edges(s), gone)[0].select("symbol_id", "path")


@query("stream_apply", f"{WITH} SELECT path, 'added' AS change FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.path = old.path) AND false UNION ALL SELECT path, change FROM diff UNION ALL SELECT o.path, 'same' FROM old o JOIN new n ON n.path = o.path WHERE n.mtime_ms <= o.mtime_ms + 500")
def stream_apply(spark, sf_dir):
    """Both listings through a stream, one micro-batch each; the last version of the index."""
    import uuid

    at = f"{shared_folder(spark)}/tessera-stream-{uuid.uuid4().hex}"
    a, b = (incremental.snapshot(x) for x in halves(spark, sf_dir))
    watcher = incremental.Watcher(spark, f"{at}/index")
    for k, part in enumerate((a, b)):
        part.coalesce(1).write.mode("append").parquet(f"{at}/listings")
        stream = spark.readStream.schema(part.schema).parquet(f"{at}/listings")
        watcher.start(stream, f"{at}/checkpoint", once=True).awaitTermination()
    return watcher.state().select("path", "change")
