"""Incremental indexing by snapshot differences, in batch and as a stream.

A listing (path, mtime_ms, ...) of one moment is compared with the one before; changed files
replace their old rows, deleted files go. As a stream, every micro-batch brings a listing
with the files' contents, and ``foreachBatch`` applies the difference to stored tables by
writing a new version of them: a batch that is repeated gives the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed values.
TOLERANCE_MS = 500
POLL = "5 seconds"
LOG_LIMIT = 200
RECENT = 50


def snapshot(files: DataFrame) -> DataFrame:
    """Paths with their time of change; files whose time is unknown are left out."""
    return files.filter("mtime_ms is not null").groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"))


def listing_diff(known: DataFrame, current: DataFrame, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """(path, change): added, deleted or modified between two snapshots."""
    both = known.select("path", F.col("mtime_ms").alias("old")).join(current.select("path", F.col("mtime_ms").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("new") > F.col("old") + tolerance, "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, symbol_id, change): symbols added to or deleted from files (path, symbol_id)."""
    a = old.select("path", "symbol_id").distinct().withColumn("was", F.lit(True))
    b = new.select("path", "symbol_id").distinct().withColumn("is", F.lit(True))
    both = a.join(b, ["path", "symbol_id"], "full_outer")
    return both.select("path", "symbol_id", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").alias("change")).filter("change is not null")


def change_counts(diff: DataFrame) -> DataFrame:
    """Symbols added and deleted by file."""
    return diff.groupBy("path").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "deleted").alias("deleted"))


def apply_changes(state: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows by path after a batch: those of changed files are replaced by the fresh ones, those of deleted files go."""
    kept = state.join(changes.select("path").distinct(), "path", "left_anti")
    renewed = fresh.join(changes.filter("change <> 'deleted'").select("path").distinct(), "path", "left_semi")
    return kept.unionByName(renewed.select(*state.columns))


def log_tail(log: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest ``n`` rows of a change log (batch_ts, path)."""
    return log.orderBy(F.desc("batch_ts"), "path").limit(n)


def retained(log: DataFrame, batches: int = LOG_LIMIT) -> DataFrame:
    """Rows of the newest batches of a log."""
    newest = log.select("batch_ts").distinct().orderBy(F.desc("batch_ts")).limit(batches)
    return log.join(newest, "batch_ts", "left_semi")


def status(files: DataFrame, symbols: DataFrame, log: DataFrame) -> DataFrame:
    """One row: numbers of files, symbols and logged changes."""
    key = F.lit(1).alias("one")
    a = files.agg(key, F.count("*").alias("files"))
    b = symbols.agg(key, F.count_distinct("symbol_id").alias("symbols"))
    c = log.agg(key, F.count("*").alias("changes"))
    return a.join(b, "one").join(c, "one").drop("one")


class Watcher:
    """Keeps an index of files under a folder, by what each micro-batch changes.

    ``listing`` is a stream of files (path, mtime_ms, code); every batch is a whole listing.
    A batch writes folder ``v=<batch>`` with the rows that it adds, modifies or deletes; the
    newest row of a path counts. Every ``FULL`` batches all rows are written, and what lies
    before the last such batch but one goes. A batch starts from the versions below its own
    number, so one that runs twice writes the same rows.
    """

    FULL = 50

    def __init__(self, spark: SparkSession, folder: str, derive: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.folder, self.derive = spark, folder.rstrip("/"), derive
        self.query: StreamingQuery | None = None

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder + name)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._path(f"/{n}/_SUCCESS")))

    def state(self, below: int | None = None) -> DataFrame | None:
        """All files after the newest version, or the newest below a number, with what it changed; those it deleted are there once more."""
        found = [v for v in self.versions() if below is None or v < below]
        if not found:
            return None
        full = max((v for v in found if v % self.FULL == 0), default=found[0])
        rows = self.spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/v={v}" for v in found if v >= full])
        whole = F.struct(*[c for c in rows.columns if c != "path"])
        last = rows.groupBy("path").agg(F.max_by(whole, "v").alias("r")).select("path", "r.*")
        newest = F.col("v") == found[-1]
        change = F.when(newest, F.col("change")).otherwise("same")
        return last.filter(newest | (F.col("change") != "deleted")).withColumn("change", change).drop("v")

    def apply(self, batch: DataFrame, number: int) -> None:
        old = self.state(below=number)
        current = batch if self.derive is None else self.derive(batch)
        if old is None:
            out = current.withColumn("change", F.lit("added"))
        else:
            live = old.filter("change <> 'deleted'").drop("change")
            diff = listing_diff(live, batch)
            fresh = current.join(diff.filter("change <> 'deleted'"), "path")
            out = fresh.unionByName(live.join(diff.filter("change = 'deleted'"), "path").select(*fresh.columns))
            if number % self.FULL == 0:
                out = out.unionByName(live.join(diff.select("path"), "path", "left_anti").withColumn("change", F.lit("same")).select(*fresh.columns))
        out.write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        if number % self.FULL == 0:
            done = self.versions()
            full = [v for v in done if v % self.FULL == 0 and v < number]
            for v in done:
                if full and v < full[-1]:
                    self._fs().delete(self._path(f"/v={v}"), True)

    def start(self, listing: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Watch: every five seconds, or once over what there is."""
        writer = listing.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()
        return self.query

    def stop(self) -> None:
        if self.query:
            self.query.stop()
