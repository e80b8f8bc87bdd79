"""Shared storage for intermediate tables.

A written table cuts lineage and survives lost executors. It goes to the folder named in
``spark.checkpoint.dir``, which all executors see. Only where that setting is absent (tests,
a laptop) a folder of our own is used and recorded in the session.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tessera.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.tessera.shared.dir", found)
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, **values: str):
    """Session settings for what is written meanwhile (dots as two underscores), as they were before afterwards."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with the same schema.

    A written table needs the shuffles behind it no more; Spark removes their files at the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    with setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.select("*").write.parquet(path)  # the setting counts for plans made under it
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: all that was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, wherever Spark can look."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns and their names do not matter."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def keyed_text(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, mark and text. Doc_id and mark (a hash of the text) name a row, also where doc_ids are null or repeat; rows with both equal share one fate."""
    return doc_text(docs, text, id_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], rows: int = 1_000_000, few: int = 100_000) -> DataFrame:
    """Inner join with a written ``right`` that has one row a key and ``n``, the key's rows in ``left``; n goes.

    Keys with more than ``rows`` rows are salted by a hash of ``by``, so none lands in one task. Those keys are at most
    the rows of ``left`` over ``rows``; up to ``few`` of them are sent to every task, beyond that a join marks the rows.
    """
    hot = materialise(right.filter(F.col("n") > rows).select(*keys, F.ceil(F.col("n") / rows).cast("int").alias("cuts")), "hot")
    if hot.isEmpty():
        return left.join(right.drop("n"), keys)
    hot_keys = F.broadcast(hot) if hot.limit(few + 1).count() <= few else hot
    salted = left.join(hot_keys, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*by), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")
    last = F.greatest(F.ceil(F.col("n") / rows).cast("int"), F.lit(1)) - 1
    return salted.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("n"), [*keys, "salt"]).drop("salt")


def small_batches(spark: SparkSession, rows: int = 2000):
    """Fewer rows in an Arrow batch for what is written meanwhile: whole texts are large, and work on them makes arrays several times their size."""
    return setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows), spark__sql__execution__arrow__maxBytesPerBatch="16m")
