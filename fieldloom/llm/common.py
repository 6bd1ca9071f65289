"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which executors and driver share.

    Where that is unset the warehouse, which they share as well, has a folder for it; on a cluster that names
    neither there is no shared folder, and nothing is written.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named, warehouse = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir")
        if not named and not context.isLocal() and warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local folder")
        spark.sparkContext.setCheckpointDir(named or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir().get()


#: Whether shuffle files go at the end of a query, and not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, with its lineage cut, so that its shuffle files can go at once."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        return df.select("*").checkpoint()  # a query takes the setting when it is made
    finally:
        spark.conf.set(TIDY, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes what a finished step no longer needs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it holds more than one in ``SHARE`` rows, of which there can be no more than ``SHARE``, and more than a task takes lightly.
SHARE, HOT_ROWS = 2000, 100_000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> list:
    """The at most ``SHARE`` hot keys of ``counts`` (key, n)."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(HOT_ROWS, total // SHARE)).select(key).collect()] if total > HOT_ROWS else []


def with_hot_keys(counts: DataFrame, key: str, n: str = "n", possible: bool = True) -> tuple[DataFrame, list]:
    """``counts`` and its hot keys; where none are ``possible``, as there are too few rows, nothing is computed for them."""
    if not possible:
        return counts, []
    counts = reliable(counts)
    return counts, hot_keys(counts, key, n)


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has one row a key: rows of hot keys stay where they are and meet a broadcast of
    the few rows of ``one`` that they need, so that no task gets all rows of a hot key."""
    if not hot:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return many.where(~is_hot).join(one.where(~is_hot), key, how).unionByName(many.where(is_hot).join(F.broadcast(one.where(is_hot)), key, how))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all learning."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 0, F.lit(False))
