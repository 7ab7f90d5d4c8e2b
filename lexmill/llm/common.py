"""Shared pieces: reading tables, staged tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def free_name(df: DataFrame, wish: str) -> str:
    """A column name close to ``wish`` that ``df`` does not use (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name = wish
    while name.lower() in taken:
        name += "_"
    return name


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master, where it is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """Staged Parquet tables below the shared folder.

    A staged table cuts the lineage: a lost executor repeats work back to the
    last table only. ``drop`` and ``close`` delete tables no longer read; the
    caller closes a workspace once nothing lazy reads from it. One that is
    never closed is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/lexmill-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        for n in names:
            self._delete(self.path(n))

    def close(self) -> None:
        self._delete(self.root)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row per key and how many rows the key has in ``count``.

    A key with more than its share of a task, total / (2 * partitions), is
    joined by broadcast: there are at most 2 * partitions of those, whatever
    the data. The others are shuffled, so no task gets more than a small
    multiple of its share.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, total // (2 * parts))
    hot, cold = groups.where(F.col(count) > share), groups.where(F.col(count) <= share)
    many = rows.join(F.broadcast(hot), keys)
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return many.unionByName(few)


def join_salted(rows: DataFrame, groups: DataFrame, key: str, counts: DataFrame, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups``, whose rows may be large, with ``counts`` (key, n): how many rows each key has.

    A key with more than its share of a task has its group copied once for
    every share, and its rows dealt over the copies by ``spread``: at most
    4 * partitions copies in all, and only their keys are broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, total // (2 * parts))
    salts, salt = free_name(rows, "__salts"), free_name(rows, "__salt")
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias(salts)))
    times = F.coalesce(salts, F.lit(1))
    left = rows.join(hot, key, "left").withColumn(salt, F.pmod(spread, times).cast("int")).drop(salts)
    right = groups.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), times - 1))).drop(salts)
    return left.join(right, [key, salt], how).drop(salt)
