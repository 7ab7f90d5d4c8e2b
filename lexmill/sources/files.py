"""Files in and out: id lists in CSV, conversion to Parquet, upserts of a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_id_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Column ``value``: the first of ``names`` among the header's columns, whatever its case, else the first column."""
    d = spark.read.option("header", True).csv(path)
    by = {c.strip().lower(): c for c in d.columns}
    chosen = next((by[n.lower()] for n in names if n.lower() in by), d.columns[0])
    return d.select(F.trim(F.col(f"`{chosen}`")).alias("value")).where("value <> ''")


def read_first_column(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Column ``value``: the first column of files without a header, where it matches the pattern."""
    d = spark.read.csv(path)
    return d.select(F.trim(F.col(d.columns[0])).alias("value")).where(F.col("value").rlike(pattern))


def to_parquet(spark: SparkSession, source: str, kind: str, schema: str, target: str) -> None:
    spark.read.format(kind).schema(schema).load(source).write.mode("overwrite").parquet(target)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number and folder of the last whole version of an upserted table; (0, None) before the first."""
    if not _exists(spark, path):
        return 0, None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(hadoop(path))]
    whole = [n for n in names if n.startswith("v") and n[1:].isdigit() and _exists(spark, f"{path}/{n}/_SUCCESS")]
    last = max(whole, default=None, key=lambda n: int(n[1:]))
    return (int(last[1:]), f"{path}/{last}") if last else (0, None)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of an upserted table."""
    folder = current_version(spark, path)[1]
    if folder is None:
        raise FileNotFoundError(f"no whole version in {path}")
    return spark.read.parquet(folder)


def upsert_parquet(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], version: str, keep: int = 2) -> None:
    """Rows of the batch replace those of the same key with an older version; the same batch twice changes nothing.

    Each batch writes a new numbered folder, which counts once Spark's commit
    has marked it whole; older ones but the last ``keep`` are deleted only
    then. A batch that stops anywhere leaves the table as it was. One writer
    at a time.
    """
    number, folder = current_version(spark, path)
    rows = spark.read.schema(batch.schema).parquet(folder).unionByName(batch) if folder else batch
    rest = [c for c in batch.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")
    new.write.mode("overwrite").parquet(f"{path}/v{number + 1:012d}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in fs.listStatus(hadoop(path)):
        n = old.getPath().getName()
        if n.startswith("v") and n[1:].isdigit() and int(n[1:]) <= number + 1 - keep:
            fs.delete(old.getPath(), True)


def staged(df: DataFrame, path: str) -> DataFrame:
    """The rows, written and read back: cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
