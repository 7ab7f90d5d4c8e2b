"""Joins, latest-per-key, sampling, paging and set operations on case records."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in a total order; all columns stay."""
    rn = "__rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def covered_days(df: DataFrame, start: str, end: str, first: Column, last: Column) -> DataFrame:
    """One row per day of [start, end], clipped to [first, last]."""
    a, b = F.greatest(F.col(start), first), F.least(F.col(end), last)
    return df.where(a <= b).withColumn("day", F.explode(F.sequence(a, b)))


def spine(days: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key on every day; days are a bounded calendar and are broadcast."""
    return keys.crossJoin(F.broadcast(days))


def hash_order(id_col: str, seed: int) -> Column:
    """A fixed shuffle: order by a digest of id and seed."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], checkpoint) -> DataFrame:
    """Adds for each of ``sums`` the sum over all rows before, in a total order, without meeting in one task.

    Rows are dealt by ranges of the order; a range's own sums are added to
    those of the ranges before, of which there is one row a range. The dealt
    rows are staged by ``checkpoint``, so that ranges do not change.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {f"__{k}": v for k, v in sums.items()}
    d = checkpoint(df.repartitionByRange(parts, *order).select("*", F.spark_partition_id().alias("__range"), *[v.alias(k) for k, v in own.items()]))
    per = sorted(d.groupBy("__range").agg(*[F.sum(k).alias(k) for k in own]).collect(), key=lambda r: r["__range"])
    before, total = [], dict.fromkeys(own, 0)
    for r in per:
        before.append((r["__range"], *total.values()))
        total = {k: v + (r[k] or 0) for k, v in total.items()}
    starts = df.sparkSession.createDataFrame(before, "__range int, " + ", ".join(f"{k}_start long" for k in own))
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(F.broadcast(starts), "__range")  # one row a range
    out = {k: F.col(f"__{k}_start") + F.coalesce(F.sum(f"__{k}").over(w), F.lit(0)) for k in sums}
    return d.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def totals_beside(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Each row with aggregates of its group, by a join; null keys are a group."""
    g = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[v.alias(k) for k, v in aggs.items()])
    if not keys:
        return df.crossJoin(F.broadcast(g))  # one row
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(g, on).drop(*[f"__{k}" for k in keys])


def placed(df: DataFrame, keys: list[str], order: list[Column], checkpoint) -> DataFrame:
    """Adds ``place`` (from 1) in a total order of each group and ``group_n``; no group meets in one task."""
    r = checkpoint(running(df, [*map(F.col, keys), *order], {"__at": F.lit(1)}, checkpoint))
    t = totals_beside(r, keys, __first=F.min("__at"), group_n=F.count("*"))
    return t.withColumn("place", F.col("__at") - F.col("__first") + 1).drop("__at", "__first")


def keyset_batches(df: DataFrame, key: str, size: int, checkpoint) -> DataFrame:
    """(batch, first, last, n): where batches of ``size`` rows in order of a unique key begin and end, found without reading one after another."""
    batch = F.floor((F.col("place") - 1) / size).alias("batch")
    return placed(df.select(key), [], [F.col(key)], checkpoint).groupBy(batch).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def stratified(df: DataFrame, stratum: str, id_col: str, quota: int, seed: int) -> DataFrame:
    """At most ``quota`` rows per stratum, in hash order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(id_col, seed), id_col))).where(F.col("place") <= quota)


def mask_matches(masked: Column, real: Column) -> Column:
    """Whether a masked number (X, x or * for hidden digits) can be the real one."""
    return F.like(real, F.translate(masked, "Xx*", "___"))


def encode_cursor(values: list, ordering: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": ordering, "v": values}).encode()).decode()


def cursor_of(values: list[Column], ordering: str) -> Column:
    """A row's cursor as ``decode_cursor`` reads it, so that any row of a page can be where the next begins."""
    v = F.array(*[F.coalesce(F.to_json(F.array(x)), F.lit("[null]")) for x in values])
    items = F.array_join(F.transform(v, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), ", ")
    return F.translate(F.base64(F.concat(F.lit(f'{{"o": {json.dumps(ordering)}, "v": ['), items, F.lit("]}")).cast("binary")), "+/", "-_")


def decode_cursor(cursor: str, ordering: str) -> list:
    """The sort values; ValueError if the cursor is damaged or of another ordering."""
    try:
        d = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        values, of = d["v"], d["o"]
    except Exception as e:
        raise ValueError("invalid cursor") from e
    if of != ordering or not isinstance(values, list):
        raise ValueError("the cursor belongs to another ordering")
    return values


def keyset_page(df: DataFrame, sort: str, id_col: str, after: list | None, size: int) -> DataFrame:
    """A page in order (sort descending, nulls last, id ascending) after the given sort values."""
    if after is not None:
        value, last = after
        s, i = F.col(sort), F.col(id_col)
        if value is None:
            df = df.where(s.isNull() & (i > last))
        else:
            df = df.where((s < value) | ((s == value) & (i > last)) | s.isNull())
    return df.orderBy(F.desc_nulls_last(sort), id_col).limit(size)


def capped(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """The first ``size`` rows and whether there are more (column ``truncated``)."""
    top = df.orderBy(*order).limit(size + 1)
    w = Window.orderBy(*order)
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return top.withColumn("truncated", n > size).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= size).drop("__rn")
