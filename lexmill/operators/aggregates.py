"""Aggregations of case records: facets, series, ratios, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.relational import placed, running, totals_beside


def facet(df: DataFrame, key: str, n: int, out: str = "total") -> DataFrame:
    """The n most frequent values of a non-null key; ties go by value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out)).orderBy(F.desc(out), key).limit(n)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def known_count(flag: Column, cond: Column | None = None) -> Column:
    """Rows with the flag set, or null where the flag is never known."""
    return F.when(F.count(flag) > 0, F.count(F.when(flag if cond is None else flag & cond, 1)))


def rate(n: Column, of: Column, digits: int = 4) -> Column:
    """n / of, null for an empty whole."""
    return F.round(n / F.when(of != 0, of), digits)


def dense_series(df: DataFrame, ts: str, keys: list[str], unit: str, start: Column, end: Column, step: str) -> DataFrame:
    """Counts per key and time bucket from start to end, 0 where there is nothing."""
    spark = df.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(start, end, F.expr(step))).alias("bucket"))
    dims = df.select(*keys).distinct() if keys else None
    spine = dims.crossJoin(F.broadcast(spine)) if dims is not None else spine
    counts = df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).cast("timestamp").alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(counts, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_with_others(df: DataFrame, key: str, n: int, others: str = "others", missing: str = "no data") -> DataFrame:
    """Counts of the n most frequent values, of all others together, and of rows without a value."""
    counts = df.groupBy(key).agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy(F.col(key).isNull()).orderBy(F.desc("total"), key))
    label = F.when(F.col(key).isNull(), missing).when(rank <= n, F.col(key)).otherwise(others)
    return counts.withColumn("label", label).groupBy("label").agg(F.sum("total").alias("total"))


def histogram(df: DataFrame, value: str, keys: list[str], bins: int = 20) -> DataFrame:
    """Counts in equal bins of [0, 1]; the last bin is closed."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def rank_slices(df: DataFrame, order: list[Column], keys: list[str], checkpoint, slices: int = 10, least: int = 10) -> DataFrame:
    """Adds ``slice`` from 1: equal rank slices of groups of at least ``least`` rows; smaller groups go."""
    d = placed(df, keys, order, checkpoint).where(F.col("group_n") >= least)
    return d.withColumn("slice", F.ceil(F.lit(slices) * F.col("place") / F.col("group_n")).cast("int")).drop("place")


def upper_medians(df: DataFrame, keys: list[str], value: str, tie: str, checkpoint) -> DataFrame:
    """Per group n, least, most and median: the value at n div 2, from 0, of those in order. Null values do not count."""
    d = placed(df.where(F.col(value).isNotNull()).select(*keys, value, tie), keys, [F.col(value), F.col(tie)], checkpoint)
    middle = F.col("place") == F.floor(F.col("group_n") / 2) + 1
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.max(F.when(middle, F.col(value))).alias("median"))


def smoothed_density(df: DataFrame, hits: str, volume: str, prior: float = 1000.0) -> DataFrame:
    """Adds ``density`` (hits per volume) and ``score``, drawn to the overall density by a prior volume."""
    w = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.sum(hits).over(w) / F.sum(volume).over(w)
    return df.withColumn("density", rate(F.col(hits), F.col(volume), 6)).withColumn("score", F.round((F.col(hits) + prior * mean) / (F.col(volume) + prior), 6))


def kolmogorov_smirnov(df: DataFrame, value: str, side: str, keys: list[str], checkpoint) -> DataFrame:
    """The two-sample statistic of the values with ``side`` true and false, per key; null if a sample is empty."""
    per = df.groupBy(*keys, value).agg(F.sum(F.col(side).cast("long")).alias("a"), F.sum((~F.col(side)).cast("long")).alias("b"))
    upto = checkpoint(running(per, [*map(F.col, keys), F.col(value)], {"a_before": F.col("a"), "b_before": F.col("b")}, checkpoint))
    # sums over all groups before are the least of a group's own
    d = totals_beside(upto, keys, a_start=F.min("a_before"), b_start=F.min("b_before"), a_all=F.sum("a"), b_all=F.sum("b"))
    share = lambda x: F.try_divide(F.col(f"{x}_before") - F.col(f"{x}_start") + F.col(x), F.col(f"{x}_all"))
    return d.withColumn("gap", F.abs(share("a") - share("b"))).groupBy(*keys).agg(F.round(F.max("gap"), 6).alias("ks"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def roc_auc(df: DataFrame, score: str, label: str, tie: str, checkpoint) -> DataFrame:
    """Area under the curve by trapezoids over rows in order of falling score, ties by id."""
    rows = df.select(F.col(label).cast("long").alias("y"), score, tie)
    d = running(rows, [F.desc(score), F.col(tie)], {"tp": F.col("y")}, checkpoint)
    # with one row a step, a negative adds a rectangle as high as the positives before it
    return d.agg(F.try_divide(F.sum(F.when(F.col("y") == 0, F.col("tp"))), F.sum("y") * F.sum(1 - F.col("y"))).alias("auc"))
