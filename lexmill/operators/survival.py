"""Survival curves of censored durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kaplan_meier(df: DataFrame, stratum: str, days: str, event: str, least: int = 1) -> DataFrame:
    """stratum, days, at_risk, total, surv per distinct duration; strata under ``least`` rows go.

    Only counts per (stratum, duration) reach the windows.
    """
    t = df.groupBy(stratum, days).agg(F.sum(event).alias("d"), F.count("*").alias("n"))
    w = Window.partitionBy(stratum)
    r = t.withColumn("at_risk", F.sum("n").over(w.orderBy(F.desc(days)))).withColumn("total", F.sum("n").over(w)).where(F.col("total") >= least)
    up = w.orderBy(days)
    dead = F.sum((F.col("d") == F.col("at_risk")).cast("int")).over(up) > 0
    log = F.sum(F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)).over(up)
    return r.withColumn("surv", F.when(dead, 0.0).otherwise(F.exp(log)))
