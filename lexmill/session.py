"""A session with the settings the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "lexmill", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
