"""Streaming queries (ST01 to ST16): each reads files as a stream and returns what the batch form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.io import scratch, table
from lexmill.plans.base import query
from lexmill.sources.files import read_upserted
from lexmill.streaming import pipelines as st


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


def _stream(spark, df, files: int = 4):
    """The rows as a file stream, some files a batch."""
    path = scratch(spark)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("st01_partitioned_apply", "SELECT (user_id % 4)::INT AS part, user_id, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def st01(spark, sf):
    out = scratch(spark)
    prepare = lambda b: st.newest(b.repartition(4, F.pmod("user_id", F.lit(4))).select("user_id", "event_id"), ["user_id"], "event_id")
    st.run_once(_stream(spark, _events(spark, sf)), st.upsert_sink(spark, out, ["user_id"], "event_id", prepare), scratch(spark))
    return read_upserted(spark, out).select((F.col("user_id") % 4).cast("int").alias("part"), "user_id", "event_id")


RAW = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'version' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'status' END AS reject FROM events)"""


def raw_events(spark, sf):
    k = F.col("event_id") % 5
    body = F.to_json(F.struct(F.when(k == 0, 2).otherwise(1).alias("v"), F.col("user_id").alias("process_id"), F.when(k == 2, "lost").otherwise("ok").alias("status"), F.col("ts").alias("scraped_at"), F.lit("{}").alias("data")))
    return _events(spark, sf).select("event_id", F.when(k == 1, "{broken").otherwise(body).alias("value"))


@query("st02_validation", f"SELECT coalesce(reject, 'good') AS reject, count(*) AS n FROM {RAW} GROUP BY 1")
def st02(spark, sf):
    out = scratch(spark)
    s = st.validated(_stream(spark, raw_events(spark, sf))).select("event_id", F.coalesce("reject", F.lit("good")).alias("reject"))
    st.run_once(s, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch(spark))
    return spark.read.schema("event_id long, reject string, batch long").parquet(out).groupBy("reject").agg(F.count("*").alias("n"))


@query("st03_microbatch_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def st03(spark, sf):
    out = scratch(spark)
    st.run_once(_stream(spark, _events(spark, sf)).select("user_id", "event_id", "event_type"), st.upsert_sink(spark, out, ["user_id"], "event_id"), scratch(spark))
    return read_upserted(spark, out)


@query("st04_late_events", "WITH a AS (SELECT user_id, max(ts) AS t FROM events WHERE event_id % 2 = 0 AND event_id % 5 > 2 GROUP BY 1), b AS (SELECT user_id, max(ts) AS t FROM events WHERE event_id % 2 = 1 AND event_id % 5 > 2 GROUP BY 1) SELECT count(*) FILTER (WHERE a.t IS NULL OR b.t > a.t) AS applied, count(*) FILTER (WHERE b.t <= a.t) AS skipped FROM b LEFT JOIN a USING (user_id)")
def st04(spark, sf):
    raw = raw_events(spark, sf)
    none = spark.createDataFrame([], "process_id long, status string, scraped_at timestamp, data string")
    state, _ = st.apply_events(raw.where("event_id % 2 = 0"), none)
    _, counts = st.apply_events(raw.where("event_id % 2 = 1"), state)
    return counts


@query("st05_newest_in_batch", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def st05(spark, sf):
    return st.newest(_events(spark, sf).select("user_id", "event_id"), ["user_id"], "event_id")


@query("st06_redelivery", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def st06(spark, sf):
    """The consumer stops after it has written a batch and before its offsets are kept: the batch comes again."""
    from pyspark.errors import StreamingQueryException

    out, offsets, sunk = scratch(spark), scratch(spark), []
    apply = st.upsert_sink(spark, out, ["user_id"], "event_id")

    def sink(batch, i):
        apply(batch, i)
        sunk.append(i)
        if len(sunk) == 1:
            raise RuntimeError("stopped before the offsets were kept")

    stream = _stream(spark, _events(spark, sf)).select("user_id", "event_id", "event_type")
    try:
        st.run_once(stream, sink, offsets)
    except StreamingQueryException:
        st.run_once(stream, sink, offsets)
    if sunk[:2] != [0, 0]:
        raise RuntimeError("the batch was not delivered again")
    return read_upserted(spark, out)


@query("st08_overlap_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def st08(spark, sf):
    out = scratch(spark)
    e = _events(spark, sf)
    again = e.unionByName(e.where("event_id % 3 = 0"))  # the tail that an overlapping window reads again
    s = _stream(spark, again).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    q = s.select("event_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id long").parquet(out).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("st12_standing_stream", "SELECT user_id, event_type FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2")
def st12(spark, sf):
    out = scratch(spark)
    terms = spark.createDataFrame([("purchase",), ("error",)], "event_type string")
    s = _stream(spark, _events(spark, sf)).join(F.broadcast(terms), "event_type").select("user_id", "event_type", "event_id")
    st.run_once(s, st.upsert_sink(spark, out, ["user_id", "event_type"], "event_id"), scratch(spark))
    return read_upserted(spark, out).select("user_id", "event_type")


@query("st13_tumbling_hours", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st13(spark, sf):
    name = f"hours_{scratch(spark)[-8:]}"
    s = st.tumbling(_stream(spark, _events(spark, sf)), "ts", "1 hour", ["event_type"], "60 days")
    out = scratch(spark)
    q = s.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", scratch(spark)).queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.read.schema("start timestamp, event_type string, n long, batch long").parquet(out)
    last = r.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("st14_split_windows", "SELECT * FROM (VALUES (DATE '2024-01-01', DATE '2024-01-16'), (DATE '2024-01-17', DATE '2024-01-31')) t(\"from\", \"to\")")
def st14(spark, sf):
    from lexmill.functions.dates import halves

    return spark.range(1).select(F.explode(halves(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("w")).select("w.from", "w.to")


@query("st16_staleness", "SELECT user_id, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS stale FROM events GROUP BY 1")
def st16(spark, sf):
    e = _events(spark, sf)
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("t")))).select("user_id", (F.col("last") < F.col("t") - F.expr("INTERVAL 2 HOURS")).alias("stale"))  # one row
