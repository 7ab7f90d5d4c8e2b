"""Structured Streaming: validated events, newest per key, late events, tumbling counts, standing queries.

Every sink is idempotent by (batch id, key), so a batch that is delivered again
after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.files import upsert_parquet

EVENT = "v int, process_id long, status string, scraped_at timestamp, data string"
STATUSES = ("ok", "not_found", "error")
MAX_BYTES = 256 * 1024


def validated(raw: DataFrame, column: str = "value") -> DataFrame:
    """Adds the event's fields and ``reject``: why it is not applied, or null."""
    e = F.from_json(F.col(column), EVENT)
    d = raw.withColumn("e", e).select("*", "e.*").drop("e")
    why = F.when(F.octet_length(column) > MAX_BYTES, "too large").when(F.col("v").isNull() | F.col("process_id").isNull(), "unreadable").when(F.col("v") != 1, "version").when(~F.col("status").isin(*STATUSES) | F.col("status").isNull(), "status")
    return d.withColumn("reject", why)


def newest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def apply_events(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, counts): the newest event per process; those not newer than the state are skipped and counted."""
    good = validated(batch).where("reject IS NULL").select("process_id", "status", "scraped_at", "data")
    n = newest(good, ["process_id"], "scraped_at", "status", "data")
    s = state.select("process_id", F.col("scraped_at").alias("stored"))
    j = n.join(s, "process_id", "left")
    late = F.col("stored").isNotNull() & (F.col("scraped_at") <= F.col("stored"))
    counts = j.agg(F.count_if(~late).alias("applied"), F.count_if(late).alias("skipped"))
    fresh = j.where(~late).drop("stored")
    kept = state.join(fresh.select("process_id"), "process_id", "left_anti")
    return kept.unionByName(fresh), counts


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], watermark: str) -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped."""
    d = events.withWatermark(ts, watermark) if events.isStreaming else events
    return d.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Reads what is there, batch by batch; offsets advance only when the sink returns."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_sink(spark: SparkSession, path: str, keys: list[str], version: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row per key in a Parquet table."""
    return lambda batch, _: upsert_parquet(spark, path, prepare(batch), keys, version)


def detections(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """New matches of a batch: one per key, none that was seen."""
    return batch.dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")


def stale(last: Column, as_of: Column, hours: int = 2) -> Column:
    return F.timestamp_diff("SECOND", last, as_of) > hours * 3600
