"""A content-addressed WARC archive.

Three Parquet tables make an archive: ``payloads`` has every distinct payload
once under its SHA-256 digest, ``headers`` the exact header block of every
record, ``meta`` the type of the ids. A record is put together again by joining
headers and payloads on the digest. Reading recomputes every stored payload's
digest; a payload that differs, is missing or has another length than its
header says fails the read.

Of records with equal payloads of at least ``least`` bytes, that with the
smallest id is the response and others revisit it; smaller payloads are all
responses.

Payloads that a Bloom filter of digests shows to be like no other are written
where they are read; only those that may repeat are shuffled.

Edge cases: a null payload is empty; a null url gives no target line, an empty
one an empty line. Line ends of a header are CR LF only; a url that holds CR
or LF has them percent-encoded in its line and stands whole, in base64, in a
line of its own, so urls come back as they were. Ids may be of any type that
casts to and from strings. A record with a null id is a response and is never
revisited, unless other ids share its payload. Records that repeat the
smallest id are all responses. Empty tables give an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, join_groups, join_salted, table
from lexmill.llm.exact_dedup import probed

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS, PAYLOADS, META = "header binary, digest string", "digest string, payload binary", "id_type string"


def _urn(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:page-null>"))


def _header(date: Column) -> Column:
    """The header block, without the empty line that ends it."""
    revisit, url = F.col("record_type") == "revisit", F.col("url")
    plain = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), plain),
        F.when(plain != url, F.concat(F.lit("X-Target-Base64: "), F.base64(F.encode(url, "UTF-8")))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("first")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return F.concat_ws(CRLF, *lines)


def write_archive(pages: DataFrame, path: str, ws: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str | Column = "1970-01-01T00:00:00Z", bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> None:
    """Writes the archive of ``pages``; ``date`` is a text for all records or a column of ``pages``."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    when = date if isinstance(date, Column) else F.lit(date)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), when.cast("string").alias("date"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    index = ws.save(p.select("page_id", "url", "date", "digest", F.length("payload").cast("long").alias("bytes")), "index")
    # what is written does not depend on the order of rows: a digest stands for one payload
    marked = probed(p.select("digest", "payload"), index, "digest", ws, bits_per_row, max_filter_bytes, "maybe")
    once = marked.where(~F.col("maybe")).drop("maybe").unionByName(marked.where("maybe").drop("maybe").dropDuplicates(["digest"]))
    once.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    firsts = ws.save(index.groupBy("digest").agg(F.when(F.max("bytes") >= least, F.min("page_id")).alias("first"), F.count("*").alias("n")), "firsts")
    records = join_groups(index, firsts, ["digest"], "n", index.count())
    records = records.withColumn("record_type", F.when(F.col("page_id") > F.col("first"), "revisit").otherwise("response"))
    records.select(F.encode(_header(F.col("date")), "UTF-8").alias("header"), "digest").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    spark.createDataFrame([(pages.schema[id_col].dataType.simpleString(),)], META).write.mode("overwrite").parquet(f"{path}/meta")


def _field(name: str) -> Column:
    """The value of a header line of column ``lines``; null without such a line."""
    start = f"{name}: "
    return F.substring(F.try_element_at(F.filter("lines", lambda x: x.startswith(start)), F.lit(1)), len(start) + 1, 2**31 - 1)


def _id(c: Column, id_type: str) -> Column:
    inner = F.substring(c, len("<urn:page:") + 1, 2**31 - 1)
    return F.when(c.startswith("<urn:page:"), F.url_decode(F.regexp_replace(inner, ">$", "")).cast(id_type))


def stored_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload: every stored payload, verified; a wrong one fails the read."""
    s = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return s.select(F.when(good, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest"))).alias("digest"), "payload")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record put together again: page_id, url, record_type, refers_to, digest, record (its exact bytes) and payload (the full one, of revisits too).

    A payload that many records share is copied for every share of a task that
    they make up, so no task gets more than a small multiple of its share.
    """
    h = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    id_type = spark.read.schema(META).parquet(f"{path}/meta").first()["id_type"]
    counts = h.groupBy("digest").agg(F.count("*").alias("n"))
    j = join_salted(h, stored_payloads(spark, path), "digest", counts, h.count(), F.xxhash64("header"), "left").withColumn("lines", F.split(F.decode("header", "UTF-8"), CRLF))
    kind, end = _field("WARC-Type"), F.encode(F.lit(CRLF * 2), "UTF-8")
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    whole = F.col("payload").isNotNull() & (F.length(block) == _field("Content-Length").cast("int")) & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha256:"), "digest"))
    payload = F.when(F.coalesce(whole, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no payload as the header says, of digest "), "digest")))
    url = F.coalesce(F.decode(F.unbase64(_field("X-Target-Base64")), "UTF-8"), _field("WARC-Target-URI"))
    return j.select(_id(_field("WARC-Record-ID"), id_type).alias("page_id"), url.alias("url"), kind.alias("record_type"), _id(_field("WARC-Refers-To"), id_type).alias("refers_to"), "digest", F.concat("header", end, block, end).alias("record"), payload.alias("payload"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to per record, from the records."""
    return records(spark, path).select("page_id", "url", F.length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op2_warc(spark, sf_dir):
    ws = Workspace(spark)
    write_archive(table(spark, sf_dir, "pages"), ws.path("archive"), ws)
    return read_archive(spark, ws.path("archive")).drop("url")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, sha256(h) AS payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""
