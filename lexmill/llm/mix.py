"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words. The sources share the whole corpus
size by weight; no source gets more than ``max_epochs`` times its own size, and
what is over goes to the others by weight until none is above. A source with a
target of e.5 sizes gives e complete epochs, then a sample of half its size: a
document's key is -ln(u) / quality with u from a hash of its id and text, and
documents are taken in order of key up to the budget.

The order by key is never sorted in one task per source. A source's keys are
cut into ``buckets`` ranges between their least and greatest logarithm, whose
sums are prefix-summed; the bucket in which the budget ends is cut again, until
it has at most ``rows_per_task`` rows, and only those are sorted. Weights of
any scale and rows of one weight fall into ranges alike, and keys that agree
are cut by row. What comes out is one cut per source, with which any scan of
the documents tells what is taken: neither rows nor texts are shuffled.

Edge cases: null or empty texts have size 0 and are never taken; a null source
is a source of its own, last in order; a source of size 0 has target 0. A null
or negative quality counts as the least. Rows that repeat id and text fall on
the same key and are ordered by nothing else: which of them is cut by the
budget does not show in the sums per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, free_name, join_groups, table

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = r"[A-Za-z\x{80}-\x{10FFFF}]"


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(c: Column) -> Column:
    """The default quality weight: the share of characters that are letters, at least 0.05."""
    text = F.coalesce(c, F.lit(""))
    return F.greatest(F.lit(0.05), F.regexp_count(text, F.lit(LETTERS)) / F.greatest(F.length(text), F.lit(1)))


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """source, source_size -> also target: the corpus size shared by weight under the caps.

    Capped sources are those whose cap per weight lies below the common level;
    with sources in order of it, the level is found by one running sum. One row
    per source passes through a single task.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(all_).cast("double")).withColumn("all_w", F.sum("w").over(all_))
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("rest") / F.col("rest_w")).withColumn("open", F.col("level") <= F.col("cap") / F.col("w"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(all_)
    s = s.withColumn("lvl", level["level"])
    return s.select("source", "source_size", F.when(F.col("lvl").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("lvl") * F.col("w"))).alias("target"))


def log_key(id_col: Column, text: Column, quality: Column | None, seed: int) -> Column:
    """The logarithm of a document's key, which orders as the key does."""
    weight = F.coalesce(F.greatest(F.lit(1e-9), letter_share(text) if quality is None else quality), F.lit(1e-9))
    return F.log(-F.log(uniform(id_col, text, seed)) / weight)


def _with_source(rows: DataFrame, per: DataFrame, source: str, few: bool, total: int) -> DataFrame:
    """``rows`` with the columns of ``per``, which has one row per source (``s``) and how many rows it has (``n_docs``)."""
    if few:
        return rows.join(F.broadcast(per), F.col(source).eqNullSafe(F.col("s"))).drop("s", "n_docs")
    key = free_name(rows, "__source")
    named = lambda c: F.to_json(F.struct(F.col(c).alias("s")))
    return join_groups(rows.withColumn(key, named(source)), per.withColumn(key, named("s")), [key], "n_docs", total).drop("s", "n_docs", key)


PLACE = ("x", "doc_id", "digest", "rid")


def cuts(d: DataFrame, t: DataFrame, ws: Workspace, few: bool, total: int, buckets: int, rows_per_task: int) -> DataFrame:
    """(s, cut, through): per source with a budget the place in order at which it ends, and whether the row there is taken."""
    live = _with_source(d.where("size > 0").select("source", "size", *PLACE), t.where("budget > 0").select("s", "n_docs", "budget"), "source", few, total).withColumn("before", F.lit(0).cast("long"))
    level, last = 0, None
    while True:
        by_rid = F.min("x") == F.max("x")
        ranges = live.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_docs"), by_rid.alias("by_rid"), F.when(by_rid, F.min("rid")).otherwise(F.min("x")).alias("lo"), F.when(by_rid, F.max("rid")).otherwise(F.max("x")).alias("hi"))
        ranges = ws.save(ranges, f"ranges{level}")
        most = ranges.agg(F.max("n_docs")).first()[0] or 0
        if most <= rows_per_task or most == last:
            break
        ranged = _with_source(live, ranges, "source", few, total)
        share = (F.when(F.col("by_rid"), F.col("rid")).otherwise(F.col("x")) - F.col("lo")) / (F.col("hi") - F.col("lo"))
        ranged = ranged.withColumn("b", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor(share * buckets))).otherwise(0).cast("int")).drop("by_rid", "lo", "hi")
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        per = ranged.groupBy("source", "b").agg(F.sum("size").alias("sum"), F.first("before").alias("before"), F.first("budget").alias("budget"), F.count("*").alias("n_docs"))
        per = per.withColumn("before", F.col("before") + F.coalesce(F.sum("sum").over(run), F.lit(0).cast("long")))
        ends = ws.save(per.where("before < budget AND before + sum >= budget").select(F.col("source").alias("s"), F.col("b").alias("end"), F.col("before").alias("upto"), "n_docs"), f"ends{level}")
        inner = _with_source(ranged, ends, "source", few, total).where("b = end")
        live, last, level = ws.save(inner.select("source", "size", *PLACE, "budget", F.col("upto").alias("before")), f"cut{level}"), most, level + 1
    order = Window.partitionBy("source").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    # the document in which the budget ends goes in if at least half of it fits
    placed = live.withColumn("taken", at + F.col("size") / 2 <= F.col("budget")).withColumn("p", F.struct(*PLACE))
    last_in = F.max(F.when(F.col("taken"), F.col("p")))
    return ws.save(placed.groupBy(F.col("source").alias("s")).agg(F.coalesce(last_in, F.min("p")).alias("cut"), last_in.isNotNull().alias("through")), "cuts")


def _planned(docs: DataFrame, ws: Workspace, id_col: str, text_col: str, source_col: str, quality: Column | None, weights: tuple[float, ...], max_epochs: int, seed: int, buckets: int, rows_per_task: int, max_broadcast: int) -> tuple[DataFrame, DataFrame, bool, int]:
    """(rows, per source, whether the latter is small, number of rows)."""
    text = F.col(text_col)
    d = ws.save(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), log_key(F.col(id_col), text, quality, seed).alias("x"), F.md5(F.coalesce(text, F.lit(""))).alias("digest")), "sizes")
    sums = ws.save(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    t = targets(sums, weights, max_epochs).withColumnRenamed("source", "s").join(F.broadcast(sums.select(F.col("source").alias("s2"), "n_docs")) if sums.count() <= max_broadcast else sums.select(F.col("source").alias("s2"), "n_docs"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    t = ws.save(t, "targets")
    few, total = t.count() <= max_broadcast, d.count()
    ends = cuts(d, t, ws, few, total, buckets, rows_per_task).withColumnRenamed("s", "s2")
    t = t.join(F.broadcast(ends) if few else ends, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    return d, ws.save(t, "per_source"), few, total


def plan(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: int = 7, buckets: int = 4096, rows_per_task: int = 1000, max_broadcast: int = 100_000) -> DataFrame:
    """Per row of ``docs``: rid, doc_id, size, digest (of the text), source_size, target, times (how often the mix takes it), taken (words)."""
    d, t, few, total = _planned(docs, ws, id_col, text_col, source_col, quality, weights, max_epochs, seed, buckets, rows_per_task, max_broadcast)
    out = _with_source(d, t, "source", few, total)
    place = F.struct(*PLACE)
    # a budget without a cut is more than all there is, by a rounding error
    more = (F.col("budget") > 0) & F.coalesce((place < F.col("cut")) | (F.col("through") & (place == F.col("cut"))), F.lit(True))
    times = F.when(F.col("size") > 0, F.col("epochs") + F.when(more, 1).otherwise(0)).otherwise(0).cast("long")
    return out.select("rid", "doc_id", "source", "size", "digest", "source_size", "target", times.alias("times")).withColumn("taken", F.col("times") * F.col("size"))


def mix(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: int = 7, buckets: int = 4096, rows_per_task: int = 1000, max_broadcast: int = 100_000) -> DataFrame:
    """The rows the mix takes, repeated as often as it takes them.

    A second scan of ``docs`` compares each row's place with its source's cut.
    Only if rows that repeat id and text stand at a cut are those rows numbered.
    """
    d, t, few, total = _planned(docs, ws, id_col, text_col, source_col, quality, weights, max_epochs, seed, buckets, rows_per_task, max_broadcast)
    key, part, times = (free_name(docs, x) for x in ("__place", "__source", "__times"))
    three = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in PLACE[:3]])
    at_cut = _with_source(d.where("size > 0"), t.where("cut IS NOT NULL").select("s", "n_docs", "cut", "through"), "source", few, total).where(F.struct(*PLACE[:3]) == three("cut"))
    ties = ws.save(at_cut.groupBy(F.col("source").alias("s3")).agg(F.count("*").alias("tied"), F.count_if(F.col("through") & (F.col("rid") <= F.col("cut.rid"))).alias("in_tie")), "ties")
    per = t.join(F.broadcast(ties) if few else ties, F.col("s").eqNullSafe(F.col("s3")), "left").select("s", "n_docs", F.struct("epochs", "budget", three("cut").alias("cut"), F.col("cut").isNotNull().alias("has_cut"), "tied", "in_tie").alias(part))
    text, p = F.col(text_col), F.col(part)
    out = docs.withColumn(key, F.struct(log_key(F.col(id_col), text, quality, seed).alias("x"), F.col(id_col).alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("digest")))
    out = _with_source(out.where(word_count(text) > 0), per, source_col, few, total)
    tied = p["has_cut"] & (F.col(key) == p["cut"])
    more = F.when(~p["has_cut"], p["budget"] > 0).when(tied, p["in_tie"] > 0).otherwise(F.col(key) < p["cut"])
    out = out.withColumn(times, p["epochs"].cast("long") + F.when(more, 1).otherwise(0))
    split = tied & (p["in_tie"] > 0) & (p["in_tie"] < p["tied"])
    if ties.where("in_tie > 0 AND in_tie < tied").limit(1).count():
        place = F.row_number().over(Window.partitionBy(source_col).orderBy(F.lit(1)))
        some = out.where(split).withColumn(times, F.col(times) - F.when(place > p["in_tie"], 1).otherwise(0))
        out = out.where(~split).unionByName(some)
    return out.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def op6_mixing(spark, sf_dir):
    return plan(table(spark, sf_dir, "documents"), Workspace(spark)).drop("rid", "source", "digest", "times")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  greatest(0.05, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Za-z\x{80}-\x{10FFFF}]', '', 'g'))) / greatest(length(coalesce(text, '')), 1)) AS q,
  (('0x' || substr(md5(concat_ws('|', '7', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u, md5(coalesce(text, '')) AS dig FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w
      FROM w WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rest / rest_w, cap / w) AS lvl FROM r WHERE rest / rest_w <= cap / w),
t AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN cap ELSE least(cap, lvl * w) END AS target FROM r, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id, dig, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN budget > 0 AND pos + size / 2 <= budget THEN 1 ELSE 0 END END)::BIGINT * size AS taken FROM k
"""
