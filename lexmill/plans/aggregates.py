"""Aggregation queries (A01 to A62), over orders as cases, line items and events as their movements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import dates
from lexmill.io import stage, table
from lexmill.operators import aggregates as agg
from lexmill.plans.base import query


def cases(spark, sf):
    """Cases with court (nation) and state (region)."""
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


CASES = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
FLAG = "o_orderpriority IN ('1-URGENT', '2-HIGH')"


def flagged():
    return F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")


def cents(c):
    return F.col(c).cast("decimal(18,2)")


@query("a01_topk_facet", "SELECT o_orderpriority, count(*) AS total FROM orders GROUP BY 1 ORDER BY total DESC, 1 LIMIT 3")
def a01(spark, sf):
    return agg.facet(table(spark, sf, "orders"), "o_orderpriority", 3)


@query("a02_conditional_counts", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS n_large, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY 1")
def a02(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), agg.count_where(F.col("o_totalprice") > 150000).alias("n_large"), agg.count_where(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))


@query("a03_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_cases, count(DISTINCT l_suppkey) AS n_parties FROM lineitem GROUP BY 1")
def a03(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("n_cases"), F.countDistinct("l_suppkey").alias("n_parties"))


@query("a04_filtered_distinct", "SELECT l_linestatus, count(DISTINCT l_orderkey) FILTER (WHERE l_discount >= 0.05) AS n_cases FROM lineitem GROUP BY 1")
def a04(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.countDistinct(F.when(F.col("l_discount") >= 0.05, F.col("l_orderkey"))).alias("n_cases"))


@query("a05_distinct_nonempty", "SELECT event_type, count(DISTINCT CASE WHEN props <> '' THEN props END) AS n_props FROM events GROUP BY 1")
def a05(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct(F.when(F.col("props") != "", F.col("props"))).alias("n_props"))


@query("a06_regex_counters", "SELECT lang, sum(CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 1 ELSE 0 END)::BIGINT AS with_digits, sum(CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 1 ELSE 0 END)::BIGINT AS with_license, sum(CASE WHEN regexp_matches(text, '[A-Z]{6,}') THEN 1 ELSE 0 END)::BIGINT AS with_shouts FROM documents GROUP BY 1")
def a06(spark, sf):
    hit = lambda p: F.sum(F.col("text").rlike(p).cast("int"))
    return table(spark, sf, "documents").groupBy("lang").agg(hit("[0-9]{4}").alias("with_digits"), hit("(?i)licen[cs]e").alias("with_license"), hit("[A-Z]{6,}").alias("with_shouts"))


@query("a07_first_last_signal_dates", "SELECT user_id, min(CASE WHEN event_type = 'error' THEN ts::DATE END) AS first_error, max(CASE WHEN event_type = 'purchase' THEN ts::DATE END) AS last_purchase FROM events GROUP BY 1")
def a07(spark, sf):
    day = F.to_date("ts")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", day)).alias("first_error"), F.max(F.when(F.col("event_type") == "purchase", day)).alias("last_purchase"))


@query("a08_null_to_zero", "SELECT n_name, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'P'), 0)::DOUBLE AS pending_value, coalesce(max(o_totalprice), 0) AS most, count(o_orderkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a08(spark, sf):
    n, c, o = (table(spark, sf, t) for t in ("nation", "customer", "orders"))
    j = n.join(c, c.c_nationkey == n.n_nationkey, "left").join(o, o.o_custkey == c.c_custkey, "left")
    return j.groupBy("n_name").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "P", cents("o_totalprice"))), F.lit(0)).cast("double").alias("pending_value"), F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("most"), F.count("o_orderkey").alias("n"))


@query("a09_avg_interval", "SELECT o_orderstatus, round(avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) FILTER (WHERE l_returnflag <> 'N'), 4) AS avg_days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a09(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return j.groupBy("o_orderstatus").agg(F.round(F.avg(F.when(F.col("l_returnflag") != "N", days)), 4).alias("avg_days"))


@query("a10_max_not_sum", "SELECT day, event_type, max(n) AS n FROM (SELECT ts::DATE AS day, event_type, user_id % 7 AS run, count(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
def a10(spark, sf):
    runs = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type", (F.col("user_id") % 7).alias("run")).agg(F.count("*").alias("n"))
    return runs.groupBy("day", "event_type").agg(F.max("n").alias("n"))


@query("a11_matrix_rollup", "WITH m AS (SELECT n_name, o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM " + CASES + " GROUP BY 1, 2, 3) SELECT 'court' AS kind, n_name AS key, o_orderstatus AS status, sum(n)::BIGINT AS n FROM m GROUP BY 2, 3 UNION ALL SELECT 'year', y::VARCHAR, o_orderstatus, sum(n)::BIGINT FROM m GROUP BY 2, 3")
def a11(spark, sf):
    m = cases(spark, sf).groupBy("n_name", "o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    by = lambda kind, key: m.groupBy(key.alias("key"), F.col("o_orderstatus").alias("status")).agg(F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "key", "status", "n")
    return by("court", F.col("n_name")).unionByName(by("year", F.col("y").cast("string")))


@query("a12_time_buckets", "SELECT 'hour' AS unit, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'day', strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M'), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'month', strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M'), count(*) FROM events GROUP BY 2")
def a12(spark, sf):
    hours = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    out = None
    for unit in ("hour", "day", "month"):
        one = hours.groupBy(F.date_format(F.date_trunc(unit, "h"), "yyyy-MM-dd HH:mm").alias("bucket")).agg(F.sum("n").alias("n")).select(F.lit(unit).alias("unit"), "bucket", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a13_hourly_dense", "WITH last AS (SELECT date_trunc('hour', max(ts)) AS h FROM events), spine AS (SELECT unnest(generate_series(h - INTERVAL 23 HOUR, h, INTERVAL 1 HOUR)) AS bucket FROM last) SELECT strftime(bucket, '%Y-%m-%d %H:%M') AS bucket, count(event_id) AS n FROM spine LEFT JOIN events ON date_trunc('hour', ts) = bucket GROUP BY 1")
def a13(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.date_trunc("hour", F.max("ts")).alias("h"))
    spine = last.select(F.explode(F.sequence(F.col("h") - F.expr("INTERVAL 23 HOURS"), F.col("h"), F.expr("INTERVAL 1 HOUR"))).alias("bucket"))
    # the filter on the raw column reaches the scan
    counts = e.groupBy(F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counts, "bucket", "left").select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


@query("a14_union_facets", "(SELECT 'type' AS facet, p_type AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT 5) UNION ALL (SELECT 'brand', p_brand, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5) UNION ALL (SELECT 'size', p_size::VARCHAR AS v, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, v LIMIT 5)")
def a14(spark, sf):
    p = table(spark, sf, "part")
    out = None
    for name, col in (("type", F.col("p_type")), ("brand", F.col("p_brand")), ("size", F.col("p_size").cast("string"))):
        one = agg.facet(p.select(col.alias("value")), "value", 5, "n").select(F.lit(name).alias("facet"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a15_pivot", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a15(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return d.select("month", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "FOP"])


@query("a16_region_metrics", f"SELECT coalesce(r_name, 'total') AS uf, count(*) AS volume, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value, count(*) FILTER (WHERE {FLAG}) AS potential, count(*) FILTER (WHERE {FLAG} OR o_orderstatus = 'F') AS either FROM {CASES} GROUP BY GROUPING SETS ((r_name), ())")
def a16(spark, sf):
    d = cases(spark, sf).select("r_name", "o_totalprice", flagged().alias("flag"), (F.col("o_orderstatus") == "F").alias("done"))
    metrics = (F.count("*").alias("volume"), F.sum(cents("o_totalprice")).cast("double").alias("value"), agg.count_where(F.col("flag")).alias("potential"), agg.count_where(F.col("flag") | F.col("done")).alias("either"))
    return d.groupingSets([["r_name"], []], "r_name").agg(*metrics).select(F.coalesce("r_name", F.lit("total")).alias("uf"), "volume", "value", "potential", "either")


@query("a17_topn_others", "WITH c AS (SELECT CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS k, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY k IS NULL ORDER BY n DESC, k) AS rn FROM c) SELECT CASE WHEN k IS NULL THEN 'no data' WHEN rn <= 4 THEN k ELSE 'others' END AS label, sum(n)::BIGINT AS total FROM r GROUP BY 1")
def a17(spark, sf):
    return agg.top_with_others(table(spark, sf, "part").select(F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("k")), "k", 4)


def scored(spark, sf):
    """Labelled documents with a score in [0, 1] that depends on the id only."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf, "labels")
    s = (F.pmod(F.col("doc_id") * 7919 + F.col("quality") * 300, F.lit(1000)) / 1000.0).alias("score")
    return d.join(l, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", "toxic", s)


SCORED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic, ((d.doc_id * 7919 + quality * 300) % 1000) / 1000.0::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query("a18_histogram", f"SELECT lang, least(floor(score * 20), 19)::INT AS bin, count(*) AS n FROM {SCORED} GROUP BY 1, 2")
def a18(spark, sf):
    return agg.histogram(scored(spark, sf), "score", ["lang"])


@query("a19_calibration_deciles", f"WITH r AS (SELECT *, count(*) OVER (PARTITION BY lang) AS group_n, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS rn FROM {SCORED}) SELECT lang, ceil(10.0 * rn / group_n)::INT AS slice, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS hit_rate FROM r WHERE group_n >= 10 GROUP BY 1, 2")
def a19(spark, sf):
    d = agg.rank_slices(scored(spark, sf), [F.col("score"), F.col("doc_id")], ["lang"], stage)
    return d.groupBy("lang", "slice").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("quality"), 6).alias("hit_rate"))


@query("a20_heatmap_ratio", f"WITH c AS (SELECT n_name, year(o_orderdate) AS y, count(*) AS n FROM {CASES} GROUP BY 1, 2), g AS (SELECT n_name, y FROM (SELECT DISTINCT n_name FROM c), (SELECT DISTINCT y FROM c)) SELECT g.n_name, g.y::INT AS y, coalesce(n, 0) AS n, round(coalesce(n, 0) / max(coalesce(n, 0)) OVER (PARTITION BY g.n_name), 6) AS ratio FROM g LEFT JOIN c ON g.n_name = c.n_name AND g.y = c.y")
def a20(spark, sf):
    c = cases(spark, sf).groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    grid = c.select("n_name").distinct().crossJoin(c.select("y").distinct())  # courts x years
    d = grid.join(c, ["n_name", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.withColumn("ratio", F.round(F.col("n") / F.max("n").over(Window.partitionBy("n_name")), 6))


@query("a21_funnel", "SELECT 1 AS step, 'cases' AS stage, count(*) AS n FROM orders UNION ALL SELECT 2, 'with movements', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 3, 'returned', count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 4, 'closed', count(*) FROM orders WHERE o_orderstatus = 'F'")
def a21(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    line = l.agg(F.countDistinct("l_orderkey").alias("a"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("b"))
    head = o.agg(F.count("*").alias("n"), agg.count_where(F.col("o_orderstatus") == "F").alias("f"))
    stages = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(c).alias("n")) for i, (s, c) in enumerate((("cases", "n"), ("with movements", "a"), ("returned", "b"), ("closed", "f")), 1)])
    return head.crossJoin(line).select(F.explode(stages).alias("x")).select("x.*")  # one row each


@query("a22_dedup_funnel", "WITH last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_type, count(*) AS n FROM last GROUP BY 1")
def a22(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.groupBy("event_type").agg(F.count("*").alias("n"))


@query("a23_weighted_coverage", f"WITH c AS (SELECT r_name, n_name, count(*) AS v, avg(CASE WHEN o_orderstatus <> 'O' THEN 100.0 ELSE 0 END) AS pct FROM {CASES} GROUP BY 1, 2) SELECT r_name, round(sum(v * pct) / sum(v), 4) AS coverage_pct FROM c GROUP BY 1")
def a23(spark, sf):
    c = cases(spark, sf).groupBy("r_name", "n_name").agg(F.count("*").alias("v"), F.avg(F.when(F.col("o_orderstatus") != "O", 100.0).otherwise(0.0)).alias("pct"))
    return c.groupBy("r_name").agg(F.round(F.sum(F.col("v") * F.col("pct")) / F.sum("v"), 4).alias("coverage_pct"))


@query("a24_smoothed_score", f"WITH c AS (SELECT n_name, r_name, count(*) AS volume, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value, count(*) FILTER (WHERE {FLAG}) AS potential, count(*) FILTER (WHERE {FLAG} OR o_orderstatus = 'F') AS either FROM {CASES} GROUP BY 1, 2), s AS (SELECT *, round(either / volume, 6) AS density, round((either + 1000.0 * (sum(either) OVER () / sum(volume) OVER ())) / (volume + 1000.0), 6) AS score FROM c) SELECT *, row_number() OVER (ORDER BY score DESC, n_name)::INT AS place FROM s")
def a24(spark, sf):
    d = cases(spark, sf).select("n_name", "r_name", "o_totalprice", flagged().alias("flag"), (F.col("o_orderstatus") == "F").alias("done"))
    c = d.groupBy("n_name", "r_name").agg(F.count("*").alias("volume"), F.sum(cents("o_totalprice")).cast("double").alias("value"), agg.count_where(F.col("flag")).alias("potential"), agg.count_where(F.col("flag") | F.col("done")).alias("either"))
    return agg.smoothed_density(c, "either", "volume").withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "n_name")))


@query("a25_ranking", f"SELECT n_name, count(*) AS volume, max(o_totalprice) AS most FROM {CASES} GROUP BY 1 ORDER BY most DESC, n_name LIMIT 10")
def a25(spark, sf):
    return cases(spark, sf).groupBy("n_name").agg(F.count("*").alias("volume"), F.max("o_totalprice").alias("most")).orderBy(F.desc("most"), "n_name").limit(max(1, min(100, 10)))


@query("a26_upper_median_stats", "WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v FROM orders WHERE o_totalprice > 0 GROUP BY 1) SELECT o_orderpriority, len(v) AS n, v[1] AS least, v[-1] AS most, v[len(v) // 2 + 1] AS median FROM s")
def a26(spark, sf):
    return agg.upper_medians(table(spark, sf, "orders").where("o_totalprice > 0"), ["o_orderpriority"], "o_totalprice", "o_orderkey", stage)


@query("a27_rolling_median_health", """WITH d AS (SELECT event_type, ts::DATE AS day, isodow(ts::DATE) < 6 AS weekday, count(*) AS n FROM events GROUP BY 1, 2, 3),
h AS (SELECT *, list(n) OVER (PARTITION BY event_type, weekday ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS prev FROM d),
m AS (SELECT *, CASE WHEN len(prev) > 0 THEN list_median(prev) END AS med FROM h)
SELECT event_type, day, weekday, n, med::DOUBLE AS median, CASE WHEN med IS NULL THEN 'grey' WHEN n >= 0.7 * med THEN 'green' WHEN n >= 0.3 * med THEN 'yellow' ELSE 'red' END AS colour FROM m""")
def a27(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("weekday", F.weekday("day") < 5)
    w = Window.partitionBy("event_type", "weekday").orderBy("day").rowsBetween(-4, -1)
    s = F.sort_array(F.col("prev"))
    mid = lambda i: F.try_element_at(s, i.cast("int"))
    med = F.when(F.size("prev") > 0, (mid(F.floor((F.size("prev") + 1) / 2)) + mid(F.floor(F.size("prev") / 2) + 1)) / 2)
    d = d.withColumn("prev", F.collect_list("n").over(w)).withColumn("median", med.cast("double"))
    colour = F.when(F.col("median").isNull(), "grey").when(F.col("n") >= 0.7 * F.col("median"), "green").when(F.col("n") >= 0.3 * F.col("median"), "yellow").otherwise("red")
    return d.select("event_type", "day", "weekday", "n", "median", colour.alias("colour"))


@query("a28_global_beside_filtered", f"WITH f AS (SELECT n_name, count(*) AS n FROM {CASES} WHERE o_orderstatus = 'F' GROUP BY 1), g AS (SELECT count(*) AS all_cases, max(o_totalprice) AS most FROM orders) SELECT * FROM f, g")
def a28(spark, sf):
    f = cases(spark, sf).where("o_orderstatus = 'F'").groupBy("n_name").agg(F.count("*").alias("n"))
    g = table(spark, sf, "orders").agg(F.count("*").alias("all_cases"), F.max("o_totalprice").alias("most"))
    return f.crossJoin(F.broadcast(g))  # g is one row


@query("a29_nested_distinct_parents", "SELECT l_suppkey % 50 AS party, count(*) AS n_elements, count(DISTINCT l_orderkey) AS n_cases FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY 1 ORDER BY n_cases DESC, party LIMIT 20")
def a29(spark, sf):
    l = table(spark, sf, "lineitem")
    parents = l.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "l_linestatus", "l_returnflag")).alias("parts"))
    inside = F.filter("parts", lambda p: (p["l_linestatus"] == "F") & (p["l_returnflag"] == "R"))
    e = parents.select("l_orderkey", F.explode(inside).alias("p")).select("l_orderkey", (F.col("p.l_suppkey") % 50).alias("party"))
    return e.groupBy("party").agg(F.count("*").alias("n_elements"), F.countDistinct("l_orderkey").alias("n_cases")).orderBy(F.desc("n_cases"), "party").limit(20)


SPELLED = "(SELECT CASE s_suppkey % 4 WHEN 0 THEN upper(b) WHEN 1 THEN lower(b) WHEN 2 THEN b || '  LTDA' ELSE b END AS name FROM (SELECT s_suppkey, 'Company ' || (s_suppkey % 17) AS b FROM supplier))"


def spelled(spark, sf):
    b = F.concat(F.lit("Company "), (F.col("s_suppkey") % 17).cast("string"))
    k = F.col("s_suppkey") % 4
    return table(spark, sf, "supplier").select(F.when(k == 0, F.upper(b)).when(k == 1, F.lower(b)).when(k == 2, F.concat(b, F.lit("  LTDA"))).otherwise(b).alias("name"))


@query("a30_spelling_collapse", f"WITH k AS (SELECT name, trim(regexp_replace(regexp_replace(upper(name), ' LTDA$', ''), '\\s+', ' ', 'g')) AS key, count(*) AS n FROM {SPELLED} GROUP BY 1, 2), m AS (SELECT *, (name <> upper(name) AND name <> lower(name)) AS mixed FROM k) SELECT key, sum(n)::BIGINT AS n, first(name ORDER BY n DESC, mixed DESC, length(name) DESC, name DESC) AS label, count(*) AS spellings FROM m GROUP BY 1")
def a30(spark, sf):
    k = spelled(spark, sf).groupBy("name").agg(F.count("*").alias("n"))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.upper("name"), " LTDA$", ""), r"\s+", " "))
    mixed = (F.col("name") != F.upper("name")) & (F.col("name") != F.lower("name"))
    return k.withColumn("key", key).withColumn("mixed", mixed).groupBy("key").agg(F.sum("n").alias("n"), F.max_by("name", F.struct("n", "mixed", F.length("name"), "name")).alias("label"), F.count("*").alias("spellings"))


@query("a31_existence_coverage", "SELECT count(*) AS n, count(*) FILTER (WHERE url <> '') AS with_url, count(*) FILTER (WHERE html <> '' AND contains(html, '<title>')) AS with_title FROM pages")
def a31(spark, sf):
    return table(spark, sf, "pages").agg(F.count("*").alias("n"), agg.count_where(F.col("url") != "").alias("with_url"), agg.count_where((F.col("html") != "") & F.col("html").contains("<title>")).alias("with_title"))


@query("a32_limiting_field", "WITH c AS (SELECT avg(CASE WHEN p_size > 5 THEN 1.0 ELSE 0 END) AS size, avg(CASE WHEN p_retailprice > 1000 THEN 1.0 ELSE 0 END) AS price, avg(CASE WHEN p_brand <> '' THEN 1.0 ELSE 0 END) AS brand FROM part), u AS (SELECT 'size' AS field, size AS coverage FROM c UNION ALL SELECT 'price', price FROM c UNION ALL SELECT 'brand', brand FROM c) SELECT field, round(coverage, 6) AS coverage FROM u ORDER BY coverage, field LIMIT 1")
def a32(spark, sf):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    c = table(spark, sf, "part").agg(share(F.col("p_size") > 5).alias("size"), share(F.col("p_retailprice") > 1000).alias("price"), share(F.col("p_brand") != "").alias("brand"))
    u = c.unpivot([], ["size", "price", "brand"], "field", "coverage")
    return u.agg(F.min(F.struct("coverage", "field")).alias("m")).select("m.field", F.round("m.coverage", 6).alias("coverage"))


@query("a33_confusion", f"SELECT (score >= 0.5)::INT AS predicted, quality AS actual, count(*) AS n, round(avg(CASE WHEN (score >= 0.5)::INT = quality THEN 1.0 ELSE 0 END), 6) AS agreement FROM {SCORED} GROUP BY 1, 2")
def a33(spark, sf):
    p = (F.col("score") >= 0.5).cast("int")
    return scored(spark, sf).groupBy(p.alias("predicted"), F.col("quality").alias("actual")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(p == F.col("quality"), 1.0).otherwise(0.0)), 6).alias("agreement"))


@query("a34_ks", f"WITH v AS (SELECT lang, score, sum((quality = 1)::INT) AS a, sum((quality = 0)::INT) AS b FROM {SCORED} GROUP BY 1, 2), g AS (SELECT lang, a, b, abs(sum(a) OVER (PARTITION BY lang ORDER BY score) / nullif(sum(a) OVER (PARTITION BY lang), 0) - sum(b) OVER (PARTITION BY lang ORDER BY score) / nullif(sum(b) OVER (PARTITION BY lang), 0)) AS gap FROM v) SELECT lang, round(max(gap), 6) AS ks, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM g GROUP BY 1")
def a34(spark, sf):
    return agg.kolmogorov_smirnov(scored(spark, sf).withColumn("good", F.col("quality") == 1), "score", "good", ["lang"], stage)


@query("a35_auc", f"WITH o AS (SELECT quality AS y, sum(quality) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp FROM {SCORED}) SELECT round(sum(CASE WHEN y = 0 THEN tp END) / (sum(y) * sum(1 - y)), 6) AS auc FROM o")
def a35(spark, sf):
    return agg.roc_auc(scored(spark, sf), "score", "quality", "doc_id", stage).select(F.round("auc", 6).alias("auc"))


@query("a36_precision_at_k", f"WITH r AS (SELECT quality, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM {SCORED}) SELECT k::INT AS k, round(avg(quality) FILTER (WHERE rn <= k), 6) AS precision FROM r, (SELECT unnest([10, 50, 100]) AS k) GROUP BY k")
def a36(spark, sf):
    top = scored(spark, sf).orderBy(F.desc("score"), "doc_id").limit(100).select("quality", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rn"))
    k = F.explode(F.array(F.lit(10), F.lit(50), F.lit(100)))
    return top.select("quality", "rn", k.alias("k")).where("rn <= k").groupBy("k").agg(F.round(F.avg("quality"), 6).alias("precision"))


@query("a37_ece", f"WITH b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(quality) AS q FROM {SCORED} GROUP BY 1) SELECT round(sum(n * abs(s - q)) / sum(n), 6) AS ece FROM b")
def a37(spark, sf):
    b = scored(spark, sf).groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("quality").alias("q"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("s") - F.col("q"))) / F.sum("n"), 6).alias("ece"))


@query("a38_conformal", f"SELECT lang, round(quantile_cont(abs(score - quality), 0.9), 6) AS q90 FROM {SCORED} GROUP BY 1")
def a38(spark, sf):
    return scored(spark, sf).groupBy("lang").agg(F.round(F.percentile(F.abs(F.col("score") - F.col("quality")), 0.9), 6).alias("q90"))


@query("a39_threshold_grid", f"SELECT t::INT AS threshold_pct, count(*) FILTER (WHERE score * 1000 >= t * 10) AS chosen, count(*) FILTER (WHERE score * 1000 >= t * 10 AND quality = 1) AS hits FROM {SCORED}, (SELECT unnest(range(10, 91, 5)) AS t) GROUP BY 1")
def a39(spark, sf):
    # counts by score first: the grid then meets at most 1000 rows
    per = scored(spark, sf).groupBy((F.col("score") * 1000).alias("m")).agg(F.count("*").alias("n"), F.sum("quality").alias("q"))
    g = per.select("m", "n", "q", F.explode(F.sequence(F.lit(10), F.lit(90), F.lit(5))).alias("threshold_pct"))
    ok = F.col("m") >= F.col("threshold_pct") * 10
    return g.groupBy("threshold_pct").agg(F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("chosen"), F.coalesce(F.sum(F.when(ok, F.col("q"))), F.lit(0)).alias("hits"))


@query("a40_brier_prf", f"SELECT round(avg((score - quality) * (score - quality)), 6) AS brier, round(sum((score >= 0.5 AND quality = 1)::INT) / sum((score >= 0.5)::INT), 6) AS precision, round(sum((score >= 0.5 AND quality = 1)::INT) / sum(quality), 6) AS recall, round(2 * sum((score >= 0.5 AND quality = 1)::INT) / (sum((score >= 0.5)::INT) + sum(quality)), 6) AS f1 FROM {SCORED}")
def a40(spark, sf):
    p, y = (F.col("score") >= 0.5).cast("int"), F.col("quality")
    d = scored(spark, sf).agg(F.avg((F.col("score") - y) * (F.col("score") - y)).alias("b"), F.sum(p * y).alias("tp"), F.sum(p).alias("p"), F.sum(y).alias("y"))
    return d.select(F.round("b", 6).alias("brier"), agg.rate(F.col("tp"), F.col("p"), 6).alias("precision"), agg.rate(F.col("tp"), F.col("y"), 6).alias("recall"), agg.rate(2 * F.col("tp"), F.col("p") + F.col("y"), 6).alias("f1"))


SURVIVAL = f"(SELECT r_name AS stratum, date_diff('day', o_orderdate::DATE, DATE '2001-12-31') % 900 AS days, (o_orderstatus = 'F')::INT AS event FROM {CASES})"


def survival_rows(spark, sf):
    return cases(spark, sf).select(F.col("r_name").alias("stratum"), (F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate")) % 900).alias("days"), (F.col("o_orderstatus") == "F").cast("int").alias("event"))


@query("a41_kaplan_meier", f"""WITH t AS (SELECT stratum, days, sum(event) AS d, count(*) AS n FROM {SURVIVAL} GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY days DESC) AS at_risk, sum(n) OVER (PARTITION BY stratum) AS total FROM t),
s AS (SELECT *, CASE WHEN sum((d = at_risk)::INT) OVER w > 0 THEN 0.0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END AS surv FROM r WHERE total >= 200 WINDOW w AS (PARTITION BY stratum ORDER BY days))
SELECT stratum, max(total)::BIGINT AS n, round(coalesce(min(surv) FILTER (WHERE days <= 365), 1.0), 6) AS alive_365, round(coalesce(min(surv) FILTER (WHERE days <= 730), 1.0), 6) AS alive_730, min(days) FILTER (WHERE surv <= 0.5)::INT AS median_days FROM s GROUP BY 1""")
def a41(spark, sf):
    from lexmill.operators.survival import kaplan_meier

    k = kaplan_meier(survival_rows(spark, sf), "stratum", "days", "event", least=200)
    alive = lambda h: F.round(F.coalesce(F.min(F.when(F.col("days") <= h, F.col("surv"))), F.lit(1.0)), 6)
    return k.groupBy("stratum").agg(F.max("total").alias("n"), alive(365).alias("alive_365"), alive(730).alias("alive_730"), F.min(F.when(F.col("surv") <= 0.5, F.col("days"))).alias("median_days"))


@query("a42_year_histogram", "SELECT CASE WHEN y BETWEEN 1996 AND 2000 THEN y::VARCHAR ELSE 'out of range' END AS bucket, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY 1")
def a42(spark, sf):
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.when(y.between(1996, 2000), y.cast("string")).otherwise("out of range").alias("bucket")).agg(F.count("*").alias("n"))


@query("a43_completeness", "WITH run AS (SELECT user_id % 12 AS court, ts::DATE AS day, count(*) AS items, count(DISTINCT user_id) AS pages, max(ts) AS finished FROM events GROUP BY 1, 2, hour(ts) % 3), last AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY court, day ORDER BY finished DESC) = 1) SELECT court, count(*) AS days, count(*) FILTER (WHERE items / pages >= 1.5) AS full_days, count(*) FILTER (WHERE items / pages >= 1.2) AS fair_days FROM last GROUP BY 1")
def a43(spark, sf):
    run = table(spark, sf, "events").groupBy((F.col("user_id") % 12).alias("court"), F.to_date("ts").alias("day"), (F.hour("ts") % 3).alias("shift")).agg(F.count("*").alias("items"), F.countDistinct("user_id").alias("pages"), F.max("ts").alias("finished"))
    last = run.groupBy("court", "day").agg(F.max_by(F.struct("items", "pages"), "finished").alias("x")).select("court", (F.col("x.items") / F.col("x.pages")).alias("r"))
    return last.groupBy("court").agg(F.count("*").alias("days"), agg.count_where(F.col("r") >= 1.5).alias("full_days"), agg.count_where(F.col("r") >= 1.2).alias("fair_days"))


@query("a44_status_by_source", f"SELECT n_name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, round(100.0 * count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) / count(*), 4) AS resolved_pct, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM {CASES} GROUP BY 1")
def a44(spark, sf):
    s = F.col("o_orderstatus")
    return cases(spark, sf).groupBy("n_name").agg(F.count("*").alias("n"), agg.count_where(s == "F").alias("ok"), F.round(100.0 * agg.count_where(s.isin("F", "P")) / F.count("*"), 4).alias("resolved_pct"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("a45_enrichment_coverage", f"WITH c AS (SELECT n_name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus <> 'O') AS fp FROM {CASES} GROUP BY 1) SELECT n_name, n, CASE WHEN n_name < 'J' THEN f ELSE fp END AS done, round(100.0 * CASE WHEN n_name < 'J' THEN f ELSE fp END / n, 4) AS pct, row_number() OVER (ORDER BY (n_name < 'J') DESC, CASE WHEN n_name < 'J' THEN f ELSE fp END / n, n_name)::INT AS place FROM c")
def a45(spark, sf):
    c = cases(spark, sf).groupBy("n_name").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    first = F.col("n_name") < "J"
    c = c.withColumn("n", F.col("F") + F.col("O") + F.col("P")).withColumn("done", F.when(first, F.col("F")).otherwise(F.col("F") + F.col("P")))
    return c.select("n_name", "n", "done", F.round(100.0 * F.col("done") / F.col("n"), 4).alias("pct"), F.row_number().over(Window.orderBy(first.desc(), F.col("done") / F.col("n"), "n_name")).alias("place"))


@query("a46_kpi_delta", "WITH m AS (SELECT max(ts) AS t FROM events), k AS (SELECT count(*) FILTER (WHERE ts > t - INTERVAL 1 DAY) AS now_n, count(*) FILTER (WHERE ts > t - INTERVAL 2 DAY AND ts <= t - INTERVAL 1 DAY) AS prev_n, count(DISTINCT user_id) FILTER (WHERE ts > t - INTERVAL 1 DAY) AS now_users FROM events, m) SELECT *, CASE WHEN prev_n > 0 THEN round(100.0 * (now_n - prev_n) / prev_n, 4) END AS delta_pct FROM k")
def a46(spark, sf):
    e = table(spark, sf, "events")
    d = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("t"))))  # one row
    now = F.col("ts") > F.col("t") - F.expr("INTERVAL 1 DAY")
    prev = (F.col("ts") > F.col("t") - F.expr("INTERVAL 2 DAYS")) & ~now
    k = d.agg(agg.count_where(now).alias("now_n"), agg.count_where(prev).alias("prev_n"), F.countDistinct(F.when(now, F.col("user_id"))).alias("now_users"))
    return k.withColumn("delta_pct", F.when(F.col("prev_n") > 0, F.round(100.0 * (F.col("now_n") - F.col("prev_n")) / F.col("prev_n"), 4)))


@query("a47_ingestion_kpis", "SELECT round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 4) AS success_pct, count(DISTINCT ts::DATE) AS days, round(avg(value), 4) AS avg_duration, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events")
def a47(spark, sf):
    bad = F.col("event_type") == "error"
    return table(spark, sf, "events").agg(F.round(100.0 * agg.count_where(~bad) / F.count("*"), 4).alias("success_pct"), F.countDistinct(F.to_date("ts")).alias("days"), F.round(F.avg("value"), 4).alias("avg_duration"), agg.count_where(bad).alias("failures"))


@query("a48_batch_progress", "SELECT conv_id % 20 AS batch, count(DISTINCT conv_id) AS members, count(DISTINCT CASE WHEN role = 'assistant' THEN conv_id END) AS answered, count(DISTINCT CASE WHEN turn >= 3 THEN conv_id END) AS long FROM conversations GROUP BY 1")
def a48(spark, sf):
    return table(spark, sf, "conversations").groupBy((F.col("conv_id") % 20).alias("batch")).agg(F.countDistinct("conv_id").alias("members"), F.countDistinct(F.when(F.col("role") == "assistant", F.col("conv_id"))).alias("answered"), F.countDistinct(F.when(F.col("turn") >= 3, F.col("conv_id"))).alias("long"))


@query("a49_type_rate", f"SELECT n_name, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS hits, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS rate_pct FROM {CASES} GROUP BY 1, 2")
def a49(spark, sf):
    hit = agg.count_where(F.col("o_orderstatus") == "F")
    return cases(spark, sf).groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), hit.alias("hits"), F.round(100.0 * hit / F.count("*"), 4).alias("rate_pct"))


@query("a50_refresh_touched", "SELECT l_orderkey, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') GROUP BY 1")
def a50(spark, sf):
    touched = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("l_orderkey"))
    l = table(spark, sf, "lineitem").join(touched, "l_orderkey", "left_semi")
    return l.groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"), F.count("*").alias("n"))


@query("a51_timeline_year", "SELECT o_custkey, year(o_orderdate)::INT AS y, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_custkey = 7 GROUP BY 1, 2")
def a51(spark, sf):
    return table(spark, sf, "orders").where("o_custkey = 7").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


@query("a52_rhythm", "SELECT user_id, count(*) AS n, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS span_days, CASE WHEN count(*) > 1 THEN round(date_diff('day', min(ts)::DATE, max(ts)::DATE) / (count(*) - 1), 4) END AS days_between FROM events GROUP BY 1")
def a52(spark, sf):
    span = F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), span.alias("span_days"), F.when(F.count("*") > 1, F.round(span / (F.count("*") - 1), 4)).alias("days_between"))


@query("a53_label_stats", "SELECT 'quality' AS field, quality::VARCHAR AS value, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM labels GROUP BY 2 UNION ALL SELECT 'both', quality || '/' || toxic, count(*) FROM labels GROUP BY 2")
def a53(spark, sf):
    l = table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    by = lambda f, c: l.groupBy(c.alias("value")).agg(F.sum("n").alias("n")).select(F.lit(f).alias("field"), "value", "n")
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")
    return by("quality", q).unionByName(by("toxic", t)).unionByName(by("both", F.concat(q, F.lit("/"), t)))


@query("a54_failure_census", "(SELECT 'user' AS census, (user_id % 20)::VARCHAR AS key, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 2 ORDER BY n DESC, key LIMIT 15) UNION ALL (SELECT 'day', strftime(ts, '%Y-%m-%d') AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 2 ORDER BY n DESC, k LIMIT 30) UNION ALL (SELECT 'message', props AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 2 ORDER BY n DESC, k LIMIT 10)")
def a54(spark, sf):
    bad = table(spark, sf, "events").where("event_type = 'error'")
    out = None
    for name, key, n in (("user", (F.col("user_id") % 20).cast("string"), 15), ("day", F.date_format("ts", "yyyy-MM-dd"), 30), ("message", F.col("props"), 10)):
        one = agg.facet(bad.select(key.alias("key")), "key", n, "n").select(F.lit(name).alias("census"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a55_audit_chunks", "WITH d AS (SELECT (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) // 90)::INT AS chunk, count(*) AS declared FROM orders GROUP BY 1), g AS (SELECT (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // 90)::INT AS chunk, count(DISTINCT l_orderkey) AS ingested FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT chunk, coalesce(declared, 0) AS declared, coalesce(ingested, 0) AS ingested, coalesce(declared, 0) - coalesce(ingested, 0) AS gap, CASE WHEN coalesce(declared, 0) > 0 THEN round(100.0 * (coalesce(declared, 0) - coalesce(ingested, 0)) / declared, 4) END AS gap_pct, coalesce(CASE WHEN declared > 0 THEN 100.0 * (declared - coalesce(ingested, 0)) / declared > 5 END, false) AS flagged FROM d FULL JOIN g USING (chunk)")
def a55(spark, sf):
    chunk = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1995-01-01").cast("date")) / 90).cast("int").alias("chunk")
    d = table(spark, sf, "orders").groupBy(chunk("o_orderdate")).agg(F.count("*").alias("declared"))
    g = table(spark, sf, "lineitem").where("l_linenumber = 1").groupBy(chunk("l_shipdate")).agg(F.countDistinct("l_orderkey").alias("ingested"))
    j = d.join(g, "chunk", "full").select("chunk", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("ingested", F.lit(0)).alias("ingested"))
    pct = F.when(F.col("declared") > 0, 100.0 * (F.col("declared") - F.col("ingested")) / F.col("declared"))
    return j.select("*", (F.col("declared") - F.col("ingested")).alias("gap"), F.round(pct, 4).alias("gap_pct"), F.coalesce(pct > 5, F.lit(False)).alias("flagged"))


@query("a56_coverage_ladder", f"WITH d AS (SELECT n_name, count(*) AS declared, count(*) FILTER (WHERE o_orderkey % 97 <> 0 AND n_name <> 'CHINA') AS have FROM {CASES} GROUP BY 1), a AS (SELECT * FROM d UNION ALL SELECT 'total', sum(declared)::BIGINT, sum(have)::BIGINT FROM d) SELECT n_name AS court, declared, have, CASE WHEN have = 0 THEN 'empty' WHEN have / declared >= 0.995 THEN 'ok' WHEN have / declared >= 0.9 THEN 'partial' ELSE 'missing' END AS state FROM a")
def a56(spark, sf):
    d = cases(spark, sf).groupBy("n_name").agg(F.count("*").alias("declared"), agg.count_where((F.col("o_orderkey") % 97 != 0) & (F.col("n_name") != "CHINA")).alias("have"))
    a = d.unionByName(d.agg(F.lit("total").alias("n_name"), F.sum("declared").alias("declared"), F.sum("have").alias("have")))
    r = F.col("have") / F.col("declared")
    return a.select(F.col("n_name").alias("court"), "declared", "have", F.when(F.col("have") == 0, "empty").when(r >= 0.995, "ok").when(r >= 0.9, "partial").otherwise("missing").alias("state"))


@query("a57_derived_facets", "SELECT count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05 AND l_returnflag = 'R') AS assigned, count(*) FILTER (WHERE l_tax = 0) AS exempt, count(*) FILTER (WHERE l_quantity >= 40) AS large FROM lineitem WHERE l_linestatus = 'F'")
def a57(spark, sf):
    l = table(spark, sf, "lineitem").where("l_linestatus = 'F'")
    return l.agg(F.count("*").alias("n"), agg.count_where((F.col("l_discount") > 0.05) & (F.col("l_returnflag") == "R")).alias("assigned"), agg.count_where(F.col("l_tax") == 0).alias("exempt"), agg.count_where(F.col("l_quantity") >= 40).alias("large"))


@query("a58_index_coverage", "SELECT i.n AS indexed, d.n AS rows_n, round(least(100.0, 100.0 * i.n / d.n), 4) AS pct, greatest(0, d.n - i.n) AS pending FROM (SELECT count(*) AS n FROM labels) i, (SELECT count(*) AS n FROM documents) d")
def a58(spark, sf):
    i, d = table(spark, sf, "labels").agg(F.count("*").alias("indexed")), table(spark, sf, "documents").agg(F.count("*").alias("rows_n"))
    j = i.crossJoin(d)  # one row each
    return j.select("indexed", "rows_n", F.round(F.least(F.lit(100.0), 100.0 * F.col("indexed") / F.col("rows_n")), 4).alias("pct"), F.greatest(F.lit(0), F.col("rows_n") - F.col("indexed")).alias("pending"))


@query("a59_latest_run_health", "WITH m AS (SELECT max(ts) AS t FROM events), r AS (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_type, (date_diff('second', ts, t) // 3600)::BIGINT AS lag_hours, date_diff('second', ts, t) > 36 * 3600 OR event_type = 'error' AS unhealthy FROM r, m")
def a59(spark, sf):
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x"))
    d = last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("t")))).select("user_id", "x.event_type", dates.second_diff(F.col("x.ts"), F.col("t")).alias("lag"))  # one row
    return d.select("user_id", "event_type", F.floor(F.col("lag") / 3600).alias("lag_hours"), ((F.col("lag") > 36 * 3600) | (F.col("event_type") == "error")).alias("unhealthy"))


@query("a60_lead_stats", "SELECT o_orderpriority AS level, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS pending, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS validation_rate FROM orders GROUP BY 1")
def a60(spark, sf):
    used = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("used", F.lit(True))
    o = table(spark, sf, "orders").join(used, "o_orderkey", "left")
    return o.groupBy(F.col("o_orderpriority").alias("level")).agg(agg.count_where(F.col("used").isNull()).alias("pending"), F.count("*").alias("n"), agg.rate(agg.count_where(F.col("o_orderstatus") == "F"), F.count("*"), 6).alias("validation_rate"))


@query("a61_party_record", "SELECT s_name, o_orderpriority, count(DISTINCT o_orderkey) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def a61(spark, sf):
    s = table(spark, sf, "supplier")
    j = table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("s_name", "o_orderpriority").agg(F.countDistinct("o_orderkey").alias("n"))


@query("a62_entity_search", "WITH h AS (SELECT DISTINCT l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 10 = 3) SELECT l_orderkey, string_agg(s_name, '; ' ORDER BY s_name) AS parties, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, l_orderkey LIMIT 25")
def a62(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 10 = 3")
    h = table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_name").distinct()
    return h.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "; ").alias("parties"), F.count("*").alias("n")).orderBy(F.desc("n"), "l_orderkey").limit(25)
