"""Scans, predicates, joins, windows, paging, sets and precomputed views (S, P, J, W, O, U, V)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.io import scratch, stage, table
from lexmill.operators import aggregates as agg
from lexmill.operators import relational as rel
from lexmill.plans.aggregates import CASES, cases, cents
from lexmill.plans.base import query

NTZ = "timestamp_ntz"


def ts(x):
    return F.lit(x).cast(NTZ)


# scans, sources and sinks


@query("s01_filtered_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def s01(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("s02_projected_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49")
def s02(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_linenumber")


@query("s05_csv_header_column", "SELECT DISTINCT o_orderkey AS id FROM orders")
def s05(spark, sf):
    from lexmill.sources.files import read_id_csv

    path = scratch(spark)
    table(spark, sf, "orders").select(F.lit("x").alias("note"), F.col("o_orderkey").alias("Case_ID")).write.option("header", True).csv(path)
    return read_id_csv(spark, path, ["case_id", "id"]).select(F.col("value").cast("long").alias("id")).distinct()


@query("s06_csv_first_column", "SELECT lpad(o_orderkey::VARCHAR, 8, '0') AS id FROM orders WHERE o_orderkey % 3 = 0")
def s06(spark, sf):
    from lexmill.sources.files import read_first_column

    path = scratch(spark)
    o = table(spark, sf, "orders")
    o.select(F.when(F.col("o_orderkey") % 3 == 0, F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).otherwise("not a number").alias("a"), F.lit("b").alias("b")).write.csv(path)
    return read_first_column(spark, path, r"^\d{8}$").withColumnRenamed("value", "id")


@query("s07_jsonl_gz", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def s07(spark, sf):
    path = scratch(spark)
    table(spark, sf, "events").select("user_id", "event_type").write.option("compression", "gzip").json(path)
    return spark.read.schema("user_id long, event_type string").json(path).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("s08_json_to_parquet", "SELECT s_suppkey, s_name FROM supplier")
def s08(spark, sf):
    from lexmill.sources.files import to_parquet

    a, b = scratch(spark), scratch(spark)
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.json(a)
    to_parquet(spark, a, "json", "s_suppkey long, s_name string", b)
    return spark.read.parquet(b)


@query("s10_timestamp_sweep", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def s10(spark, sf):
    # windows that overlap by an hour re-read their tail; the id makes the rows one again
    e = table(spark, sf, "events").select("event_id", "ts")
    a = e.where((F.col("ts") >= ts("2024-01-10")) & (F.col("ts") < ts("2024-01-11 01:00:00")))
    b = e.where((F.col("ts") >= ts("2024-01-11")) & (F.col("ts") < ts("2024-01-12")))
    return a.unionByName(b).dropDuplicates(["event_id"])


@query("s11_flatten_nested", "SELECT l_orderkey AS case_id, l_linenumber AS code, l_shipdate::DATE AS day FROM lineitem")
def s11(spark, sf):
    l = table(spark, sf, "lineitem")
    doc = l.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_linenumber").alias("code"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")))).alias("movements"))
    m = doc.select(F.col("l_orderkey").alias("case_id"), F.explode(F.from_json("movements", "array<struct<code:int,day:date>>")).alias("m"))
    return m.select("case_id", "m.code", "m.day")


@query("s12_tolerant_access", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def s12(spark, sf):
    from lexmill.functions.numbers import first_of

    e = table(spark, sf, "events")
    shape = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[["), F.col("props"), F.lit("]]"))).otherwise(F.col("props"))
    return e.select("event_id", first_of(shape, "k").cast("long").alias("k"))


@query("s14_partitioned_sink", "SELECT (user_id % 4)::BIGINT AS part, count(*) AS n FROM events GROUP BY 1")
def s14(spark, sf):
    path = scratch(spark)
    e = table(spark, sf, "events").withColumn("part", F.pmod("user_id", F.lit(4)))
    e.repartition(4, "part").write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"))


@query("s15_idempotent_sink", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def s15(spark, sf):
    from lexmill.sources.files import read_upserted, upsert_parquet

    path = scratch(spark)
    e = table(spark, sf, "events").select("user_id", "event_id")
    for batch in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), e.where("event_id % 2 = 1")):
        upsert_parquet(spark, path, batch, ["user_id"], "event_id")
    return read_upserted(spark, path)


@query("s17_csv_export", "SELECT o_orderkey, o_orderpriority, last_ship::DATE AS last_ship FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def s17(spark, sf):
    path = scratch(spark)
    last = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("last_ship"))
    table(spark, sf, "orders").join(last, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", "last_ship").write.option("header", True).csv(path)
    return spark.read.schema("o_orderkey long, o_orderpriority string, last_ship date").option("header", True).csv(path)


@query("s18_training_csv", "SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS good, CASE WHEN toxic = 1 THEN 'true' END AS toxic FROM labels")
def s18(spark, sf):
    path = scratch(spark)
    table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), F.when(F.col("toxic") == 1, True).alias("toxic")).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return spark.read.schema("doc_id long, good string, toxic string").option("header", True).option("nullValue", "").csv(path)


@query("s20_sample_scan")
def s20(spark, sf):
    return table(spark, sf, "lineitem").sample(0.02, seed=7).select("l_orderkey", "l_linenumber")


@query("s21_row_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def s21(spark, sf):
    one = lambda t: table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("orders").unionByName(one("lineitem"))


# predicates


@query("p01_default_courts", "SELECT count(*) AS n FROM " + CASES + " WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def p01(spark, sf):
    active = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select("n_name")
    return cases(spark, sf).join(active, "n_name", "left_semi").agg(F.count("*").alias("n"))


@query("p02_rolling_window", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def p02(spark, sf):
    return table(spark, sf, "events").where(F.col("ts") >= ts("2024-01-20")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("p03_date_cast", "SELECT count(*) AS n FROM events WHERE ts::DATE >= DATE '2024-01-15'")
def p03(spark, sf):
    return table(spark, sf, "events").where(F.to_date("ts") >= F.lit("2024-01-15").cast("date")).agg(F.count("*").alias("n"))


@query("p04_civil_day", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 03:00:00' AND ts < TIMESTAMP '2024-01-16 03:00:00'")
def p04(spark, sf):
    from lexmill.functions.dates import civil_day

    a, b = civil_day("2024-01-15", "America/Sao_Paulo")
    return table(spark, sf, "events").where((F.col("ts") >= ts(a)) & (F.col("ts") < ts(b))).select("event_id")


@query("p05_plausible_dates", "SELECT count(*) FILTER (WHERE y BETWEEN 1996 AND 2000) AS inside, count(*) FILTER (WHERE y NOT BETWEEN 1996 AND 2000) AS outside, min(CASE WHEN y BETWEEN 1996 AND 2000 THEN y END)::INT AS first_year FROM (SELECT year(l_shipdate) AS y FROM lineitem)")
def p05(spark, sf):
    y = F.year("l_shipdate")
    ok = y.between(1996, 2000)
    return table(spark, sf, "lineitem").agg(agg.count_where(ok).alias("inside"), agg.count_where(~ok).alias("outside"), F.min(F.when(ok, y)).alias("first_year"))


@query("p06_nonempty", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY 1")
def p06(spark, sf):
    return table(spark, sf, "part").where("p_brand <> ''").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("p07_filled", "SELECT count(*) FILTER (WHERE text IS NOT NULL AND text <> '') AS filled, count(*) AS n FROM documents")
def p07(spark, sf):
    return table(spark, sf, "documents").agg(agg.count_where(F.col("text").isNotNull() & (F.col("text") != "")).alias("filled"), F.count("*").alias("n"))


@query("p08_unknown_is_null", "WITH f AS (SELECT n_name, CASE WHEN n_name < 'C' THEN NULL WHEN o_orderstatus = 'F' THEN true ELSE false END AS flag FROM " + CASES + ") SELECT n_name, CASE WHEN count(flag) > 0 THEN count(*) FILTER (WHERE flag) END AS potential FROM f GROUP BY 1")
def p08(spark, sf):
    f = cases(spark, sf).select("n_name", F.when(F.col("n_name") < "C", F.lit(None).cast("boolean")).otherwise(F.col("o_orderstatus") == "F").alias("flag"))
    return f.groupBy("n_name").agg(agg.known_count(F.col("flag")).alias("potential"))


@query("p09_union_lens", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_totalprice > 200000) AS b, count(*) FILTER (WHERE o_orderstatus = 'F' OR o_totalprice > 200000) AS either FROM orders")
def p09(spark, sf):
    a, b = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000
    return table(spark, sf, "orders").agg(agg.count_where(a).alias("a"), agg.count_where(b).alias("b"), agg.count_where(a | b).alias("either"))


@query("p10_sanitised_ranges", "SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND year(o_orderdate) BETWEEN 1996 AND 1999")
def p10(spark, sf):
    from lexmill.operators.filters import ranges

    return table(spark, sf, "orders").where(ranges({"value_min": "200000", "value_max": "100000", "year_min": "1996", "year_max": "1999", "junk": "x"}, value=F.col("o_totalprice"), year=F.year("o_orderdate"))).agg(F.count("*").alias("n"))


@query("p11_same_element", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 48")
def p11(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_quantity")).alias("parts"))
    return l.where(F.exists("parts", lambda p: (p["l_returnflag"] == "R") & (p["l_linestatus"] == "F") & (p["l_quantity"] > 48))).select("l_orderkey")


@query("p12_prefix_terms", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%' AND p_size IN (1, 2, 3)")
def p12(spark, sf):
    return table(spark, sf, "part").where(F.col("p_type").startswith("S") & F.col("p_size").isin(1, 2, 3)).select("p_partkey")


@query("p13_folded_contains", "SELECT doc_id FROM documents WHERE regexp_matches(lower(strip_accents(text)), '(?s)licensed.*version')")
def p13(spark, sf):
    from lexmill.functions.text import contains_in_order

    return table(spark, sf, "documents").where(contains_in_order(F.col("text"), "Licensed  vérsion")).select("doc_id")


@query("p20_contains_any_column", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%00012%' OR c_mktsegment ILIKE '%mach%'")
def p20(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").ilike("%00012%") | F.col("c_mktsegment").ilike("%mach%")).select("c_custkey")


@query("p21_iexact", "SELECT count(*) AS n FROM orders WHERE lower(o_orderpriority) = lower('1-Urgent')")
def p21(spark, sf):
    return table(spark, sf, "orders").where(F.lower("o_orderpriority") == "1-urgent").agg(F.count("*").alias("n"))


@query("p22_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)released under the [a-z]+ license')")
def p22(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike("(?i)released under the [a-z]+ license")).select("doc_id")


@query("p23_null_safe_equal", "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_suppkey END AS a, CASE WHEN l_discount > 0.05 THEN l_suppkey END AS b FROM lineitem) SELECT count(*) FILTER (WHERE a IS NOT DISTINCT FROM b) AS same, count(*) FILTER (WHERE a = b) AS equal FROM x")
def p23(spark, sf):
    x = table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") > 25, F.col("l_suppkey")).alias("a"), F.when(F.col("l_discount") > 0.05, F.col("l_suppkey")).alias("b"))
    return x.agg(agg.count_where(F.col("a").eqNullSafe(F.col("b"))).alias("same"), agg.count_where(F.col("a") == F.col("b")).alias("equal"))


@query("p24_mask_match", "WITH s AS (SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 6, '0') AS real, substr(lpad(s_suppkey::VARCHAR, 6, '0'), 1, 5) || 'X' AS masked FROM supplier) SELECT a.s_suppkey AS masked_key, count(*) AS n FROM s a JOIN s b ON substr(a.real, 1, 4) = substr(b.real, 1, 4) AND b.real LIKE translate(a.masked, 'Xx*', '___') GROUP BY 1")
def p24(spark, sf):
    real = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    s = table(spark, sf, "supplier").select("s_suppkey", real.alias("real"), F.concat(F.substring(real, 1, 5), F.lit("X")).alias("masked"), F.substring(real, 1, 4).alias("root"))
    j = s.select(F.col("s_suppkey").alias("masked_key"), "masked", "root").join(s.select("real", "root"), "root").where(rel.mask_matches(F.col("masked"), F.col("real")))
    return j.groupBy("masked_key").agg(F.count("*").alias("n"))


@query("p25_order_by_position", "SELECT o_orderkey, p::INT AS place FROM orders JOIN (SELECT unnest([7, 3, 1, 5]) AS k, unnest([0, 1, 2, 3]) AS p) ON o_orderkey = k ORDER BY p")
def p25(spark, sf):
    place = spark.createDataFrame([(7, 0), (3, 1), (1, 2), (5, 3)], "o_orderkey long, place int")
    return table(spark, sf, "orders").join(F.broadcast(place), "o_orderkey").select("o_orderkey", "place").orderBy("place")


@query("p27_lead_filter", "SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000 AND c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def p27(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 100000))
    used = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(c, "o_custkey", "left_semi").join(used, "o_orderkey", "left_anti").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("p28_chip_counts", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS shown FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def p28(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 100000").groupBy("o_orderstatus").agg(F.count("*").alias("n"), agg.count_where(F.col("o_orderpriority") == "1-URGENT").alias("shown"))


# joins


@query("j01_inner_key", "SELECT l.quality, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def j01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("j02_tiny_dimension", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j02(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("j03_full_outer_kpis", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) SELECT coalesce(a.k, b.k) AS nation, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM a FULL JOIN b ON a.k = b.k")
def j03(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    b = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nation", "full").select("nation", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


@query("j04_left_remap", "SELECT l_orderkey, l_linenumber, coalesce(keep, l_suppkey) AS party FROM lineitem LEFT JOIN (SELECT s_suppkey, s_suppkey % 10 AS keep FROM supplier WHERE s_suppkey > 20) ON l_suppkey = s_suppkey")
def j04(spark, sf):
    m = table(spark, sf, "supplier").where("s_suppkey > 20").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 10).alias("keep"))
    return table(spark, sf, "lineitem").join(m, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("keep", "l_suppkey").alias("party"))


@query("j05_semi_bridge", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_returnflag = 'R')")
def j05(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(l, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("j06_anti_unconsumed", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j06(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("j07_exists_as_value", "SELECT conv_id, bool_or(regexp_matches(text, '[0-9]')) AS has_signal FROM conversations GROUP BY 1")
def j07(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False))).alias("has_signal"))


@query("j08_latest_child", "WITH m AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1) SELECT o_orderkey, l_shipdate::DATE AS last_day, l_returnflag, l_linestatus, l_suppkey FROM orders LEFT JOIN m ON l_orderkey = o_orderkey")
def j08(spark, sf):
    last = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by(F.struct(F.to_date("l_shipdate").alias("last_day"), "l_returnflag", "l_linestatus", "l_suppkey"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("m"))
    return table(spark, sf, "orders").select("o_orderkey").join(last, "o_orderkey", "left").select("o_orderkey", "m.*")


@query("j09_lateral_top1", "SELECT c_custkey, x.o_orderpriority FROM customer, LATERAL (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x")
def j09(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("o_orderpriority"))


@query("j10_masked_match", "WITH s AS (SELECT s_suppkey, 'n' || (s_suppkey % 40) AS name, CASE WHEN s_suppkey % 3 = 0 THEN substr(lpad((s_suppkey * 7919 % 100000)::VARCHAR, 6, '0'), 1, 2) || 'XXXX' END AS masked, CASE WHEN s_suppkey % 3 <> 0 THEN lpad((s_suppkey * 7919 % 100000)::VARCHAR, 6, '0') END AS real FROM supplier) SELECT a.s_suppkey, min(b.s_suppkey) AS merged_into FROM s a JOIN s b ON a.name = b.name AND b.real LIKE translate(a.masked, 'Xx*', '___') GROUP BY 1 HAVING count(*) = 1")
def j10(spark, sf):
    doc = F.lpad((F.col("s_suppkey") * 7919 % 100000).cast("string"), 6, "0")
    third = F.col("s_suppkey") % 3 == 0
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.when(third, F.concat(F.substring(doc, 1, 2), F.lit("XXXX"))).alias("masked"), F.when(~third, doc).alias("real"))
    a = s.where("masked IS NOT NULL").select("s_suppkey", "name", "masked")
    b = s.where("real IS NOT NULL").select(F.col("s_suppkey").alias("other"), "name", "real")
    j = a.join(b, "name").where(rel.mask_matches(F.col("masked"), F.col("real")))
    return j.groupBy("s_suppkey").agg(F.min("other").alias("merged_into"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("j11_keepers", "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keep FROM customer")
def j11(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.min("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment")).alias("keep"))


@query("j12_two_exclusions", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j12(spark, sf):
    a = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    b = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(a, "o_orderkey", "left_anti").join(b, "o_custkey", "left_anti").select("o_orderkey")


@query("j13_in_list", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT unnest(range(1, 2000, 7)))")
def j13(spark, sf):
    ids = spark.createDataFrame([(i,) for i in range(1, 2000, 7)], "o_orderkey long")
    return table(spark, sf, "orders").join(F.broadcast(ids), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("j14_lookup", "SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def j14(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, sf, "events").join(c, "user_id", "left").select("event_id", "c_name")


@query("j15_two_stores", "SELECT o_orderkey, o_orderstatus, n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j15(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return table(spark, sf, "orders").join(n, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "n_lines")


@query("j16_covered_days", "WITH r AS (SELECT o_orderkey % 5 AS court, o_orderdate::DATE AS a, o_orderdate::DATE + 3 AS b FROM orders) SELECT court, count(DISTINCT d) AS days FROM (SELECT court, unnest(generate_series(greatest(a, DATE '1996-01-01'), least(b, DATE '1998-12-31'), INTERVAL 1 DAY)) AS d FROM r WHERE greatest(a, DATE '1996-01-01') <= least(b, DATE '1998-12-31')) GROUP BY 1")
def j16(spark, sf):
    day = F.to_date("o_orderdate")
    r = table(spark, sf, "orders").select((F.col("o_orderkey") % 5).alias("court"), day.alias("a"), F.date_add(day, 3).alias("b"))
    return rel.covered_days(r, "a", "b", F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")).groupBy("court").agg(F.countDistinct("day").alias("days"))


@query("j17_denormalise", "SELECT o_orderkey, string_agg(s_name || '/' || l_returnflag, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parties FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def j17(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws("/", "s_name", "l_returnflag").alias("p")))).alias("x"))
    return g.join(table(spark, sf, "orders"), "o_orderkey", "left_semi").select("o_orderkey", F.array_join(F.col("x.p"), "; ").alias("parties"))


@query("j18_array_link", "WITH d AS (SELECT conv_id, list(DISTINCT turn * 10 + conv_id % 7) AS cited FROM conversations GROUP BY 1), e AS (SELECT conv_id, unnest(cited) AS k FROM d) SELECT DISTINCT conv_id, s_name FROM e JOIN supplier ON s_suppkey = k")
def j18(spark, sf):
    d = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set(F.col("turn") * 10 + F.col("conv_id") % 7).alias("cited"))
    e = d.select("conv_id", F.explode("cited").alias("s_suppkey"))
    return e.join(table(spark, sf, "supplier"), "s_suppkey").select("conv_id", "s_name").distinct()


@query("j21_reconcile", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def j21(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j22_spine", "WITH days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day), k AS (SELECT DISTINCT event_type FROM events), g AS (SELECT * FROM days, k WHERE isodow(day) < 6), c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT g.event_type, g.day, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.day = c.day")
def j22(spark, sf):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day")).where(F.weekday("day") < 5)
    e = table(spark, sf, "events")
    c = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rel.spine(days, e.select("event_type").distinct()).join(c, ["event_type", "day"], "left").select("event_type", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("j23_distinct_parents", "SELECT l_returnflag, count(*) AS elements, count(DISTINCT l_orderkey) AS parents FROM lineitem WHERE l_tax > 0.05 GROUP BY 1")
def j23(spark, sf):
    return table(spark, sf, "lineitem").where("l_tax > 0.05").groupBy("l_returnflag").agg(F.count("*").alias("elements"), F.countDistinct("l_orderkey").alias("parents"))


# latest per key and other windows


@query("w01_distinct_on", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w01(spark, sf):
    return rel.latest(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("w02_first_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def w02(spark, sf):
    return rel.latest(table(spark, sf, "events"), ["user_id"], F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "event_type")


@query("w03_survivor", "SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS survivor FROM supplier")
def w03(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.min("s_suppkey").over(Window.partitionBy("s_nationkey")).alias("survivor"))


@query("w04_filtered_window_count", "SELECT c_custkey, count(*) FILTER (WHERE c_acctbal < 0) OVER (PARTITION BY c_nationkey) AS n_negative FROM customer")
def w04(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.count(F.when(F.col("c_acctbal") < 0, 1)).over(Window.partitionBy("c_nationkey")).alias("n_negative"))


@query("w05_latest_in_batch", "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id BETWEEN 1000 AND 1999 GROUP BY 1")
def w05(spark, sf):
    return rel.latest(table(spark, sf, "events").where("event_id BETWEEN 1000 AND 1999"), ["user_id"], F.desc("event_id")).select("user_id", "event_id")


@query("w06_latest_log", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) = 1")
def w06(spark, sf):
    return rel.latest(table(spark, sf, "conversations"), ["conv_id"], F.desc("turn"), F.asc("role")).select("conv_id", "turn", "role")


@query("w07_previous_frame", "SELECT user_id, event_id, coalesce(sum(1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before FROM events")
def w07(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, -1)
    return table(spark, sf, "events").select("user_id", "event_id", F.count("*").over(w).alias("n_before"))


@query("w08_stratified_sample", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey)::INT AS place FROM orders QUALIFY place <= 20")
def w08(spark, sf):
    return rel.stratified(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 20, 42).select("o_orderkey", "o_orderpriority", "place")


@query("w09_ratio_to_max", "SELECT p_brand, p_type, n, round(n / max(n) OVER (PARTITION BY p_brand), 6) AS ratio FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)")
def w09(spark, sf):
    c = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return c.withColumn("ratio", F.round(F.col("n") / F.max("n").over(Window.partitionBy("p_brand")), 6))


@query("w10_priority_pick", "SELECT user_id, first(event_type ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END DESC, ts DESC, event_id DESC) AS label FROM events GROUP BY 1")
def w10(spark, sf):
    weight = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct(weight, "ts", "event_id")).alias("label"))


@query("w11_anchors", "SELECT user_id, event_type, arg_min(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS first_id, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last_id FROM (SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events) GROUP BY 1, 2")
def w11(spark, sf):
    k = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", k).alias("first_id"), F.max_by("event_id", k).alias("last_id"))


@query("w12_month_groups", "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS ids FROM orders GROUP BY 1, 2")
def w12(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x"))
    return g.select("o_custkey", "month", F.array_join(F.transform("x", lambda x: x["o_orderkey"].cast("string")), ",").alias("ids"))


# order, limit, pages


@query("o01_multi_key_order", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 30")
def o01(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("o02_missing_last", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer ORDER BY bal DESC NULLS LAST, c_custkey LIMIT 58")
def o02(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal")).orderBy(F.desc_nulls_last("bal"), "c_custkey").limit(58)


@query("o03_topn", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 7")
def o03(spark, sf):
    return agg.facet(table(spark, sf, "part"), "p_type", 7, "n")


@query("o04_limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100")
def o04(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(100).limit(50)


PAGE = "SELECT o_orderkey, v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 50000)::BIGINT END AS v FROM orders) ORDER BY v DESC NULLS LAST, o_orderkey LIMIT 60 OFFSET 60"


@query("o05_cursor", """SELECT o_orderkey, replace(replace(to_base64(encode('{"o": "-total,id", "v": [' || coalesce(v::VARCHAR, 'null') || ', "' || o_orderstatus || '", ' || o_orderkey || ']}')), '+', '-'), '/', '_') AS cursor FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 50000)::BIGINT END AS v FROM orders)""")
def o05(spark, sf):
    v = F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 50000))
    return table(spark, sf, "orders").select("o_orderkey", rel.cursor_of([v, F.col("o_orderstatus"), F.col("o_orderkey")], "-total,id").alias("cursor"))


@query("o06_keyset_page", PAGE)
def o06(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 50000)).alias("v"))
    first = rel.keyset_page(d, "v", "o_orderkey", None, 60)
    end = first.tail(1)
    cursor = rel.encode_cursor([end[0]["v"], end[0]["o_orderkey"]], "v") if end else None
    return rel.keyset_page(d, "v", "o_orderkey", rel.decode_cursor(cursor, "v") if cursor else None, 60)


@query("o07_cursor_date", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 40")
def o07(spark, sf):
    return table(spark, sf, "events").where(F.col("ts") < ts("2024-01-20")).select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(40)


@query("o08_page_and_total", "SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o08(spark, sf):
    d = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    page = d.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return page.crossJoin(d.agg(F.count("*").alias("total")))  # one row


@query("o09_truncated_signal", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) > 25 AS truncated FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 25")
def o09(spark, sf):
    return rel.capped(table(spark, sf, "orders").where("o_totalprice > 300000").select("o_orderkey"), 25, F.asc("o_orderkey"))


@query("o10_seeded_order", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || ':7'), c_custkey LIMIT 100")
def o10(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").orderBy(rel.hash_order("c_custkey", 7), "c_custkey").limit(100)


@query("o11_item_order", "SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':11'), c_custkey)::INT AS place FROM customer")
def o11(spark, sf):
    d = rel.running(table(spark, sf, "customer").select("c_custkey"), [rel.hash_order("c_custkey", 11), F.col("c_custkey")], {"before": F.lit(1)}, stage)
    return d.select("c_custkey", (F.col("before") + 1).cast("int").alias("place"))


# sets


@query("u01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u01(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("u02_union_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def u02(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, sf, "supplier").where("s_acctbal > 9000").select("s_nationkey")).distinct()


@query("u03_id_union", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 350000 UNION SELECT l_orderkey FROM lineitem WHERE l_extendedprice > 90000")
def u03(spark, sf):
    a = table(spark, sf, "orders").where("o_totalprice > 350000").select(F.col("o_orderkey").alias("id"))
    return a.union(table(spark, sf, "lineitem").where("l_extendedprice > 90000").select("l_orderkey")).distinct()


@query("u04_set_difference", "SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def u04(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().join(table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id")), "user_id", "left_anti")


@query("u05_key_drift", "SELECT event_id, list_aggregate(list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('a', 'b'))), 'string_agg', ',') AS extra, 'a,b' AS missing FROM events")
def u05(spark, sf):
    from lexmill.functions.numbers import key_drift

    extra, missing = key_drift(F.col("props"), ["a", "b"], [])
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(extra), ",").alias("extra"), F.array_join(F.array_sort(missing), ",").alias("missing"))


@query("u06_token_subset", "SELECT p_partkey FROM part WHERE list_has_all(string_split(lower(p_name), ' '), ['part'])")
def u06(spark, sf):
    from lexmill.functions.text import has_all_tokens

    return table(spark, sf, "part").where(has_all_tokens(F.split(F.lower("p_name"), " "), ["part"])).select("p_partkey")


@query("u07_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def u07(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


# precomputed views


@query("v01_daily_pipeline", "SELECT 'orders' AS source, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_shipdate::DATE, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'events', ts::DATE, count(*) FROM events GROUP BY 2")
def v01(spark, sf):
    out = None
    for name, t, c in (("orders", "orders", "o_orderdate"), ("lines", "lineitem", "l_shipdate"), ("events", "events", "ts")):
        one = table(spark, sf, t).groupBy(F.to_date(c).alias("day")).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "day", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("v02_court_kpis", "WITH a AS (SELECT n_name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM " + CASES + " GROUP BY 1), b AS (SELECT n_name, count(*) AS lines, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned FROM " + CASES + " JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT coalesce(a.n_name, b.n_name) AS court, coalesce(n, 0) AS n, coalesce(done, 0) AS done, coalesce(lines, 0) AS lines, coalesce(returned, 0) AS returned FROM a FULL JOIN b ON a.n_name = b.n_name")
def v02(spark, sf):
    c = cases(spark, sf).select("o_orderkey", "o_orderstatus", F.col("n_name").alias("court"))
    a = c.groupBy("court").agg(F.count("*").alias("n"), agg.count_where(F.col("o_orderstatus") == "F").alias("done"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").join(c, "o_orderkey")
    b = l.groupBy("court").agg(F.count("*").alias("lines"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("o_orderkey"))).alias("returned"))
    j = a.join(b, "court", "full")
    return j.select("court", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "done", "lines", "returned")])


@query("v03_hourly_rate", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-26' GROUP BY 1, 2")
def v03(spark, sf):
    return table(spark, sf, "events").where(F.col("ts") >= ts("2024-01-26")).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("v04_monthly_volume", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def v04(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_shipdate") >= ts("1996-01-01")).groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice")).cast("double").alias("value"))


@query("v05_daily_volume", "SELECT ts::DATE AS day, user_id % 10 AS court, count(*) AS n FROM events GROUP BY 1, 2")
def v05(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 10).alias("court")).agg(F.count("*").alias("n"))


@query("v06_bridges", "SELECT DISTINCT l_suppkey, n_name FROM lineitem JOIN (SELECT o_orderkey, n_name FROM " + CASES + ") ON l_orderkey = o_orderkey")
def v06(spark, sf):
    c = cases(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"), "n_name")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(c, "l_orderkey").select("l_suppkey", "n_name").distinct()
