"""Merge queries (M01 to M14) and name joins by phrase (J19, J20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.io import table
from lexmill.operators import entities, merge
from lexmill.plans.base import query


@query("m01_insert_ignore", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN upper(c_name) ELSE c_name END AS c_name FROM customer")
def m01(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    # of all customers, a third stands already, a third is only in the batch, a third is in both
    batch = c.where("c_custkey % 3 <> 0").withColumn("c_name", F.upper("c_name"))
    return merge.insert_new(c.where("c_custkey % 3 <> 2"), batch.unionByName(batch), ["c_custkey"])


@query("m02_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def m02(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    first = merge.upsert(e.where("event_id < 0"), e.where("event_id < 5000"), ["user_id"], "event_id")
    return merge.upsert(first, e.where("event_id >= 4000"), ["user_id"], "event_id")


@query("m03_fill_gaps", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE 99 END::INT AS s_nationkey FROM supplier")
def m03(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    now = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("s_nationkey"))
    return merge.fill_gaps(now, s.select("s_suppkey", F.upper("s_name").alias("s_name"), F.lit(99).alias("s_nationkey")), "s_suppkey", ["s_name", "s_nationkey"])


@query("m04_no_downgrade", "SELECT * FROM (VALUES ('123', '1XX', '123'), ('1XX', '123', '123'), ('123', '', '123'), (NULL, '1XX', '1XX'), ('123', '456', '456'), ('1XX', '2XX', '2XX')) t(old, new, kept)")
def m04(spark, sf):
    d = spark.createDataFrame([("123", "1XX"), ("1XX", "123"), ("123", ""), (None, "1XX"), ("123", "456"), ("1XX", "2XX")], "old string, new string")
    return d.withColumn("kept", merge.no_downgrade(F.col("old"), F.col("new")))


@query("m05_identity_route", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'document' WHEN 2 THEN 'masked' ELSE 'name' END AS path FROM customer")
def m05(spark, sf):
    k = F.col("c_custkey") % 4
    bar = F.when(k == 0, "SP123")
    doc = F.when(k < 2, "12345678901").when(k == 2, "123XXXXXX01")
    return table(spark, sf, "customer").select("c_custkey", merge.identity_route(bar, doc, F.col("c_name"))["path"].alias("path"))


PARTIES = "(SELECT s_suppkey AS id, 'p' || (s_suppkey % 30) AS name FROM supplier)"


@query("m06_dedup_repoint", f"WITH r AS (SELECT id, min(id) OVER (PARTITION BY name) AS keep FROM {PARTIES}), c AS (SELECT l_orderkey, min(l_linenumber) AS l_linenumber, coalesce(keep, l_suppkey) AS party FROM lineitem LEFT JOIN r ON l_suppkey = id GROUP BY 1, 3) SELECT party, count(*) AS n FROM c GROUP BY 1")
def m06(spark, sf):
    s = table(spark, sf, "supplier")
    r = merge.survivors(s, F.concat(F.lit("p"), (F.col("s_suppkey") % 30).cast("string")), "s_suppkey")
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("party"), F.monotonically_increasing_id().alias("row"))
    return merge.repoint(l, "party", r, ["l_orderkey", "party"], "row").groupBy("party").agg(F.count("*").alias("n"))


@query("m07_merge_into_single", "WITH p AS (SELECT c_custkey AS id, 'n' || (c_custkey % 400) AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR END AS doc FROM customer), o AS (SELECT name, min(id) AS keep FROM p WHERE doc IS NOT NULL GROUP BY 1 HAVING count(*) = 1) SELECT id, keep FROM p JOIN o USING (name) WHERE doc IS NULL")
def m07(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), (F.col("c_custkey") % 400).cast("string")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).alias("doc"))
    return merge.merge_into_single(p, "id", "name", "doc")


@query("m08_retype", "SELECT CASE WHEN k IN (0, 1) THEN 'company' WHEN k = 2 THEN 'lawyer' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT s_suppkey % 5 AS k FROM supplier) GROUP BY 1")
def m08(spark, sf):
    k = F.col("s_suppkey") % 5
    s = table(spark, sf, "supplier").select(F.when(k < 2, "11222333000181").alias("doc"), F.when(k == 2, "SP123").alias("bar"))
    return s.groupBy(entities.party_kind(F.col("doc"), F.col("bar")).alias("kind")).agg(F.count("*").alias("n"))


# Roles by part key mod 8, and the pole each tells.
ROLES = (("RÉ", "passive"), ("Requerido(a)", "passive"), ("Requerente", "active"), ("Reclamante", "active"), ("Exectda", "passive"), ("perito", "other"), ("Réu/Ré", "passive"), ("Apte", "active"))
TOLD = "[" + ", ".join(f"'{p}'" for _, p in ROLES) + "]"
SLOTS = f"(SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, l_orderkey AS c, l_suppkey % 3 AS p, l_partkey % 8 AS r, CASE WHEN l_linenumber % 3 = 0 THEN 'passive' ELSE 'other' END AS pole, CASE WHEN l_linenumber % 5 = 0 THEN l_suppkey END AS rep, {TOLD}[l_partkey % 8 + 1] AS told FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3))"


@query("m09_pole_recompute", f"WITH s AS {SLOTS}, m AS (SELECT * FROM s WHERE pole = 'other' AND told <> 'other') SELECT id, told AS pole FROM m WHERE rep IS NOT NULL OR (NOT EXISTS (SELECT 1 FROM s o WHERE o.c = m.c AND o.p = m.p AND o.r = m.r AND o.rep IS NULL AND o.pole = m.told) AND NOT EXISTS (SELECT 1 FROM m o WHERE o.c = m.c AND o.p = m.p AND o.r = m.r AND o.rep IS NULL AND o.id < m.id))")
def m09(spark, sf):
    role = F.element_at(F.array(*[F.lit(r) for r, _ in ROLES]), (F.col("l_partkey") % 8 + 1).cast("int"))
    pole = F.when(F.col("l_linenumber") % 3 == 0, "passive").otherwise("other")
    one = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    l = one.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("case"), (F.col("l_suppkey") % 3).alias("party"), role.alias("role"), pole.alias("pole"), F.when(F.col("l_linenumber") % 5 == 0, F.col("l_suppkey")).alias("represents"))
    return merge.recomputed_poles(l, "id", ["case", "party"], "role", "pole", "represents")


@query("m11_idempotent_consumption", "SELECT count(*) FILTER (WHERE o_orderkey IS NOT NULL AND id % 2 = 1) AS created, count(*) FILTER (WHERE o_orderkey IS NOT NULL AND id % 2 = 0) AS duplicates, count(*) FILTER (WHERE o_orderkey IS NULL) AS missing FROM (SELECT unnest(range(0, 20000)) AS id) LEFT JOIN orders ON o_orderkey = id")
def m11(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(True).alias("there"))
    done = o.where("id % 2 = 0").select("id", F.lit(True).alias("done"))
    j = spark.range(20000).join(o, "id", "left").join(done, "id", "left")
    return j.agg(F.count_if(F.col("there").isNotNull() & F.col("done").isNull()).alias("created"), F.count_if(F.col("there").isNotNull() & F.col("done").isNotNull()).alias("duplicates"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("m12_transitions", "WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS n FROM s WHERE before IS DISTINCT FROM event_type GROUP BY 1")
def m12(spark, sf):
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = table(spark, sf, "events").select("user_id", "event_type", before.alias("before"))
    return s.where(~F.col("before").eqNullSafe(F.col("event_type"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("m13_entity_merge", "WITH k AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS variants, count(*) AS n, CASE WHEN count(DISTINCT p_type) > 1 THEN NULL ELSE sum(p_size) END AS total FROM part GROUP BY 1) SELECT p_brand, len(variants) AS n_variants, variants[1] AS first, n, total::BIGINT AS total FROM k")
def m13(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("v"), F.count("*").alias("n"), F.sum("p_size").alias("s"))
    return p.select("p_brand", F.size("v").cast("long").alias("n_variants"), F.element_at("v", 1).alias("first"), "n", F.when(F.size("v") == 1, F.col("s")).alias("total"))


@query("m14_additive_merge", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, count(*) AS n FROM events GROUP BY 1")
def m14(spark, sf):
    e = table(spark, sf, "events")
    part = lambda c, x: e.where(c).groupBy("user_id").agg(F.collect_set("event_type").alias(f"k{x}"), F.count("*").alias(f"n{x}"))
    j = part("event_id % 3 = 0", "a").join(part("event_id % 3 <> 0", "b"), "user_id", "full")
    none = F.expr("cast(array() as array<string>)")
    return j.select("user_id", F.array_sort(F.array_union(F.coalesce("ka", none), F.coalesce("kb", none))).alias("kinds"), (F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))).alias("n"))


@query("j19_phrase_join", "WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents), p(name) AS (VALUES ('released under the mit license'), ('apache license'), ('license version 2')) SELECT name, count(*) AS n FROM d JOIN p ON contains(t, ' ' || name || ' ') GROUP BY 1")
def j19(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.tokens(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("toks"))
    names = spark.createDataFrame([("released under the mit license",), ("apache license",), ("license version 2",)], "name string")
    return entities.phrase_join(d, "doc_id", "toks", names, "name").groupBy("name").agg(F.count("*").alias("n"))


@query("j20_span_containment", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part) SELECT s.name AS inner_name, count(*) AS n FROM s JOIN n ON contains(' ' || n.name || ' ', ' ' || s.name || ' ') AND n.name <> s.name GROUP BY 1")
def j20(spark, sf):
    p = table(spark, sf, "part")
    whole = p.select(F.col("p_name").alias("name")).distinct()
    small = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("inner_name")).distinct()
    spans = entities.spans(whole, "name")
    return spans.join(small, F.col("span") == F.col("inner_name")).where("name <> inner_name").groupBy("inner_name").agg(F.countDistinct("name").alias("n"))
