"""Further identifier, text, source and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import ids, text
from lexmill.io import scratch, stage, table
from lexmill.operators import merge
from lexmill.operators import relational as rel
from lexmill.plans.base import query
from lexmill.plans.functions import CPFS, NUMBERED, documents_of, names, numbered


@query("f04_strict_case", f"SELECT o_orderkey, cnj FROM {NUMBERED} WHERE o_orderkey % 5 <> 0")
def f04(spark, sf):
    n = numbered(spark, sf).where("o_orderkey % 5 <> 0")
    strict = F.when(ids.case_check(F.col("cnj")), ids.case_mask(F.col("cnj"))).otherwise(F.raise_error(F.concat(F.lit("invalid case number "), "cnj")))
    return n.select("o_orderkey", strict.alias("cnj"))


@query("f10_publishes_value", "SELECT n_name, n_name IN ('BRAZIL', 'FRANCE', 'JAPAN') AS publishes FROM nation")
def f10(spark, sf):
    return table(spark, sf, "nation").select("n_name", F.col("n_name").isin("BRAZIL", "FRANCE", "JAPAN").alias("publishes"))


@query("f18_is_cpf", f"SELECT c_custkey, c_custkey % 4 <> 3 AS cpf FROM {CPFS}")
def f18(spark, sf):
    k = F.col("c_custkey") % 4
    doc = F.when(k < 2, F.col("cpf")).when(k == 2, "12345")
    kind = F.when(k == 2, "CPF")
    return documents_of(spark, sf).select("c_custkey", ids.is_cpf(doc, kind).alias("cpf"))


@query("f33_parentheses", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 1 THEN 1 ELSE 0 END AS had FROM supplier")
def f33(spark, sf):
    t = text.without_parentheses(F.col("name"))
    return names(spark, sf).select("s_suppkey", (F.length(F.trim(t)) < F.length("name")).cast("int").alias("had"))


@query("f34_acronym_segments", "SELECT s_suppkey, s_suppkey % 5 = 4 AS had FROM supplier")
def f34(spark, sf):
    key, plain = text.normal_name(F.col("name")), text.normal_name(F.replace("name", F.lit(" - "), F.lit(" ")))
    return names(spark, sf).select("s_suppkey", (key != plain).alias("had"))


@query("f48_spaced_cases", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS n FROM {NUMBERED}")
def f48(spark, sf):
    t = F.concat(F.lit("n. "), F.regexp_replace("cnj", r"([.-])", " $1 "))
    return numbered(spark, sf).select("o_orderkey", F.size(ids.cases_in_text(t)).alias("n"))


@query("f50_extract_bundle", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN [cnj] END AS cases, ['SP123456'] AS bars, 1 AS n_values FROM {NUMBERED}")
def f50(spark, sf):
    t = F.concat(F.lit("Autos "), "cnj", F.lit(" adv. Fulana de Tal OAB/SP 123.456, valor R$ 10,00"))
    some = lambda a: F.when(F.size(a) > 0, a)
    return numbered(spark, sf).select("o_orderkey", some(ids.cases_in_text(t)).alias("cases"), some(text.bar_numbers(t)).alias("bars"), F.size(text.money_values(t)).alias("n_values"))


@query("f56_party_text", f"SELECT c_custkey, 'Fulano de Tal' AS name, cpf AS digits, 'AUTOR' AS role FROM {CPFS}")
def f56(spark, sf):
    t = F.concat(F.lit("Fulano de  Tal - CPF: "), ids.mask_cpf(F.col("cpf")), F.lit(" (AUTOR)"))
    name = text.squeeze(F.regexp_extract(t, r"^(.*?)\s+-\s+(?:CPF|CNPJ):", 1))
    return documents_of(spark, sf).select("c_custkey", name.alias("name"), ids.digits(F.regexp_extract(t, r"(?:CPF|CNPJ):\s*([0-9./-]+)", 1)).alias("digits"), F.regexp_extract(t, r"\(([A-Z ]+)\)\s*$", 1).alias("role"))


@query("f60_pattern_from_text", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '.*b.*')")
def f60(spark, sf):
    return table(spark, sf, "part").where(text.contains_in_order(F.col("p_name"), "B")).select("p_partkey")


@query("f80_source_name", "SELECT l_linestatus, CASE WHEN l_linestatus = 'F' THEN 'registry' ELSE 'gazette' END AS source, count(*) AS n FROM lineitem GROUP BY 1, 2")
def f80(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus", F.when(F.col("l_linestatus") == "F", "registry").otherwise("gazette").alias("source")).agg(F.count("*").alias("n"))


@query("s03_keyset_scan", "SELECT (r - 1) // 1000 AS batch, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) GROUP BY 1")
def s03(spark, sf):
    return rel.keyset_batches(table(spark, sf, "events"), "event_id", 1000, stage)


@query("s04_chunked_export", "SELECT s_suppkey FROM supplier")
def s04(spark, sf):
    out = scratch(spark)
    table(spark, sf, "supplier").select("s_suppkey").write.option("maxRecordsPerFile", 10).parquet(out)
    return spark.read.schema("s_suppkey long").parquet(out)


@query("s09_json_pages", "SELECT event_id, event_type FROM events")
def s09(spark, sf):
    out = scratch(spark)
    e = table(spark, sf, "events")
    page = e.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.count("*").alias("count"), F.collect_list(F.struct("event_id", "event_type")).alias("items"))
    page.write.json(out)
    p = spark.read.schema("page long, count long, items array<struct<event_id:long,event_type:string>>").json(out)
    # a page whose declared count is not what it holds stops the read
    checked = p.where(F.assert_true(F.col("count") == F.size("items"), F.lit("page is incomplete")).isNull())
    return checked.select(F.explode("items").alias("i")).select("i.*")


@query("s16_dual_write", "SELECT user_id, count(*) * 2 AS n FROM events GROUP BY 1")
def s16(spark, sf):
    a, b = scratch(spark), scratch(spark)
    e = table(spark, sf, "events").select("user_id", "event_id").persist()
    for path in (a, b):
        e.write.parquet(path)
    e.unpersist()
    both = spark.read.parquet(a).unionByName(spark.read.parquet(b))
    return both.groupBy("user_id").agg(F.count("*").alias("n"))


@query("s19_payload", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def s19(spark, sf):
    c = table(spark, sf, "conversations")
    body = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))).alias("payload"))
    turns = F.from_json("payload", "struct<turns:array<struct<turn:long,role:string>>>")["turns"]
    return body.select("conv_id", F.size(turns).cast("long").alias("n"))


@query("u08_label_union", "SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids FROM (SELECT 'a' AS source, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'b', doc_id FROM labels WHERE toxic = 0 UNION ALL SELECT 'c', doc_id FROM documents WHERE n_chars > 1000) GROUP BY 1")
def u08(spark, sf):
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    u = l.where("quality = 1").select(F.lit("a").alias("source"), "doc_id").unionByName(l.where("toxic = 0").select(F.lit("b").alias("source"), "doc_id")).unionByName(d.where("n_chars > 1000").select(F.lit("c").alias("source"), "doc_id"))
    return u.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("x07_summary_in_step", "SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 <> 0 GROUP BY 1")
def x07(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    before, inserted, deleted = o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 = 0"), o.where("o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0")
    after = o.where("o_orderkey % 10 = 0 OR o_orderkey % 7 <> 0")
    return merge.kept_in_step(stage(merge.summarised(before, "o_custkey", "o_orderdate")), after, inserted, deleted, "o_custkey", "o_orderdate")


@query("m10_claimed_partitions", "SELECT (o_orderkey % 8)::INT AS worker, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def m10(spark, sf):
    # work is claimed by partition: each row belongs to one task
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy((F.col("o_orderkey") % 8).cast("int").alias("worker")).agg(F.count("*").alias("n"))


@query("st07_watermark_ticks", "SELECT count(*) AS n, max(event_id) AS last FROM events")
def st07(spark, sf):
    from lexmill.streaming import pipelines as st

    src, out, check = scratch(spark), scratch(spark), scratch(spark)
    e = table(spark, sf, "events").select("event_id")
    e.where("event_id % 2 = 0").write.parquet(src)
    tick = lambda: st.run_once(spark.readStream.schema("event_id long").parquet(src), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), check)
    tick()
    tick()  # without new files nothing moves
    e.where("event_id % 2 = 1").write.mode("append").parquet(src)
    tick()
    return spark.read.schema("event_id long, batch long").parquet(out).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("st09_rate_limited", "SELECT count(*) AS n FROM events")
def st09(spark, sf):
    from lexmill.streaming import pipelines as st

    src, out = scratch(spark), scratch(spark)
    table(spark, sf, "events").select("event_id").repartition(5).write.parquet(src)
    s = spark.readStream.schema("event_id long").option("maxFilesPerTrigger", 1).parquet(src)
    st.run_once(s, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch(spark))
    return spark.read.schema("event_id long, batch long").parquet(out).agg(F.count("*").alias("n"))


@query("st10_feature_before_publish", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS signals FROM events GROUP BY 1")
def st10(spark, sf):
    from lexmill.streaming import pipelines as st

    src, out = scratch(spark), scratch(spark)
    table(spark, sf, "events").select("event_id", "event_type").repartition(3).write.parquet(src)
    s = spark.readStream.schema("event_id long, event_type string").parquet(src).withColumn("signal", F.col("event_type").isin("error", "purchase"))
    st.run_once(s, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch(spark))
    r = spark.read.schema("event_id long, event_type string, signal boolean, batch long").parquet(out)
    return r.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("signal").alias("signals"))


@query("st11_sweep_ties", "SELECT count(*) AS n FROM events")
def st11(spark, sf):
    # pages cut inside a second re-read that second; the id makes rows one again
    e = table(spark, sf, "events").select("event_id", F.date_trunc("hour", "ts").alias("t"))
    cut = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return e.where(F.col("t").cast("timestamp") <= cut).unionByName(e.where(F.col("t").cast("timestamp") >= cut)).dropDuplicates(["event_id"]).agg(F.count("*").alias("n"))


@query("p_value_range_topk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 150000 AND 160000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def p_values(spark, sf):
    from lexmill.operators.filters import ranges

    d = table(spark, sf, "orders").where(ranges({"value_min": 150000, "value_max": 160000}, value=F.col("o_totalprice")))
    return d.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("f72_half_even_money", "SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2) / 3, 2)::DOUBLE AS third FROM orders")
def f72b(spark, sf):
    third = (F.col("o_totalprice").cast("decimal(18,2)") / 3).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", F.round(third, 2).alias("third"))
