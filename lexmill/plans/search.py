"""Search queries (P14 to P19, T10 to T17, X02 to X03) over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.io import stage, table
from lexmill.operators import search
from lexmill.plans.base import query

TOKS = "string_split(trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')), ' ')"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.tokens(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("toks"))


@query("p14_all_tokens", f"SELECT doc_id FROM (SELECT doc_id, {TOKS} AS t FROM documents) WHERE list_has_all(t, ['license', 'version'])")
def p14(spark, sf):
    return docs(spark, sf).where(text.has_all_tokens(F.col("toks"), ["license", "version"])).select("doc_id")


@query("p15_phrase", f"SELECT doc_id FROM (SELECT doc_id, {TOKS} AS t FROM documents) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' under the mit ')")
def p15(spark, sf):
    return docs(spark, sf).where(text.has_phrase(F.col("toks"), "under the MIT")).select("doc_id")


@query("p16_query_splitter", f"SELECT doc_id FROM (SELECT doc_id, {TOKS} AS t FROM documents) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' apache license ') AND list_has_all(t, ['version', 'licensed'])")
def p16(spark, sf):
    return docs(spark, sf).where(text.matches_query(F.col("toks"), 'Vérsion "Apache License" licensed')).select("doc_id")


@query("p18_prefix_query", f"SELECT doc_id FROM (SELECT doc_id, {TOKS} AS t FROM documents) WHERE list_has_all(t, ['the']) AND len(list_filter(t, lambda x: starts_with(x, 'licens'))) > 0")
def p18(spark, sf):
    return docs(spark, sf).where(text.has_prefix_query(F.col("toks"), "the licens")).select("doc_id")


@query("p19_query_string", f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({TOKS}, ' ') || ' ' AS t FROM documents) WHERE contains(t, ' mit license ') OR contains(t, ' version 2 ')")
def p19(spark, sf):
    t = F.col("toks")
    return docs(spark, sf).where(text.has_phrase(t, "MIT License") | text.has_phrase(t, "Version 2")).select("doc_id")


@query("t10_bm25", f"""WITH d AS (SELECT doc_id, {TOKS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(CASE WHEN t = [''] THEN 0 ELSE len(t) END) AS a FROM d),
p AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (SELECT unnest(['license', 'apache', 'version']) AS term)),
q AS (SELECT *, count(*) FILTER (WHERE tf > 0) OVER (PARTITION BY term) AS df FROM p)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 4) AS score FROM q, s WHERE tf > 0 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 40""")
def t10(spark, sf):
    s = search.bm25(docs(spark, sf), "doc_id", F.col("toks"), "Apache license, version", stage)
    return s.select("doc_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)


@query("t11_prevalence_score", "SELECT p_partkey, round(2.0 * CASE WHEN p_size % 3 <> 0 THEN log10(2 + 4 * p_size) ELSE log10(2 + 4 * (p_partkey % 7) * 0.5) END, 6) AS score FROM part")
def t11(spark, sf):
    n = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.round(search.prevalence_score(F.lit(2.0), n, F.col("p_partkey") % 7), 6).alias("score"))


@query("t12_best_field", "SELECT p_partkey, round(greatest(p_size, p_retailprice / 50, 7) + 0.1 * (p_size + p_retailprice / 50 + 7 - greatest(p_size, p_retailprice / 50, 7)), 6) AS score FROM part")
def t12(spark, sf):
    s = search.best_field([F.col("p_size").cast("double"), F.col("p_retailprice") / 50, F.lit(7.0)])
    return table(spark, sf, "part").select("p_partkey", F.round(s, 6).alias("score"))


@query("t13_post_filter", "SELECT p_partkey, n FROM (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_type) AS n FROM part) WHERE p_brand LIKE '%1' ORDER BY n DESC, p_partkey LIMIT 30")
def t13(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "part").withColumn("n", F.count("*").over(Window.partitionBy("p_type")))
    return d.where(F.col("p_brand").endswith("1")).orderBy(F.desc("n"), "p_partkey").limit(30).select("p_partkey", "n")


@query("t14_weighted_tokens", "SELECT p_partkey, list_concat(list_transform(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x || ':A'), list_transform(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x || ':B')) AS tokens FROM part")
def t14(spark, sf):
    return table(spark, sf, "part").select("p_partkey", search.weighted_tokens({"A": F.col("p_name"), "B": F.col("p_type")}).alias("tokens"))


@query("t15_resolve_entity", "SELECT p_type AS name, count(*) AS n FROM part WHERE contains(lower(p_type), lower((SELECT min(p_type) FROM part))) GROUP BY 1 ORDER BY n DESC, name DESC LIMIT 1")
def t15(spark, sf):
    p = table(spark, sf, "part")
    e = p.groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))
    word = e.agg(F.min("name")).first()[0]
    return search.resolve(e, "name", "n", "brands", word).select("name", "n")


@query("t16_suggest", "SELECT p_type AS name, count(*) AS n FROM part WHERE regexp_matches(lower(p_type), 'st.*') GROUP BY 1 ORDER BY n DESC, name LIMIT 8")
def t16(spark, sf):
    d = table(spark, sf, "part").where(text.contains_in_order(F.col("p_type"), "st")).groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "name").limit(8)


@query("t18_autocomplete", "WITH e AS (SELECT p_type AS name, count(*) AS n, lower(p_type) AS t FROM part GROUP BY 1) SELECT name, n, round((0.9 * greatest(a, b, 1.0) + 0.1 * (a + b + 1)) * log10(2 + 4 * n), 6)::DOUBLE AS score FROM (SELECT *, CASE WHEN starts_with(t, 's') THEN 3.0 ELSE 0 END AS a, CASE WHEN contains(' ' || t || ' ', ' s ') THEN 2.5 ELSE 0 END AS b FROM e) WHERE regexp_matches(t, '(^|[^a-z0-9])s') AND n > 1 ORDER BY score DESC, name LIMIT 8")
def t18(spark, sf):
    e = table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    return search.autocomplete(e, "name", "n", "s", 8, F.col("n") > 1)


@query("st12_standing_batch", f"WITH b AS (SELECT item_id, array_to_string(string_split(trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')), ' ')[1:6], ' ') AS p FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string({TOKS}, ' ') || ' ' AS t FROM documents) SELECT DISTINCT item_id, doc_id FROM b JOIN d ON contains(t, ' ' || p || ' ') WHERE p <> ''")
def st12b(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(text.tokens(F.replace("text", F.lit("ß"), F.lit("ss"))), 1, 6), " ").alias("term"))
    return search.standing_matches(docs(spark, sf), "doc_id", "toks", b, "item_id", "term")


@query("x02_lawyer_names", "SELECT s_suppkey, ['João da Silva Souza', 'MARIA LIMA'] AS names FROM supplier")
def x02(spark, sf):
    from lexmill.functions.python import lawyer_names

    t = F.concat(F.lit("Adv. João da Silva Souza OAB/SP "), (100000 + F.col("s_suppkey")).cast("string"), F.lit("; MARIA LIMA (OAB/RJ 123456)"))
    return table(spark, sf, "supplier").select("s_suppkey", lawyer_names()(t).alias("names"))


@query("x03_html_parser")
def x03(spark, sf):
    from lexmill.functions.python import html_text

    return table(spark, sf, "pages").select("page_id", F.md5(html_text()("html")).alias("h"))
