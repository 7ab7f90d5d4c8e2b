"""Scalar function queries (F01 to F83), on values built from the tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import dates, ids, numbers, text
from lexmill.io import table
from lexmill.plans.base import query


def numbered(spark, sf):
    """Case numbers from order keys: sequence, right or wrong check digits, year, segment 8, court, origin."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("string").alias("y"))
    seq = F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    court = F.lpad((F.col("o_custkey") % 30).cast("string"), 2, "0")
    tail = F.concat(F.lit("8"), court, F.lit("0001"))
    right = 98 - (F.concat(seq, F.col("y"), tail, F.lit("00")).cast("decimal(38,0)") % 97).cast("int")
    check = F.lpad(F.when(F.col("o_orderkey") % 5 == 0, (right + 1) % 100).otherwise(right).cast("string"), 2, "0")
    return o.select("o_orderkey", F.concat(seq, F.lit("-"), check, F.lit("."), "y", F.lit(".8."), court, F.lit(".0001")).alias("cnj"))


NUMBERED = """(SELECT o_orderkey, seq || '-' || lpad(CASE WHEN o_orderkey % 5 = 0 THEN (dv + 1) % 100 ELSE dv END::VARCHAR, 2, '0') || '.' || y || '.8.' || court || '.0001' AS cnj, dv, court, y FROM
(SELECT *, (98 - (seq || y || '8' || court || '0001' || '00')::HUGEINT % 97)::INT AS dv FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 7, '0') AS seq, year(o_orderdate)::VARCHAR AS y, lpad((o_custkey % 30)::VARCHAR, 2, '0') AS court FROM orders)))"""
STATES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ids.STATE_BY_CODE.items())


@query("f01_case_year", f"SELECT o_orderkey, y::INT AS y FROM {NUMBERED}")
def f01(spark, sf):
    return numbered(spark, sf).select("o_orderkey", ids.case_year(F.col("cnj")).alias("y"))


@query("f02_split_part", f"SELECT o_orderkey, split_part(cnj, '.', 2) AS y, split_part(cnj, '.', 9) AS none FROM {NUMBERED}")
def f02(spark, sf):
    return numbered(spark, sf).select("o_orderkey", F.split_part("cnj", F.lit("."), F.lit(2)).alias("y"), F.split_part("cnj", F.lit("."), F.lit(9)).alias("none"))


@query("f03_normalise_case", f"SELECT o_orderkey, cnj AS a, cnj AS b, CASE WHEN o_orderkey % 2 = 0 THEN cnj END AS c FROM {NUMBERED}")
def f03(spark, sf):
    c = F.col("cnj")
    inside = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("case "), ids.digits(c), F.lit(" of today"))).otherwise("no number 123")
    return numbered(spark, sf).select("o_orderkey", ids.case_in_text(F.lit("none"), F.concat(F.lit("see "), c)).alias("a"), ids.case_mask(ids.digits(c)).alias("b"), ids.case_in_text(inside).alias("c"))


@query("f05_case_parts", f"SELECT o_orderkey, substr(cnj, 1, 7) AS sequence, y AS year, '8' AS segment, court, '0001' AS origin FROM {NUMBERED}")
def f05(spark, sf):
    return numbered(spark, sf).select("o_orderkey", ids.case_parts(F.col("cnj")).alias("p")).select("o_orderkey", "p.sequence", "p.year", "p.segment", "p.court", "p.origin")


@query("f06_case_check", f"SELECT o_orderkey, o_orderkey % 5 <> 0 AS ok FROM {NUMBERED}")
def f06(spark, sf):
    return numbered(spark, sf).select("o_orderkey", ids.case_check(F.col("cnj")).alias("ok"))


@query("f07_case_court", f"SELECT court, CASE WHEN court = '07' THEN 'TJDFT' ELSE 'TJ' || CASE court {STATES} END END AS name, count(*) AS n FROM {NUMBERED} GROUP BY 1, 2")
def f07(spark, sf):
    c = F.col("cnj")
    return numbered(spark, sf).groupBy(ids.case_parts(c)["court"].alias("court"), ids.case_court(c).alias("name")).agg(F.count("*").alias("n"))


@query("f08_describe_case", f"SELECT o_orderkey, o_orderkey % 5 <> 0 AS valid, CASE WHEN o_orderkey % 5 = 0 THEN 'check' END AS reason, 20 AS digits, y AS year FROM {NUMBERED}")
def f08(spark, sf):
    return numbered(spark, sf).select("o_orderkey", ids.describe_case(F.col("cnj")).alias("d")).select("o_orderkey", "d.valid", "d.reason", "d.digits", "d.year")


@query("f09_court_state", "SELECT k::INT AS k, CASE k WHEN 0 THEN 'SP' WHEN 1 THEN 'DF' WHEN 2 THEN 'RS' WHEN 3 THEN 'BA' END AS uf FROM (SELECT unnest(range(0, 5)) AS k)")
def f09(spark, sf):
    court = F.element_at(F.array(*map(F.lit, ("TJSP", "TJDFT", "TRF4", "TREBA", "XYZ"))), (F.col("k") + 1).cast("int"))
    return spark.range(5).select(F.col("id").cast("int").alias("k")).select("k", ids.court_state(court).alias("uf"))


def documents_of(spark, sf):
    """Numbers of eleven digits from customer keys, the two check digits right for two rows of three."""
    c = table(spark, sf, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "1").alias("b"))
    one = ids._check_digit(F.col("b"), list(range(10, 1, -1)))
    c = c.withColumn("b1", F.concat("b", one.cast("string")))
    two = ids._check_digit(F.col("b1"), list(range(11, 1, -1)))
    wrong = F.when(F.col("c_custkey") % 3 == 0, (two + 1) % 10).otherwise(two)
    return c.select("c_custkey", F.concat("b1", wrong.cast("string")).alias("cpf"))


def _dv(expr: str, weights) -> str:
    s = "(" + " + ".join(f"substr({expr}, {i}, 1)::INT * {w}" for i, w in enumerate(weights, 1)) + ") % 11"
    return f"CASE WHEN {s} < 2 THEN 0 ELSE 11 - {s} END"


CPFS = f"(SELECT c_custkey, b1 || (CASE WHEN c_custkey % 3 = 0 THEN ({_dv('b1', range(11, 1, -1))} + 1) % 10 ELSE {_dv('b1', range(11, 1, -1))} END)::VARCHAR AS cpf FROM (SELECT c_custkey, b || ({_dv('b', range(10, 1, -1))})::VARCHAR AS b1 FROM (SELECT c_custkey, lpad((c_custkey * 7919)::VARCHAR, 9, '1') AS b FROM customer)))"


@query("f11_cpf_check", f"SELECT c_custkey, c_custkey % 3 <> 0 AS ok FROM {CPFS}")
def f11(spark, sf):
    return documents_of(spark, sf).select("c_custkey", ids.cpf_check(F.col("cpf")).alias("ok"))


@query("f12_cnpj_check", "SELECT * FROM (VALUES ('11222333000181', true), ('11222333000182', false), ('00000000000000', false), ('1122233300018', false)) t(cnpj, ok)")
def f12(spark, sf):
    d = spark.createDataFrame([("11222333000181",), ("11222333000182",), ("00000000000000",), ("1122233300018",)], "cnpj string")
    return d.select("cnpj", ids.cnpj_check(F.col("cnpj")).alias("ok"))


@query("f13_mask_document", f"SELECT c_custkey, substr(cpf, 1, 3) || '.' || substr(cpf, 4, 3) || '.' || substr(cpf, 7, 3) || '-' || substr(cpf, 10, 2) AS masked FROM {CPFS}")
def f13(spark, sf):
    return documents_of(spark, sf).select("c_custkey", ids.mask_cpf(F.col("cpf")).alias("masked"))


@query("f14_document", f"SELECT c_custkey, 'cpf' AS kind, cpf AS digits, c_custkey % 3 <> 0 AS valid FROM {CPFS}")
def f14(spark, sf):
    d = documents_of(spark, sf).select("c_custkey", ids.document(F.concat(F.lit("CPF "), ids.mask_cpf(F.col("cpf")))).alias("d"))
    return d.select("c_custkey", "d.kind", "d.digits", "d.valid")


@query("f15_bar_number", "SELECT s_suppkey, 'SP' || lpad(s_suppkey::VARCHAR, 6, '0') AS bar FROM supplier")
def f15(spark, sf):
    n = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("sp "), n)).when(k == 1, F.concat(n, F.lit("/SP"))).otherwise(F.concat(F.lit("SP"), F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 3)))
    return table(spark, sf, "supplier").select("s_suppkey", ids.bar_number(raw).alias("bar"))


@query("f16_masks", f"SELECT c_custkey, true AS masked, c_custkey % 2 = 0 AS agrees FROM {CPFS}")
def f16(spark, sf):
    c = F.col("cpf")
    flip = F.concat(((F.substring(c, 1, 1).cast("int") + 1) % 10).cast("string"), F.substring(c, 2, 10))
    other = F.when(F.col("c_custkey") % 2 == 0, c).otherwise(flip)
    m = F.concat(F.substring(c, 1, 3), F.lit("*****"), F.substring(c, 9, 3))
    return documents_of(spark, sf).select("c_custkey", ids.is_masked(m).alias("masked"), ids.masks_agree(m, other).alias("agrees"))


@query("f17_company_root", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE lpad((s_suppkey + 10000000)::VARCHAR, 8, '0') END AS root FROM supplier")
def f17(spark, sf):
    d = F.concat(F.lpad((F.col("s_suppkey") + 10000000).cast("string"), 8, "0"), F.lit("000100"))
    raw = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.substring(d, 1, 3), F.lit("XXXXXXXXXXX"))).otherwise(d)
    return table(spark, sf, "supplier").select("s_suppkey", ids.cnpj_root(raw).alias("root"))


@query("f19_external_id", "SELECT o_orderkey, 'dje:' || o_orderkey || ':' || strftime(o_orderdate, '%Y%m%d') AS id FROM orders")
def f19(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ids.external_id("dje", F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")).alias("id"))


@query("f20_movement_id", "SELECT l_orderkey, l_linenumber, 'mov:' || substr(sha1(l_orderkey || '|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || l_linenumber), 1, 24) AS id FROM lineitem")
def f20(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ids.movement_id(F.col("l_orderkey"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_linenumber")).alias("id"))


@query("f21_act_fingerprint", "SELECT conv_id, turn, sha1(conv_id || '|' || turn || '|' || substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 4000)) AS id FROM conversations WHERE text IS NOT NULL")
def f21(spark, sf):
    return table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", ids.act_fingerprint(F.col("conv_id"), F.col("turn"), F.col("text")).alias("id"))


@query("f22_key_set_hash", "SELECT DISTINCT substr(sha256('[\"k\"]'), 1, 32) AS h FROM events")
def f22(spark, sf):
    return table(spark, sf, "events").select(ids.key_set_hash(F.json_object_keys("props")).alias("h")).distinct()


@query("f23_hash_fraction", "SELECT doc_id, round(('0x' || substr(sha1('v1' || doc_id), 1, 8))::BIGINT / 4294967295.0, 9) AS f FROM documents")
def f23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(ids.hash_fraction(F.col("doc_id"), "v1"), 9).alias("f"))


@query("f24_debtor_kind", "SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'municipal' WHEN 1 THEN 'state' WHEN 2 THEN 'federal' ELSE 'other' END AS kind FROM nation")
def f24(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ("Município de ", "Estado de ", "União Federal em ", "Banco "))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_name", ids.debtor_kind(F.concat(lead, "n_name")).alias("kind"))


@query("f30_strip_accents", "SELECT doc_id, md5(strip_accents(replace(replace(text, 'ß', ''), 'ẞ', ''))) AS h FROM documents")
def f30(spark, sf):
    t = F.replace(F.replace("text", F.lit("ß"), F.lit("")), F.lit("ẞ"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.strip_accents(t)).alias("h"))


@query("f31_fold_keeps_length", "SELECT doc_id, length(text) AS n, md5(lower(strip_accents(replace(text, 'ß', 's')))) AS h FROM documents")
def f31(spark, sf):
    t = F.replace("text", F.lit("ß"), F.lit("s"))
    return table(spark, sf, "documents").select("doc_id", F.length(text.fold(t)).cast("long").alias("n"), F.md5(text.fold(t)).alias("h"))


@query("f32_squeeze", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def f32(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("h"))


def names(spark, sf):
    """Party names in several spellings of a few bodies."""
    body = F.element_at(F.array(*map(F.lit, ("Instituto Nacional do Seguro Social", "Município de São Paulo", "Fundo de Saúde"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    form = F.element_at(F.array(F.lit(""), F.lit(" (REQUERIDO(A))"), F.lit(" - EXECUTADO"), F.lit(" LTDA"), F.lit(" - ABC")), (F.col("s_suppkey") % 5 + 1).cast("int"))
    name = F.concat(body, form)
    return table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper(name)).otherwise(name).alias("name"))


KEYS = "CASE s_suppkey % 3 WHEN 0 THEN 'INSTITUTO NACIONAL SEGURO SOCIAL' WHEN 1 THEN 'MUNICIPIO SAO PAULO' ELSE 'FUNDO SAUDE' END"


@query("f35_normal_name", f"SELECT s_suppkey, {KEYS} AS key FROM supplier")
def f35(spark, sf):
    return names(spark, sf).select("s_suppkey", text.normal_name(F.col("name")).alias("key"))


@query("f36_grouping_name", f"SELECT s_suppkey, {KEYS} || CASE s_suppkey % 5 WHEN 2 THEN ' EXECUTADO' WHEN 3 THEN ' LTDA' ELSE '' END AS key FROM supplier")
def f36(spark, sf):
    return names(spark, sf).select("s_suppkey", text.grouping_name(F.col("name")).alias("key"))


@query("f37_clean_label", "SELECT s_suppkey, upper(CASE s_suppkey % 3 WHEN 0 THEN 'Instituto Nacional do Seguro Social' WHEN 1 THEN 'Município de São Paulo' ELSE 'Fundo de Saúde' END || CASE s_suppkey % 5 WHEN 3 THEN ' LTDA' WHEN 4 THEN ' - ABC' ELSE '' END) AS label FROM supplier")
def f37(spark, sf):
    return names(spark, sf).select("s_suppkey", F.upper(text.clean_label(F.col("name"))).alias("label"))


@query("f38_sub_phrase", "SELECT p_partkey, length(p_name) > length(split_part(p_name, ' ', 1)) AS inside FROM part")
def f38(spark, sf):
    whole = text.tokens(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", text.is_sub_phrase(F.slice(whole, 1, 1), whole).alias("inside"))


@query("f39_acronym", f"SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'INSS' WHEN 1 THEN 'MSP' ELSE 'FS' END AS a FROM supplier")
def f39(spark, sf):
    return names(spark, sf).select("s_suppkey", text.acronym(text.normal_name(F.col("name"))).alias("a"))


@query("f40_canonical_name", f"WITH n AS (SELECT {KEYS} AS key, CASE WHEN s_suppkey % 2 = 0 THEN upper(x) ELSE x END AS name FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Instituto Nacional do Seguro Social' WHEN 1 THEN 'Município de São Paulo' ELSE 'Fundo de Saúde' END || ['', ' (REQUERIDO(A))', ' - EXECUTADO', ' LTDA', ' - ABC'][s_suppkey % 5 + 1] AS x FROM supplier)), c AS (SELECT key, name, count(*) AS n FROM n GROUP BY 1, 2) SELECT key, first(name ORDER BY n DESC, name = upper(name), length(name) DESC, name) AS label FROM c GROUP BY 1")
def f40(spark, sf):
    k = names(spark, sf).groupBy(text.normal_name(F.col("name")).alias("key"), "name").agg(F.count("*").alias("n"))
    # the least of (fewer rows, upper case, shorter, later) is what goes first
    return k.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name") == F.upper("name"), -F.length("name"), "name")).alias("label"))


@query("f41_suspicious_name", "SELECT * FROM (VALUES ('BANCO', 3, 'one word'), ('BANCO', 9, NULL), ('FUNDO DE', 9, 'cut off'), ('FUNDO SAUDE', 1, NULL)) t(name, n, why)")
def f41(spark, sf):
    d = spark.createDataFrame([("BANCO", 3), ("BANCO", 9), ("FUNDO DE", 9), ("FUNDO SAUDE", 1)], "name string, n int")
    return d.select("name", "n", text.suspicious_name(F.col("name"), F.col("n")).alias("why"))


@query("f42_public_body", "SELECT s_suppkey, s_suppkey % 3 <> 2 AS public FROM supplier")
def f42(spark, sf):
    return names(spark, sf).select("s_suppkey", text.is_public_body(F.col("name")).alias("public"))


@query("f44_bar_numbers", "SELECT s_suppkey, ['SP' || (100000 + s_suppkey), 'RJ' || (20000 + s_suppkey)] AS found FROM supplier")
def f44(spark, sf):
    n, m = (100000 + F.col("s_suppkey")).cast("string"), (20000 + F.col("s_suppkey")).cast("string")
    t = F.concat(F.lit("Adv. Fulano OAB/SP "), n, F.lit(" e Beltrano (OAB nº "), m, F.lit("/RJ); OAB-SP "), n, F.lit(", OAB/ZZ 12345"))
    return table(spark, sf, "supplier").select("s_suppkey", text.bar_numbers(t).alias("found"))


@query("f46_documents_in_text", f"SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN [cpf] ELSE [] END AS found FROM {CPFS}")
def f46(spark, sf):
    c = F.col("cpf")
    t = F.concat(F.lit("CPF "), ids.mask_cpf(c), F.lit(" and again "), c, F.lit(", not 12345"))
    raw = F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\d)(\d{3}\.?\d{3}\.?\d{3}-?\d{2})(?!\d)"), F.lit(1)), ids.digits)
    return documents_of(spark, sf).select("c_custkey", F.array_distinct(F.filter(raw, ids.cpf_check)).alias("found"))


@query("f47_cited_cases", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN [cnj] ELSE [] END AS found FROM {NUMBERED}")
def f47(spark, sf):
    c = F.col("cnj")
    t = F.concat(F.lit("nos autos "), F.replace(c, F.lit("-"), F.lit(" - ")), F.lit(", v. "), c, F.lit("; 9"), c)
    return numbered(spark, sf).select("o_orderkey", ids.cases_in_text(t).alias("found"))


@query("f49_money_values", "SELECT o_orderkey, CASE WHEN v > 99.5 THEN [v::VARCHAR, '99.50'] WHEN v = 99.5 OR v <= 0 THEN ['99.50'] ELSE ['99.50', v::VARCHAR] END AS found FROM (SELECT o_orderkey, (o_orderkey * 1.25)::DECIMAL(18,2) AS v FROM orders)")
def f49(spark, sf):
    v = (F.col("o_orderkey") * F.lit("1.25").cast("decimal(5,2)")).cast("decimal(18,2)")
    t = F.concat(F.lit("Valor de "), numbers.format_brl(v), F.lit(" e custas de R$ 99,50, total R$ 99,50, saldo R$ 0,00"))
    return table(spark, sf, "orders").select("o_orderkey", F.transform(text.money_values(t), lambda x: x.cast("string")).alias("found"))


@query("f51_strip_tags", "SELECT page_id, md5(regexp_replace(html, '<[^<>]{0,80}>', ' ', 'g')) AS h FROM pages")
def f51(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("h"))


@query("f52_snippet", "SELECT doc_id, CASE WHEN p > 1 THEN '…' ELSE '' END || substr(text, p, e - p + 1) || CASE WHEN e < length(text) THEN '…' ELSE '' END AS s FROM (SELECT doc_id, text, greatest(1, position('License' IN text) - 20) AS p, least(length(text), position('License' IN text) + 26) AS e FROM documents WHERE contains(text, 'License'))")
def f52(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").contains("License")).select("doc_id", text.snippet(F.col("text"), "License", 20).alias("s"))


@query("f53_highlight", r"SELECT doc_id, list_transform(regexp_extract_all(text, '(?is)(.{0,100}\bLicense\b.{0,100})', 1)[1:3], lambda p: regexp_replace(p, '(?i)\b(License)\b', '<em>\1</em>', 'g')) AS fragments FROM documents WHERE contains(text, 'License')")
def f53(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").contains("License")).select("doc_id", text.highlights(F.col("text"), "License").alias("fragments"))


@query("f54_windows", "SELECT k::INT AS k, CASE WHEN k <= 40 THEN 1 ELSE 2 END AS n FROM (SELECT unnest(range(0, 80, 10)) AS k)")
def f54(spark, sf):
    k = F.col("id").cast("int")
    t = F.concat(F.repeat(F.lit("x"), 30), F.lit("HIT"), F.expr("repeat('y', cast(id as int))"), F.lit("HIT"), F.repeat(F.lit("z"), 30))
    return spark.range(0, 80, 10).select(k.alias("k"), F.size(text.windows_around(t, "HIT", 20)).alias("n"))


@query("f55_html_text", r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS h FROM pages")
def f55(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("h"))


@query("f57_name_code", "SELECT p_partkey, p_name AS name, p_size::VARCHAR AS code FROM part")
def f57(spark, sf):
    t = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    p = r"^(.*?)\s*\((\d+)\)\s*$"
    return table(spark, sf, "part").select("p_partkey", F.regexp_extract(t, p, 1).alias("name"), F.regexp_extract(t, p, 2).alias("code"))


@query("f58_movement_text", "SELECT l_orderkey, string_agg(l_returnflag || ': ' || l_linenumber, '; ' ORDER BY l_linenumber, l_returnflag) AS t FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def f58(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    kept = F.filter("x", lambda x: x["l_returnflag"] != "N")
    return l.where(F.size(kept) > 0).select("l_orderkey", F.array_join(F.transform(kept, lambda x: F.concat(x["l_returnflag"], F.lit(": "), x["l_linenumber"].cast("string"))), "; ").alias("t"))


@query("f59_truncate", "SELECT doc_id, left(text, 100) AS t FROM documents")
def f59(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(100)).alias("t"))


@query("f61_key_drift", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS extra, CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS missing FROM events")
def f61(spark, sf):
    k = F.col("event_id") % 4
    j = F.when(k == 0, F.lit('{"id":1,"new":2}')).when(k == 1, F.lit('{"opt":1}')).otherwise(F.lit('{"id":1,"opt":2}'))
    extra, missing = numbers.key_drift(j, ["id"], ["opt"])
    return table(spark, sf, "events").select("event_id", F.size(extra).alias("extra"), F.size(missing).alias("missing"))


@query("f62_parse_moment", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def f62(spark, sf):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(dates.parse_moment(raw), "yyyy-MM-dd").alias("day"))


@query("f63_parse_day", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS day FROM orders")
def f63(spark, sf):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyyMMddHHmmss")).otherwise("31/31/2020")
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_day_br(raw).alias("day"))


@query("f64_date_chunks", "SELECT d::DATE AS \"from\", least(d::DATE + 29, DATE '1997-12-31') AS \"to\" FROM (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1997-12-31', INTERVAL 30 DAY)) AS d)")
def f64(spark, sf):
    a, b = F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")
    return spark.range(1).select(F.explode(dates.chunks(a, b, 30)).alias("w")).select("w.from", "w.to")


@query("f65_tolerant_bool", "SELECT * FROM (VALUES ('true', true), ('0', false), ('não', false), ('sim', true), (NULL, true)) t(v, b)")
def f65(spark, sf):
    return spark.createDataFrame([("true",), ("0",), ("não",), ("sim",), (None,)], "v string").select("v", numbers.tolerant_bool(F.col("v")).alias("b"))


@query("f66_weekday", "SELECT isodow(ts) < 6 AS weekday, count(*) AS n FROM events GROUP BY 1")
def f66(spark, sf):
    return table(spark, sf, "events").groupBy((F.weekday("ts") < 5).alias("weekday")).agg(F.count("*").alias("n"))


@query("f67_lag_days", "SELECT l_orderkey, max(date_diff('day', o_orderdate::DATE, l_shipdate::DATE))::INT AS lag FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def f67(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("l_orderkey").agg(F.max(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).alias("lag"))


@query("f68_months", "SELECT d::INT AS d, round(d / 30.44, 6) AS m FROM (SELECT unnest(range(0, 400, 50)) AS d)")
def f68(spark, sf):
    return spark.range(0, 400, 50).select(F.col("id").cast("int").alias("d"), F.round(dates.months(F.col("id")), 6).alias("m"))


@query("f69_partial_bucket", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, strftime(ts, '%Y-%m-%d') = (SELECT strftime(max(ts), '%Y-%m-%d') FROM events) AS partial FROM events GROUP BY 1")
def f69(spark, sf):
    e = table(spark, sf, "events")
    per = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(e.agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last")))).select("day", "n", (F.col("day") == F.col("last")).alias("partial"))  # one row


@query("f70_parse_brl", "SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS v FROM orders")
def f70(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numbers.parse_brl(numbers.format_brl(F.col("o_totalprice"))).alias("v"))


@query("f71_squash", "SELECT c_custkey, round(ln(1 + abs(c_acctbal)) / ln(500), 6) AS l, round(1 / (1 + exp(-greatest(-30, least(30, (c_acctbal - 4500) / 3000)))), 6) AS s FROM customer")
def f71(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(numbers.log_ratio(F.abs("c_acctbal"), 500), 6).alias("l"), F.round(numbers.sigmoid(numbers.z_score(F.col("c_acctbal"), 4500.0, 3000.0)), 6).alias("s"))


@query("f72_half_even", "SELECT k::INT AS k, round_even(k / 8.0, 2)::DOUBLE AS r FROM (SELECT unnest(range(0, 16)) AS k)")
def f72(spark, sf):
    return spark.range(16).select(F.col("id").cast("int").alias("k"), numbers.half_even(F.col("id") / 8.0, 2).alias("r"))


@query("f73_compound_index", "SELECT user_id, round(exp(sum(ln(1 + (event_id % 7) / 100.0))), 6) AS factor FROM events GROUP BY 1")
def f73(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list((F.col("event_id") % 7).cast("double")).alias("r"))
    return e.select("user_id", F.round(numbers.compound(F.col("r")), 6).alias("factor"))


@query("f74_present_value", "SELECT o_orderkey, round((o_totalprice * pow(1.04 / 1.12, o_orderkey % 10))::DECIMAL(38, 6), 2)::DOUBLE AS pv FROM orders")
def f74(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(numbers.present_value(F.col("o_totalprice"), F.col("o_orderkey") % 10, 0.12, 0.04).cast("decimal(38,6)"), 2).cast("double").alias("pv"))


@query("f75_payment_year", "SELECT o_orderkey, (year(o_orderdate) + CASE WHEN o_orderdate::DATE > make_date(year(o_orderdate), 4, 2) THEN 2 ELSE 1 END)::INT AS due FROM orders")
def f75(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.payment_year(F.to_date("o_orderdate")).alias("due"))


@query("f76_opportunity", "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN (0.5 * p_size / 50 + 0.3 * p_retailprice / 2000) / 0.8 ELSE p_size / 50 END, 3) AS score FROM part")
def f76(spark, sf):
    pillar = lambda w, v: F.struct(F.lit(w).alias("weight"), v.cast("double").alias("value"))
    p = F.array(pillar(0.5, F.col("p_size") / 50), pillar(0.3, F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") / 2000)), pillar(0.2, F.lit(None)))
    return table(spark, sf, "part").select("p_partkey", F.round(numbers.opportunity(p), 3).alias("score"))


@query("f77_json_list", "SELECT event_id, event_id % 5 AS a, event_id % 3 AS b FROM events")
def f77(spark, sf):
    j = F.concat(F.lit("[["), (F.col("event_id") % 5).cast("string"), F.lit(","), (F.col("event_id") % 3).cast("string"), F.lit("]]"))
    e = table(spark, sf, "events").select("event_id", F.explode(F.from_json(j, "array<array<long>>")).alias("p"))
    return e.select("event_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


@query("f78_enum_default", "SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1")
def f78(spark, sf):
    return table(spark, sf, "events").groupBy(F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


@query("f79_cosine_topk", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS similarity FROM embeddings WHERE vec_id <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def f79(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", numbers.cosine(F.col("embedding"), F.col("q")).alias("s"))  # one row
    return s.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 5).alias("similarity"))


@query("f79_nearest_centroid", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), u AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM u GROUP BY 1) SELECT vec_id, arg_min(c.label, list_distance(v, c) * 1e6 + c.label / 1e6)::INT AS nearest FROM e, c GROUP BY 1")
def f79b(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    u = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = u.groupBy(F.col("label").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    few = F.broadcast(c)  # one row a label, a fixed set
    d = e.crossJoin(few).select("vec_id", F.struct(numbers.squared_distance(F.col("embedding"), F.col("c")), F.col("k")).alias("d"))
    return d.groupBy("vec_id").agg(F.min("d").alias("d")).select("vec_id", F.col("d.k").alias("nearest"))


@query("f82_role_pole", "SELECT l_linestatus, l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'passive' WHEN l_returnflag = 'A' THEN 'active' ELSE 'other' END AS pole, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def f82(spark, sf):
    from lexmill.operators.merge import pole_of

    role = F.when(F.col("l_returnflag") == "R", "Executado(a)").when(F.col("l_returnflag") == "A", "AUTOR").otherwise("Perito")
    return table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag", pole_of(role).alias("pole")).agg(F.count("*").alias("n"))


@query("f83_format_brl", "SELECT o_orderkey, 'R$ ' || translate(format('{:,.2f}', o_totalprice::DECIMAL(18,2)::DOUBLE), ',.', '.,') AS s FROM orders")
def f83(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numbers.format_brl(F.col("o_totalprice")).alias("s"))


@query("p26_box_kind", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'case' WHEN 1 THEN 'cpf' WHEN 2 THEN 'bar' ELSE 'name' END AS kind FROM {NUMBERED}")
def p26(spark, sf):
    k, n = F.col("o_orderkey") % 4, F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    box = F.when(k == 0, F.col("cnj")).when(k == 1, F.concat(F.lit("123.45"), n.substr(6, 1), F.lit(".789-00"))).when(k == 2, F.concat(F.lit("SP "), n)).otherwise("Fulano de Tal")
    return numbered(spark, sf).select("o_orderkey", ids.box_kind(box).alias("kind"))
