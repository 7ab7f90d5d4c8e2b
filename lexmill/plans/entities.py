"""Entity resolution queries (E01 to E09) on parties built from suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.io import scratch, stage, table
from lexmill.operators import entities
from lexmill.plans.base import query


def parties(spark, sf):
    """Parties from customers: three names, roots of which one is common and others are typing errors."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ("Banco Alfa SA", "Fundo de Saúde", "Instituto Nacional do Seguro Social - INSS"))), (k % 3 + 1).cast("int"))
    root = F.when(k % 3 == 0, F.when(k % 150 == 0, F.lpad((k + 50000000).cast("string"), 8, "0")).otherwise("11222333")).when(k % 3 == 1, F.lpad((k % 40 + 20000000).cast("string"), 8, "0"))
    return table(spark, sf, "customer").select("c_custkey", name.alias("name"), F.concat(root, F.lit("000181")).alias("doc"))


PARTIES = "(SELECT c_custkey, k, CASE k WHEN 0 THEN 'BANCO ALFA' WHEN 1 THEN 'FUNDO SAUDE' ELSE 'INSTITUTO NACIONAL SEGURO SOCIAL' END AS name_key, CASE k WHEN 0 THEN CASE WHEN c_custkey % 150 = 0 THEN lpad((c_custkey + 50000000)::VARCHAR, 8, '0') ELSE '11222333' END WHEN 1 THEN lpad((c_custkey % 40 + 20000000)::VARCHAR, 8, '0') END AS root FROM (SELECT c_custkey, c_custkey % 3 AS k FROM customer))"
GROUPS = f"(SELECT coalesce(root, name_key) AS key, CASE WHEN root IS NULL THEN 'name' ELSE 'root' END AS key_kind, any_value(name_key) AS name_key, count(*) AS rows FROM {PARTIES} GROUP BY 1, 2)"
DOMINANT = f"(SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY rows DESC, key) AS place, sum(rows) OVER (PARTITION BY name_key) AS total, count(*) OVER (PARTITION BY name_key) AS members, max(rows) OVER (PARTITION BY name_key) AS top, nth_value(rows, 2) OVER (PARTITION BY name_key ORDER BY rows DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {GROUPS} WHERE key_kind = 'root')"


def grouped(spark, sf):
    return entities.group_parties(parties(spark, sf), "name", "doc")


@query("e01_scope", "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'no name' WHEN c_custkey % 7 = 1 THEN 'lawyer' WHEN c_custkey % 7 = 2 THEN 'person' WHEN c_custkey % 7 = 3 THEN 'placeholder' WHEN c_custkey % 7 = 4 THEN 'company number' WHEN c_custkey % 7 = 5 THEN 'public body' ELSE 'other' END AS reason, c_custkey % 7 IN (4, 5) AS inside, count(*) AS n FROM customer GROUP BY 1, 2")
def e01(spark, sf):
    k = F.col("c_custkey") % 7
    name = F.when(k == 0, " ").when(k == 3, "Informação Protegida").when(k == 5, "Prefeitura de X").otherwise("Fulano")
    doc = F.when(k == 2, "123.456.789-09").when(k == 4, "11.222.333/0001-81")
    s = entities.scope(name, doc, F.lit(None).cast("string"), F.lit(None).cast("string"), F.when(k == 1, "SP1"))
    return table(spark, sf, "customer").select(s.alias("s")).groupBy("s.reason", "s.inside").agg(F.count("*").alias("n"))


@query("e02_group_parties", f"SELECT key, key_kind, name_key, rows FROM {GROUPS}")
def e02(spark, sf):
    return grouped(spark, sf).select("key", "key_kind", "name_key", "rows")


@query("e03_typo_merge", f"SELECT r.key AS absorbed, l.key AS leader FROM {DOMINANT} r JOIN {DOMINANT} l USING (name_key) WHERE l.place = 1 AND r.place > 1 AND r.rows <= 1 AND l.members > 1 AND l.top >= 0.9 * l.total AND l.top >= 10 * l.second")
def e03(spark, sf):
    return entities.typo_merges(grouped(spark, sf)).select("absorbed", "leader")


@query("e04_name_merge", f"SELECT g.key AS absorbed, d.key AS leader FROM {GROUPS} g JOIN {DOMINANT} d USING (name_key) WHERE g.key_kind = 'name' AND (d.members = 1 OR (d.place = 1 AND d.top >= 0.9 * d.total AND d.top >= 10 * d.second))")
def e04(spark, sf):
    return entities.name_merges(grouped(spark, sf)).select("absorbed", "leader")


# Customers by key mod 25 as rows of a body, its sections, acronym and homonyms: (remainders, name, name key, words, root).
NAMED = (
    (range(0, 13), "Instituto Nacional do Seguro Social", "INSTITUTO NACIONAL SEGURO SOCIAL", "INSTITUTO NACIONAL DO SEGURO SOCIAL", "29979036"),
    (range(13, 14), "Instituto Nacional do Seguro Social - INSS", "INSTITUTO NACIONAL SEGURO SOCIAL", "INSTITUTO NACIONAL DO SEGURO SOCIAL INSS", "29979036"),
    (range(14, 15), "INSS", "INSS", "INSS", "11111111"),
    (range(15, 16), "CEAB - INSS", "CEAB", "CEAB INSS", None),
    (range(16, 17), "Sindicato dos Servidores do INSS no Norte", "SINDICATO SERVIDORES INSS NORTE", "SINDICATO DOS SERVIDORES DO INSS NO NORTE", None),
    (range(17, 21), "União Federal", "UNIAO FEDERAL", "UNIAO FEDERAL", None),
    (range(21, 22), "Procuradoria Federal Geral", "PROCURADORIA FEDERAL GERAL", "PROCURADORIA FEDERAL GERAL", "05489410"),
    (range(22, 23), "INSS Procuradoria Federal Geral", "INSS PROCURADORIA FEDERAL GERAL", "INSS PROCURADORIA FEDERAL GERAL", None),
    (range(23, 24), "Banco Alfa", "BANCO ALFA", "BANCO ALFA", "33000167"),
    (range(24, 25), "Banco Alfa Agência Sul", "BANCO ALFA AGENCIA SUL", "BANCO ALFA AGENCIA SUL", None),
)
# One customer in 1,500 has a root of its own by a typing error; customers of remainder 1 have none.
TYPING = (42, 43, 50)


def named_parties(spark, sf):
    k = F.col("c_custkey")
    by = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in NAMED for _ in r[0]]), (k % 25 + 1).cast("int"))
    root = F.when((k % 1500).isin(*TYPING), F.lpad((k + 70000000).cast("string"), 8, "0")).when(k % 25 != 1, by(4))
    return table(spark, sf, "customer").select(by(1).alias("name"), F.concat(root, F.lit("000181")).alias("doc"))


def named_spellings(spark, sf):
    return entities.spellings(named_parties(spark, sf), "name", "doc")


def _by(i: int) -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    return "CASE " + " ".join(f"WHEN c_custkey % 25 BETWEEN {r[0].start} AND {r[0].stop - 1} THEN {quoted(r[i])}" for r in NAMED) + " END"


def _groups(source: str) -> str:
    return f"(SELECT key, kind, arg_max(name_key, n * 1000 + length(words)) AS name_key, arg_max(words, n * 1000 + length(words)) AS label, sum(n) AS rows FROM {source} GROUP BY 1, 2)"


def _ranked(source: str, among: str) -> str:
    return f"(SELECT *, row_number() OVER o AS place, sum(rows) OVER w AS total, count(*) OVER w AS members, max(rows) OVER w AS top, nth_value(rows, 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM (SELECT *, bool_or(kind = 'name') OVER (PARTITION BY name_key) AS unproved FROM {_groups(source)}) WHERE {among} WINDOW w AS (PARTITION BY name_key), o AS (PARTITION BY name_key ORDER BY rows DESC, key))"


def _alike(source: str, among: str) -> str:
    r = _ranked(source, among)
    return f"(SELECT r.key, r.kind, l.key AS leader, l.kind AS leader_kind FROM {r} r JOIN {r} l USING (name_key) WHERE l.place = 1 AND r.place > 1 AND r.rows <= 1 AND r.label = l.label AND l.top >= 0.9 * l.total AND l.top >= 10 * l.second)"


def _after(source: str, decisions: str) -> str:
    return f"SELECT coalesce(leader, s.key) AS key, coalesce(leader_kind, s.kind) AS kind, name_key, words, sum(n) AS n FROM {source} s LEFT JOIN {decisions} d ON s.key = d.key AND s.kind = d.kind GROUP BY 1, 2, 3, 4"


ROOTS = "kind = 'root'"
_ROOT = f"CASE WHEN c_custkey % 1500 IN (42, 43, 50) THEN lpad((c_custkey + 70000000)::VARCHAR, 8, '0') WHEN c_custkey % 25 <> 1 THEN {_by(4)} END"
_NAMES = f"(SELECT g.key, g.kind, l.key AS leader, 'root' AS leader_kind FROM {_groups('s1')} g JOIN {_ranked('s1', ROOTS)} l USING (name_key) WHERE g.kind = 'name' AND l.place = 1 AND (l.members = 1 OR (l.top >= 0.9 * l.total AND l.top >= 10 * l.second)))"
PASSES = (
    f"p AS MATERIALIZED (SELECT {_by(2)} AS name_key, {_by(3)} AS words, {_ROOT} AS root FROM customer), "
    "s0 AS MATERIALIZED (SELECT coalesce(root, name_key) AS key, CASE WHEN root IS NULL THEN 'name' ELSE 'root' END AS kind, name_key, words, count(*) AS n FROM p GROUP BY ALL), "
    f"d1 AS MATERIALIZED (SELECT * FROM {_alike('s0', ROOTS)}), s1 AS MATERIALIZED ({_after('s0', 'd1')}), "
    f"d2 AS MATERIALIZED (SELECT * FROM {_NAMES}), s2 AS MATERIALIZED ({_after('s1', 'd2')}), "
    f"d3 AS MATERIALIZED (SELECT * FROM {_alike('s2', 'unproved')}), s3 AS MATERIALIZED ({_after('s2', 'd3')})"
)
# Labels within labels and acronyms, then the owner's own owner, one owner, and ten times the rows.
FACETS = (
    f"g AS MATERIALIZED (SELECT * FROM {_groups('s3')} WHERE contains(label, ' ') OR rows >= 5), "
    "owns AS (SELECT * FROM g WHERE kind = 'root' AND NOT regexp_matches(name_key, '^(ESTADO|MUNICIPIO|UNIAO)')), "
    "short AS (SELECT DISTINCT o.key AS owner, o.rows AS owner_rows, list_aggregate(list_transform(string_split(o.name_key, ' '), lambda x: x[1]), 'string_agg', '') AS short, s.words FROM owns o JOIN s3 s ON s.key = o.key AND s.kind = 'root' AND s.name_key = o.name_key), "
    "a AS (SELECT g.key, g.kind, min(g.rows) AS rows, min(owner) AS owner, min(owner_rows) AS owner_rows FROM g JOIN (SELECT DISTINCT owner, owner_rows, short FROM short WHERE length(short) >= 3 AND contains(' ' || words || ' ', ' ' || short || ' ')) ON short = g.label AND g.key <> owner GROUP BY 1, 2 HAVING count(DISTINCT owner) = 1), "
    "l AS (SELECT f.key, f.kind, f.rows, coalesce(a.owner, o.key) AS owner, coalesce(a.owner_rows, o.rows) AS owner_rows FROM g f JOIN owns o ON contains(' ' || f.label || ' ', ' ' || o.label || ' ') AND f.label <> o.label AND f.kind = 'name' AND NOT contains(f.name_key, 'SINDICATO') LEFT JOIN a ON a.key = o.key AND a.kind = 'root' AND a.owner_rows >= 10 * a.rows), "
    "f AS MATERIALIZED (SELECT key AS facet, kind AS facet_kind, CASE WHEN count(DISTINCT owner) > 1 THEN 'ambiguous' WHEN min(owner_rows) < 10 * min(rows) THEN 'not dominant' ELSE 'merged' END AS outcome, min(owner) AS first_owner FROM (SELECT * FROM a UNION ALL SELECT key, kind, rows, owner, owner_rows FROM l) GROUP BY 1, 2)"
)


@query("e05_spelling_merge", f"WITH {PASSES} SELECT key AS absorbed, kind AS absorbed_kind, leader FROM d3")
def e05(spark, sf):
    s = named_spellings(spark, sf)
    for decide in (entities.typo_merges, entities.name_merges):
        s = stage(entities.merged(s, decide(entities.groups_of(s))))
    return entities.spelling_merges(entities.groups_of(s)).select("absorbed", "absorbed_kind", "leader")


@query("e06_facet_plan", f"WITH {PASSES}, {FACETS} SELECT facet, facet_kind, outcome, CASE WHEN outcome = 'merged' THEN first_owner END AS owner FROM f")
def e06(spark, sf):
    return entities.facet_plan(entities.consolidated(named_spellings(spark, sf), stage), stage)


@query("e06_pointer_roots", "WITH RECURSIVE p AS (SELECT c_custkey AS node, c_custkey AS cur FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT node, cur - 1 FROM p WHERE cur % 10 <> 0) SELECT node, min(cur) AS root FROM p GROUP BY 1")
def e06b(spark, sf):
    from lexmill.sources.files import staged

    base = scratch(spark)
    n = iter(range(1000))
    c = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - 1).alias("b"))
    return entities.resolve_roots(c, "a", "b", lambda d: staged(d, f"{base}/{next(n)}"))


@query("e07_search_variants", "WITH s AS (SELECT p_brand AS key, p_type AS name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, name) AS place, sum(n) OVER (PARTITION BY key) AS total FROM s) SELECT key, name, n FROM r WHERE place <= 3 OR (n >= 2 AND n >= 0.01 * total)")
def e07(spark, sf):
    s = table(spark, sf, "part").groupBy(F.col("p_brand").alias("key"), F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    return entities.search_variants(s, "key", "n")


@query("e08_pruned_spellings", "WITH s AS (SELECT p_brand AS key, upper(name) AS name, count(*) AS n FROM (SELECT p_brand, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2), p_name]) AS name, p_partkey FROM part) GROUP BY ALL) SELECT a.* FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.key = a.key AND b.name <> a.name AND contains(' ' || b.name || ' ', ' ' || a.name || ' ') AND a.n <= b.n)")
def e08(spark, sf):
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    names = F.explode(F.array(word(1), F.concat_ws(" ", word(1), word(2)), F.col("p_name")))
    s = table(spark, sf, "part").select(F.col("p_brand").alias("key"), names.alias("name"))
    return entities.pruned_spellings(s.groupBy("key", F.upper("name").alias("name")).agg(F.count("*").alias("n")), "key", "n")


@query("e09_merge_passes", f"WITH {PASSES}, {FACETS}, m AS (SELECT facet AS key, facet_kind AS kind, first_owner AS leader, 'root' AS leader_kind FROM f WHERE outcome = 'merged'), s4 AS ({_after('s3', 'm')}) SELECT key, kind AS key_kind, sum(n)::BIGINT AS rows FROM s4 GROUP BY 1, 2")
def e09(spark, sf):
    s = entities.consolidated(named_spellings(spark, sf), stage)
    s = entities.merged(s, entities.facet_merges(s, stage))
    return entities.groups_of(s).select("key", "key_kind", "rows")


@query("p17_any_variant", "SELECT doc_id FROM documents WHERE contains(lower(text), 'mit license') OR contains(lower(text), 'apache license')")
def p17(spark, sf):
    toks = text.tokens(F.col("text"))
    variants = F.array(F.lit("mit license"), F.lit("apache license"))
    return table(spark, sf, "documents").where(F.exists(variants, lambda v: text.has_phrase(toks, v))).select("doc_id")
