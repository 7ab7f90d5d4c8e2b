"""Behaviour that the queries on tables do not reach."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import dates, ids, numbers, text
from lexmill.io import scratch, stage
from lexmill.operators import aggregates as agg
from lexmill.operators import classify, entities, filters, merge, relational, search
from lexmill.sources import files
from lexmill.streaming import pipelines


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_unknown_is_not_zero(spark):
    d = spark.createDataFrame([("a", None), ("b", True), ("b", None), ("c", False)], "court string, flag boolean")
    assert dict(d.groupBy("court").agg(agg.known_count(F.col("flag")).alias("n")).collect()) == {"a": None, "b": 1, "c": 0}


@pytest.mark.parametrize("n", [0, 9, 10, 13, 100, 333])
def test_rank_slices(spark, n):
    rows = [(i,) for i in range(n)]
    got = [r.slice for r in agg.rank_slices(spark.createDataFrame(rows, "v int"), [F.col("v")], [], stage).orderBy("v").collect()]
    assert got == ([] if n < 10 else [-(-10 * (i + 1) // n) for i in range(n)])


def test_pages_lose_and_repeat_nothing(spark):
    rows = [(i, None if i % 4 == 0 else i % 3) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, v long")
    seen, after = [], None
    while page := relational.keyset_page(d, "v", "id", after, 7).collect():
        seen += [r.id for r in page]
        cursor = relational.encode_cursor([page[-1].v, page[-1].id], "v")
        after = relational.decode_cursor(cursor, "v")
    assert seen == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def test_cursor_errors():
    for bad in ("", "%%%", relational.encode_cursor([1], "other")):
        with pytest.raises(ValueError, match="cursor"):
            relational.decode_cursor(bad, "v")


def test_range_parameters():
    assert filters.bounds({"value_min": "5", "value_max": "2"}, "value") == (2, 5)
    assert filters.bounds({"value_min": "-5", "value_max": "x"}, "value") == (None, None)
    assert filters.bounds({"year_min": "1000", "year_max": "9999"}, "year") == filters.YEARS


def test_case_numbers(spark):
    good = "0000001-45.2020.8.26.0001"
    base = int("0000001" + "2020" + "8" + "26" + "0001" + "00") % 97
    good = good.replace("-45", f"-{98 - base:02d}")
    assert one(spark, ids.case_check(F.lit(good))) and one(spark, ids.case_court(F.lit(good))) == "TJSP"
    assert not one(spark, ids.case_check(F.lit(good.replace("2020", "2021")))) and not one(spark, ids.case_check(F.lit("12")))
    spaced = good.replace("-", " - ").replace(".", ". ")
    assert one(spark, ids.cases_in_text(F.lit(f"9{good} x {spaced}"))) == [good]
    for number, court in (("5", "TRT7"), ("4", None), ("6", "TREAM")):
        n = f"0000001-00.2020.{number}.{'07' if number != '6' else '04'}.0001"
        assert one(spark, ids.case_court(F.lit(n))) == court


def test_documents(spark):
    assert one(spark, ids.cpf_check(F.lit("52998224725"))) and not one(spark, ids.cpf_check(F.lit("11111111111")))
    assert one(spark, ids.document(F.lit("11.222.333/0001-81"))).asDict() == {"kind": "cnpj", "digits": "11222333000181", "masked": "11.222.333/0001-81", "root": "11222333", "valid": True}
    assert one(spark, ids.document(F.lit("11222333"))).masked == "11.222.333"
    with pytest.raises(Exception, match="id too long"):
        one(spark, ids.external_id("s", F.lit("x" * 70)))


def test_names(spark):
    same = ["Instituto Nacional do Seguro Social - INSS", "INSTITUTO NACIONAL DO SEGURO SOCIAL", "INSTITUTO NACIONAL DO SEGURO SOCIAL (REQUERIDO(A))", "Instituto Nacional do Seguro Social — REQUERIDO"]
    assert {one(spark, text.normal_name(F.lit(s))) for s in same} == {"INSTITUTO NACIONAL SEGURO SOCIAL"}
    assert one(spark, text.normal_name(F.lit("HENRI - INDUSTRIA LTDA"))) == "HENRI INDUSTRIA"
    assert one(spark, text.clean_label(F.lit("Município de X - EXECUTADO"))) == "Município de X"


def test_windows_merge_where_they_touch(spark):
    t = F.lit("a" * 50 + "HIT" + "b" * 10 + "HIT" + "c" * 100 + "HIT")
    assert [tuple(w) for w in one(spark, text.windows_around(t, "HIT", 20))] == [(30, 86), (146, 169)]


def test_numbers(spark):
    assert str(one(spark, numbers.parse_brl(F.lit("R$ 1.234,56")))) == "1234.56"
    assert one(spark, numbers.first_of(F.lit('[[{"a":{"b":3}}]]'), "a.b")) == "3"
    p = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(v).cast("double").alias("value")) for w, v in ((0.5, 1.0), (0.5, None))])
    assert one(spark, numbers.opportunity(p)) == 1.0
    assert [str(w[0]) for w in one(spark, dates.chunks(F.lit("2024-01-01").cast("date"), F.lit("2024-01-10").cast("date"), 4))] == ["2024-01-01", "2024-01-05", "2024-01-09"]


def test_stage_ladder(spark):
    stories = {
        1: ["Expedição de precatório", "extinção pelo pagamento", "alvará de levantamento"], 2: ["Julgo improcedente", "Expedição de RPV"], 3: ["Expedição de precatório"],
        4: ["Cumprimento de sentença", "Homologo os cálculos", "trânsito em julgado"], 5: ["Despacho"], 6: ["extinção dos embargos sem resolução do mérito", "Julgo procedente"],
        7: ["Expedição de RPV", "Julgo improcedente"],
    }
    rows = [(c, f"2024-01-{i + 1:02d}", t) for c, s in stories.items() for i, t in enumerate(s)]
    m = spark.createDataFrame(rows, "case int, day string, text string").withColumn("day", F.col("day").cast("date"))
    got = {r.case: (r.stage, r.seal, r.badges) for r in classify.stage(classify.case_signals(m, "case", "day", "text")).collect()}
    assert got[1][:2] == ("closed", "satisfied") and got[2][0] == "issued" and "denial overtaken" in got[2][2]
    assert got[3][0] == "issued" and got[4][0] == "pre" and got[5][0] == "undefined"
    assert got[6][0] == "right" and "side issue" in got[6][2] and got[7][:2] == ("closed", "denied")


def test_dominance(spark):
    rows = [("r1", "root", "INSS", "INSS", 764)] + [(f"t{i}", "root", "INSS", "Inss", 1) for i in range(4)] + [(f"f{i}", "root", "FUNDO", "FUNDO", 1) for i in range(85)]
    g = spark.createDataFrame(rows, "key string, key_kind string, name_key string, label string, rows long")
    assert {tuple(r) for r in entities.typo_merges(g).select("absorbed", "leader").collect()} == {(f"t{i}", "r1") for i in range(4)}


def test_pointer_roots_with_a_cycle(spark):
    d = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10)], "a long, b long")
    base, n = scratch(spark), iter(range(99))
    got = dict(entities.resolve_roots(d, "a", "b", lambda x: files.staged(x, f"{base}/{next(n)}")).collect())
    assert got == {1: 4, 2: 4, 3: 4, 10: 10, 11: 11}


def test_pointer_roots_of_a_long_chain(spark):
    base, n = scratch(spark), iter(range(99))
    d = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = entities.resolve_roots(d, "a", "b", lambda x: files.staged(x, f"{base}/{next(n)}"))
    assert got.where("root = 300").count() == 300


def test_name_keys(spark):
    keys = lambda *names: [one(spark, text.normal_name(F.lit(n))) for n in names]
    assert keys("A&E TRANSPORTES LTDA", "A. O. TRANSPORTES LTDA", "Transportes LTDA") == ["A E TRANSPORTES", "A O TRANSPORTES", "TRANSPORTES"]
    assert keys("União dos Estados nas Américas", "HENRIMAR - INDUSTRIA E COMERCIO LTDA", "Banco Alfa, SUDESTE") == ["UNIAO ESTADOS AMERICAS", "HENRIMAR INDUSTRIA E COMERCIO", "BANCO ALFA"]
    assert set(keys("Instituto Nacional do Seguro Social - INSS", "INSTITUTO NACIONAL DO SEGURO SOCIAL (REQUERIDO(A))", "Instituto Nacional do Seguro Social — REQUERENTE")) == {"INSTITUTO NACIONAL SEGURO SOCIAL"}
    assert one(spark, text.grouping_name(F.lit("INSS - Instituto e a Saúde"))) == "INSTITUTO SAUDE" and one(spark, text.grouping_name(F.lit("INSS"))) == "INSS"


def test_phrases_by_either_way(spark):
    d = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick brown"), (3, ""), (4, None), (5, "fox fox")], "id int, t string").withColumn("toks", text.tokens(F.col("t")))
    n = spark.createDataFrame([("quick brown",), ("brown fox",), ("fox",), ("the brown",)], "name string")
    for most in (10_000, 0):
        got = {tuple(r) for r in entities.phrase_join(d, "id", "toks", n, "name", max_inline=most).collect()}
        assert got == {(1, "quick brown"), (1, "brown fox"), (1, "fox"), (2, "quick brown"), (5, "fox")}


def test_running_sums_over_ranges(spark):
    d = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), "id", (F.col("id") % 5).alias("v"))
    base, n = scratch(spark), iter(range(9))
    got = {r.id: r.before for r in relational.running(d, [F.desc("k"), F.col("id")], {"before": F.col("v")}, lambda x: files.staged(x, f"{base}/{next(n)}")).collect()}
    total, want = 0, {}
    for i in sorted(range(500), key=lambda i: (-(i * 37 % 101), i)):
        want[i], total = total, total + i % 5
    assert got == want
    assert relational.running(d.where("false"), [F.col("id")], {"before": F.col("v")}, lambda x: files.staged(x, f"{base}/{next(n)}")).count() == 0


def test_a_stopped_upsert_loses_nothing(spark):
    path = scratch(spark)
    t = lambda rows: spark.createDataFrame(rows, "k long, v long")
    files.upsert_parquet(spark, path, t([(1, 1), (2, 1)]), ["k"], "v")
    # what a batch leaves that stops before its commit: a folder without its mark
    t([(9, 9)]).write.parquet(f"{path}/v{2:012d}")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{2:012d}/_SUCCESS")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    assert {r.k for r in files.read_upserted(spark, path).collect()} == {1, 2}
    broken = t([(3, 3)]).withColumn("v", F.raise_error(F.lit("stopped")).cast("long"))
    with pytest.raises(Exception, match="stopped"):
        files.upsert_parquet(spark, path, broken, ["k"], "v")
    assert {r.k for r in files.read_upserted(spark, path).collect()} == {1, 2}
    for _ in range(4):
        files.upsert_parquet(spark, path, t([(3, 3), (2, 0)]), ["k"], "v")
    assert sorted(map(tuple, files.read_upserted(spark, path).collect())) == [(1, 1), (2, 1), (3, 3)]


def test_stage_patterns(spark):
    said = {
        "issued": ("Requisição de pagamento de pequeno valor enviada", "Determino a expedição de RPV", "Expeça-se o ofício requisitório", "Precatório expedido"),
        "accounts": ("Homologação dos cálculos", "Homologo os cálculos"),
        "satisfied": ("pagamento integral, declaro extinta a execução", "nos termos do art. 924, II", "Extinto o feito pelo cumprimento da obrigação"),
        "denied": ("Indeferimento da petição inicial", "a prescrição intercorrente foi decretada", "Pronuncio a prescrição"),
        "no_merits": ("com base no art. 485 do CPC",),
        "payment": ("Expeça-se alvará", "levantamento dos valores"),
        "part_payment": ("levantamento parcial",),
    }
    rows = [(k, t) for k, ts in said.items() for t in ts]
    m = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "case int, text string").withColumn("day", F.lit("2024-01-01").cast("date"))
    got = {r.case: r for r in classify.case_signals(m, "case", "day", "text").collect()}
    assert [(k, t) for i, (k, t) in enumerate(rows) if not got[i][f"{k}_n"]] == []


def test_merge_rules(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", ""), (4, "b", "x"), (5, "b", "y")], "id int, name string, doc string")
    assert [tuple(r) for r in merge.merge_into_single(d, "id", "name", "doc").collect()] == [(1, 2)]
    assert one(spark, merge.pole_of(F.lit("Exequente"))) == "active" and one(spark, merge.pole_of(F.lit(None).cast("string"))) == "other"


def test_late_events_and_validation(spark):
    ev = lambda p, t, s="ok", v=1: (f'{{"v":{v},"process_id":{p},"status":"{s}","scraped_at":"2024-01-{t:02d}T00:00:00Z","data":"{{}}"}}',)
    none = spark.createDataFrame([], "process_id long, status string, scraped_at timestamp, data string")
    a, n = pipelines.apply_events(spark.createDataFrame([ev(1, 5), ev(1, 3), ev(2, 5), ev(3, 1, v=2), ("junk",)], "value string"), none)
    assert tuple(n.first()) == (2, 0)
    b, n = pipelines.apply_events(spark.createDataFrame([ev(1, 4), ev(2, 6), ev(2, 5)], "value string"), a)
    assert tuple(n.first()) == (1, 1)
    assert {r.process_id: r.scraped_at.day for r in b.collect()} == {1: 5, 2: 6}


def test_failure_does_not_advance(spark):
    src, out, check = scratch(spark), scratch(spark), scratch(spark)
    spark.range(10).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long").parquet(src)

    def broken(batch, i):
        raise RuntimeError("sink is down")

    with pytest.raises(Exception, match="sink is down"):
        pipelines.run_once(stream(), broken, check)
    sink = pipelines.upsert_sink(spark, out, ["id"], "id", lambda d: d.withColumn("n", F.lit(1)))
    pipelines.run_once(stream(), sink, check)
    assert files.read_upserted(spark, out).count() == 10
    pipelines.run_once(stream(), broken, check)  # nothing new: the sink is not called


def test_detections_once(spark):
    b = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "t int, m int")
    assert [tuple(r) for r in pipelines.detections(b, b.where("t = 2"), ["t", "m"]).collect()] == [(1, 1)]


def test_bm25_prefers_rare_words(spark):
    d = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common"), (4, "none")], "id int, t string").withColumn("toks", text.tokens(F.col("t")))
    got = dict(search.bm25(d, "id", F.col("toks"), "rare common").collect())
    assert set(got) == {1, 2, 3} and got[1] > got[2]


def test_lawyer_names():
    from lexmill.functions.python import names_before_bar, page_text

    assert names_before_bar("Adv. João da Silva OAB/SP 1; pela ré, Maria Lima (OAB 2)") == ["João da Silva", "Maria Lima"]
    assert names_before_bar("Intimação do advogado SICRANO PEREIRA (OAB/MG 45678) e ADVOGADO(A): FULANA DE SOUZA [OAB 1]; SICRANO PEREIRA OAB") == ["SICRANO PEREIRA", "FULANA DE SOUZA"]
    assert names_before_bar("Maria, OAB 1; Dr. José OAB 2; de Lima Neto OAB 3") == ["Lima Neto"]  # one word is no name
    assert names_before_bar("A B C D E F G H I J OAB") == ["C D E F G H I J"] and names_before_bar(None) == []
    assert page_text("<p>a</p><script>var t='</p>'</script><b>c &amp; d") == "a c & d"


def test_mined_cases_and_their_reasons(spark):
    rows = [(1, "X", 0.1, 3, 3, 1, 0.7, 0.8, 0.8), (2, "H", None, 9, 0, 0, None, None, 0.9), (3, "X", 0.5, 9, 0, 0, 0.6, 0.7, 0.7), (4, "X", 0.15, 0, 9, 1, 1.0, 1.0, 1.0), (5, "X", 0.2, 9, 1, 1, None, None, None), (6, None, 0.3, 5, 0, 1, None, None, 1.0)]
    d = spark.createDataFrame(rows, "case int, court string, score double, movements int, novel int, f1 int, like double, dense double, near double")
    got = {r.case: (round(r.suspicion, 6), r.reasons) for r in classify.mined(d, "case", "H").collect()}
    assert got == {1: (1.0, "E1|E2|E3|E4|E5|E6"), 5: (0.3, "E1|E2"), 6: (0.15, "E3")}
    m = spark.createDataFrame([(1, "RPV expedida. Trânsito"), (1, "Crédito líquido e certo, transitada em julgado"), (1, "RPV expedida"), (2, None)], "case int, text string")
    assert {tuple(r) for r in classify.novel_signals(m, "case", "text").collect()} == {(1, 3, 3), (2, 1, 0)}


def test_a_guarded_class_needs_its_threshold(spark):
    pick = lambda a, b, c: tuple(one(spark, classify.guarded_class({"a": F.lit(a), "b": F.lit(b), "closed": F.lit(c)}, "closed", 0.6)))
    assert pick(0.1, 0.3, 0.6) == ("closed", 0.6) and pick(0.1, 0.35, 0.55) == ("b", 0.35) and pick(0.5, 0.2, 0.3) == ("a", 0.5) and pick(0.3, 0.3, 0.4) == ("a", 0.3)


def test_logistic_regression_against_newton(spark):
    import numpy as np

    from lexmill.operators.learn import logistic, split

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1.0, 5.0] + [2.0, -1.0]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 2 + 0.3 * x[:, 1])))).astype(float)
    d = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, y double")
    z = np.c_[(x - x.mean(0)) / x.std(0, ddof=1), np.ones(300)]
    w, penalty = np.zeros(3), np.diag([0.01, 0.01, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / 300 + penalty, z.T @ (p - y) / 300 + penalty @ w)
    got = {r.id: r.probability for r in logistic(d, ["a", "b"], "y").collect()}
    assert max(abs(got[i] - p) for i, p in enumerate(1 / (1 + np.exp(-z @ w)))) < 1e-3
    learn, test = split(d, "id", "y")
    assert learn.count() + test.count() == 300 and learn.join(test, "id").count() == 0 and 0.8 <= learn.count() / 300 <= 0.95
    assert {r.id for r in learn.collect()} == {r.id for r in split(d.repartition(7), "id", "y")[0].collect()}


def test_facets_go_to_the_one_dominant_owner(spark, tmp_path):
    from itertools import count

    from lexmill.sources.files import staged

    n = count()
    checkpoint = lambda d: staged(d, f"{tmp_path}/{next(n)}")
    rows = [
        ("29979036", "root", "INSTITUTO NACIONAL SEGURO SOCIAL", "Instituto Nacional do Seguro Social", 600),
        ("29979036", "root", "INSTITUTO NACIONAL SEGURO SOCIAL", "Instituto Nacional do Seguro Social - INSS", 20),
        ("11111111", "root", "INSS", "INSS", 50),
        ("05489410", "root", "PROCURADORIA FEDERAL GERAL", "Procuradoria Federal Geral", 300),
        ("22222222", "root", "ESTADO GOIAS", "Estado de Goiás", 900),
        ("CEAB", "name", "CEAB", "CEAB - INSS", 4),
        ("CEAB SETOR", "name", "CEAB SETOR", "CEAB Setor", 3),
        ("CEAB SETOR", "name", "CEAB SETOR", "CEAB Setor INSS", 4),
        ("INSS PROCURADORIA FEDERAL GERAL", "name", "INSS PROCURADORIA FEDERAL GERAL", "INSS Procuradoria Federal Geral", 1),
        ("CONSELHO ESTADO GOIAS", "name", "CONSELHO ESTADO GOIAS", "Conselho do Estado de Goiás", 1),
        ("ASSOCIACAO INSS", "name", "ASSOCIACAO INSS", "Associação do INSS", 1),
        ("PROCURADORIA FEDERAL GERAL NORTE", "name", "PROCURADORIA FEDERAL GERAL NORTE", "Procuradoria Federal Geral Norte", 31),
        ("INSS SEDE", "name", "INSS SEDE", "INSS Sede", 5),
        ("INSS SEDE", "name", "INSS SEDE", "Sede Central", 4),
    ]
    s = spark.createDataFrame(rows, "key string, key_kind string, name_key string, name string, n long")
    got = {(r["facet"], r["owner"], r["outcome"]) for r in entities.facet_plan(s, checkpoint).collect()}
    assert got == {
        ("11111111", "29979036", "merged"),  # the acronym that a spelling shows
        ("CEAB", "29979036", "merged"),  # through the acronym to its owner
        ("CEAB SETOR", "29979036", "merged"),  # the shorter, rarer spelling does not count
        ("INSS PROCURADORIA FEDERAL GERAL", None, "ambiguous"),
        ("PROCURADORIA FEDERAL GERAL NORTE", None, "not dominant"),
    }
    after = {(r["key"], r["n"]) for r in entities.merged(s, entities.facet_merges(s, checkpoint)).groupBy("key").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert ("29979036", 600 + 20 + 50 + 4 + 7) in after and sum(x for _, x in after) == sum(r[-1] for r in rows)


def test_pruned_spellings_keep_the_more_frequent_short_form(spark):
    rows = [(1, "BANCO ALFA", 9), (1, "BANCO ALFA SA", 5), (2, "FUNDO SAUDE", 4), (2, "FUNDO SAUDE CENTRAL", 7), (3, "S", 1), (3, "S.A. (VIAÇÃO)", 1), (4, "CASA", 1), (5, "CASA VERDE", 9)]
    s = spark.createDataFrame(rows, "key int, name string, n int")
    assert {(r["key"], r["name"]) for r in entities.pruned_spellings(s, "key", "n").collect()} == {(1, "BANCO ALFA"), (1, "BANCO ALFA SA"), (2, "FUNDO SAUDE CENTRAL"), (3, "S.A. (VIAÇÃO)"), (4, "CASA"), (5, "CASA VERDE")}


def test_spellings_without_a_root_absorb_single_rows(spark):
    rows = [("UNIAO FEDERAL", "name", "UNIAO FEDERAL", "União Federal", 119), ("00000001", "root", "UNIAO FEDERAL", "UNIÃO FEDERAL", 1), ("00000002", "root", "UNIAO FEDERAL", "União Federal", 1), ("00000003", "root", "UNIAO FEDERAL", "União Federal LTDA", 1)]
    rows += [(f"1{i:07d}", "root", "FUNDO MUNICIPAL SAUDE", "Fundo Municipal de Saúde", 1) for i in range(20)]
    g = entities.groups_of(spark.createDataFrame(rows, "key string, key_kind string, name_key string, name string, n long"))
    assert {tuple(r) for r in entities.spelling_merges(g).collect()} == {(k, "root", "UNIAO FEDERAL", "name") for k in ("00000001", "00000002")}


def test_poles_and_their_slots(spark):
    tell = lambda *roles: [one(spark, merge.pole_of(F.lit(r))) for r in roles]
    assert tell("RÉ", "Réu", "réu/ré", "reunião", "Requerido(a)", "Exectdo", "Requerente", "Reclamante", "Recorrente", "Apte", "Perito", "") == ["passive", "passive", "passive", "other", "passive", "passive", "active", "active", "active", "active", "other", "other"]
    rows = [(1, 1, 7, "Réu", "other", None), (2, 1, 7, "Réu", "passive", None), (3, 1, 7, "Réu", "other", 9), (4, 2, 7, "Autor", "other", None), (5, 2, 7, "Autor", "other", None), (6, 3, 7, "Autor", "passive", None), (7, 3, 8, "Perito", "other", None), (8, 4, None, "Réu", "other", None)]
    d = spark.createDataFrame(rows, "id int, case int, party int, role string, pole string, represents int")
    assert {tuple(r) for r in merge.recomputed_poles(d, "id", ["case", "party"], "role", "pole", "represents").collect()} == {(3, "passive"), (4, "active"), (8, "passive")}


def test_case_features(spark):
    import datetime as dt
    import math

    at = lambda d: dt.datetime(2024, 1, d)
    cases = spark.createDataFrame([(1, "0000001-02.2020.8.02.0001", "156", "Cumprimento de Sentença"), (2, None, None, "Juizado Especial"), (3, "0000001-02.2020.8.02.0001", "7", None)], "case int, number string, class_code string, class_name string")
    moves = [(1, "Precatório", "PRECATÓRIO expedido", at(2)), (1, "", "Alvará de levantamento", at(3)), (1, "Enviada ao Tribunal", None, at(1)), (3, "x", "extinto\no feito sem resolução do mérito; rpvs", at(5)), (3, "x", "Nego provimento", at(6))]
    m = spark.createDataFrame(moves, "case int, kind string, text string, at timestamp_ntz")
    p = spark.createDataFrame([(1,), (1,), (2,)], "case int")
    f = {r.case: r for r in classify.case_features(cases, m, p, "case", F.lit("2024-01-13").cast("timestamp_ntz")).collect()}
    one_, two, three = f[1], f[2], f[3]
    assert (one_.f1, one_.f2, one_.f7, one_.f11, one_.f12, one_.f20, one_.f24, one_.f30, one_.f1xf11, one_.f1xf20) == (1, 1, 1, 1, 0, 1, 1, 0, 1, 1)
    assert math.isclose(one_.f15, math.log(4) / math.log(500)) and math.isclose(one_.f16, math.log(3) / math.log(50)) and math.isclose(one_.f23, math.log(3) / math.log(50))
    assert math.isclose(one_.f18, (2020 - 2019.66) / 6.49) and math.isclose(one_.f21, (10 - 532.24) / 574.57)
    assert (two.f10, two.f15, two.f18, two.f23, two.f24, two.f30) == (1, 0, 0, 0, 0, 0) and math.isclose(two.f21, (9999 - 532.24) / 574.57)
    assert (three.f12, three.f30, three.f1) == (0, 1, 0) and all(v is not None for r in f.values() for v in r)


def test_samples_for_validation(spark):
    d = spark.range(200).select(F.col("id").alias("case"), F.concat(F.lit("T"), (F.col("id") % 4).cast("string")).alias("court"), (F.col("id") / 200).alias("score")).withColumn("category", F.when(F.col("score") >= 0.7, "issued").otherwise("none"))
    seen, listed = d.where("case % 2 = 0"), d.where("case % 3 = 0")
    ids_ = lambda k, **kw: [r.case for r in classify.validation_sample(d, k, "case", kw.pop("limit", 8), 5, listed, seen, **kw).collect()]
    b = ids_("borderline", courts=4)
    assert len(b) == 4 and all(60 <= i < 100 and i % 2 for i in b) and b == ids_("borderline", courts=4)  # two courts have none left
    assert ids_("none_top", limit=3) == [139, 137, 135] and ids_("recovered", limit=3) == [195, 189, 183]
    assert ids_("missed", limit=3) == [135, 129, 123] and all(i >= 170 for i in ids_("issued_high"))
    with pytest.raises(ValueError, match="strategy"):
        ids_("other")


def test_cursors_of_rows_are_read_back(spark):
    d = spark.createDataFrame([(1, 2.5, "a?>"), (2, None, 'é"')], "id long, v double, s string")
    got = [relational.decode_cursor(r[0], "-v,id") for r in d.select(relational.cursor_of([F.col("v"), F.col("s"), F.col("id")], "-v,id")).collect()]
    assert got == [[2.5, "a?>", 1], [None, 'é"', 2]]


def test_places_medians_and_distances_in_groups(spark):
    import statistics

    rows = [(("a", "b", None)[i % 3] if i < 90 else "a", float(i * 37 % 50), i) for i in range(120)]
    d = spark.createDataFrame(rows, "k string, v double, id int")
    places = {r.id: (r.place, r.group_n) for r in relational.placed(d, ["k"], [F.col("v"), F.col("id")], stage).collect()}
    for k in ("a", "b", None):
        own = sorted((v, i) for g, v, i in rows if g == k)
        assert [places[i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]
    got = {r.k: r.median for r in agg.upper_medians(d, ["k"], "v", "id", stage).collect()}
    assert got == {k: statistics.median_high(v for g, v, _ in rows if g == k) for k in ("a", "b", None)}
    ks = {r.k: r.ks for r in agg.kolmogorov_smirnov(d.withColumn("s", F.col("id") % 2 == 0), "v", "s", ["k"], stage).collect()}
    for k in ks:
        x, y = ([v for g, v, i in rows if g == k and i % 2 == m] for m in (0, 1))
        assert ks[k] == round(max(abs(sum(a <= t for a in x) / len(x) - sum(a <= t for a in y) / len(y)) for t in {*x, *y}), 6)
    assert agg.upper_medians(d.where("false"), ["k"], "v", "id", stage).count() == 0


def test_a_summary_stays_in_step(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, at int")
    before = [("a", 1), ("a", 5), ("a", 9), ("b", 2), (None, 3), (None, 8), ("c", 4), ("d", None)]
    inserted, deleted = [("a", 7), ("e", 1), (None, 9), ("b", 1)], [("a", 9), ("c", 4), (None, 3), ("d", None)]
    after = [*before, *inserted]
    for r in deleted:
        after.remove(r)
    got = merge.kept_in_step(merge.summarised(frame(before), "k", "at"), frame(after), frame(inserted), frame(deleted), "k", "at").collect()
    want = merge.summarised(frame(after), "k", "at").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 4
    none = frame([])
    assert merge.kept_in_step(merge.summarised(none, "k", "at"), frame(inserted), frame(inserted), none, "k", "at").count() == 4


def test_keyset_batches(spark):
    d = spark.createDataFrame([(i * 3,) for i in range(25)], "id int")
    assert sorted(tuple(r) for r in relational.keyset_batches(d, "id", 10, stage).collect()) == [(0, 0, 27, 10), (1, 30, 57, 10), (2, 60, 72, 5)]
    assert relational.keyset_batches(d.where("false"), "id", 10, stage).count() == 0
