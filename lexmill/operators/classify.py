"""Classification of cases: signal features, scores, categories, stages, explanations, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import ids, numbers
from lexmill.functions.text import fold
from lexmill.operators.aggregates import kolmogorov_smirnov

# What each signal looks like in a movement's folded text.
SIGNALS = {
    "issued": r"(precatorio|rpv|oficio\s+requisitorio)\s+expedido|expedicao\s+de\s+(precatorio|rpv|requisicao\s+de\s+pagamento)|requisicao\s+de\s+pagamento\s+de\s+(pequeno\s+valor|precatorio)\s+(enviada|expedida)|determin(o|ada?)\s+(a\s+)?expedicao\s+de\s+(precatorio|rpv|oficio\s+requisitorio)|expeca(m)?-se\s+(o\s+)?(precatorio|oficio\s+requisitorio|a?\s*rpv)",
    "request": r"oficio\s+requisitorio|requisicao\s+de\s+pagamento",
    "enforcement": r"cumprimento\s+de\s+sentenca",
    "accounts": r"homolog\w+\s+(os?\s+|as?\s+)?(calculos?|contas?|valor(es)?)|calculos?\s+homologad|homologacao\s+d[eo]s?\s+calculos?",
    "final": r"transit(o|ad[oa]|ou)\s+em\s+julgado",
    "granted": r"julgo\s+(parcialmente\s+)?procedente|procedencia\s+(parcial\s+)?d[oa]s?\s+pedido|\bcondeno\b",
    "satisfied": r"extin[ct]\w*[^.;]{0,140}(pagamento|satisfacao|cumprimento\s+da\s+obrigacao|quitac)|(pagamento|satisfacao\s+da\s+obrigacao|quitacao)[^.;]{0,140}extin[ct]|satisfacao\s+da\s+obrigacao|obrigacao\s+satisfeita|art\.?\s*924\s*,?\s*(inciso\s+)?(ii|2)\b",
    "denied": r"julgo\s+improcedente|improceden(te|tes|cia)|indef(iro|erimento)\s+(d?a\s+)?(peticao\s+)?(inicial|exordial)|denego\s+seguimento|(decreto|reconheco|pronuncio)\s+a\s+prescri|prescricao[^.;]{0,60}(decretada|reconhecida|consumada|pronunciada)",
    "no_merits": r"sem\s+resolucao\s+d[eo]\s+merito|art\.?\s*485\b",
    "side_issue": r"extin[ct]\w*[^.;]{0,100}(embargos|incidente|impugnacao)|(embargos|incidente|impugnacao)[^.;]{0,100}extin[ct]",
    "closed": r"julgo\s+extint|extincao\s+d[ao]\s+(processo|execucao|cumprimento)",
    "small_claim": r"\brpv\b|requisicao\s+de\s+pequeno\s+valor",
    "payment": r"alvara\s+(judicial|de\s+levantamento)|mandado\s+de\s+levantamento|expecam?-se\s+(o\s+)?alvara|levantamento\s+d[eo]s?\s*(valores|quantia|deposito)",
    "part_payment": r"pagamento\s+parcial|parcial(mente)?\s+(pago|quitad)|levantamento\s+parcial",
}

# Fixed values: (pattern on folded text, type, subtype), in order; the first three different ones count.
MOVEMENT_TYPES = (
    (r"\bintimacao\b", 23, 1), (r"\bcitacao\s+positiva\b", 30, 1), (r"\bcitacao\b.*\bexpedida\b", 30, 3), (r"\bar\s+negativo\s+juntado\b", 31, 2),
    (r"\bsentenca\b.*\bprocedente\b", 17, 1), (r"\bsentenca\b.*\bimprocedente\b", 17, 2), (r"\bsentenca\b.*\bparcialmente\s+procedente\b", 17, 3),
    (r"\bacordao\b.*\bpublicado\b", 25, 1), (r"\bacordao\b", 25, 0), (r"\btransitado\s+em\s+julgado\b", 18, 1),
    (r"\baudiencia\b.*\bdesignada\b", 2, 1), (r"\baudiencia\b.*\bredesignada\b", 2, 2), (r"\baudiencia\b.*\bcancelada\b", 2, 4),
    (r"\bdespacho\b", 21, 0), (r"\bextincao\b", 6, 5), (r"\bliminar\b.*\bindeferida\b", 8, 1), (r"\btutela\b.*\bconcedida\b", 34, 1),
    (r"\brevelia\b", 28, 1), (r"\bdecurso\s+de\s+prazo\b", 41, 1), (r"\boficio\s+requisitori[oi]\b", 38, 1), (r"\balvara\b.*\bexpedido\b", 22, 1), (r"\balvara\b", 22, 2),
)

# categories' default thresholds, and courts whose signal features promote a case.
THRESHOLDS = {"high": 0.70, "middle": 0.40, "low": 0.20}
PROMOTING = {"TJAL": ("request_n", "issued_n"), "TJMA": ("request_n", "issued_n"), "TJSP": ("request_n", "issued_n"), "TJMG": ("issued_n",)}
PAYMENT_COURTS = ("TJMA", "TJSP")
PROMOTED_SCORE, DEMOTED_SCORE = 1.0, 0.10
ENFORCEMENT_CLASSES = ("12078", "156", "15160", "15215", "12079")
SCALES = {"movements": 500, "kinds": 50, "signals": 20}


def movement_types(kind: Column, text: Column) -> Column:
    """Up to three (type, subtype) of a movement."""
    t = fold(F.concat_ws(" ", kind, text))
    hits = F.array(*[F.when(t.rlike("(?s)" + p), F.struct(F.lit(a).alias("type"), F.lit(b).alias("subtype"))) for p, a, b in MOVEMENT_TYPES])
    return F.slice(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())), 1, 3)


def case_signals(movements: DataFrame, case: str, day: str, text: str) -> DataFrame:
    """Per case: movements, kinds-free counts and last dates of every signal, in one aggregation."""
    t = fold(F.coalesce(F.col(text), F.lit("")))
    flags = movements.select(case, day, *[t.rlike(p).alias(k) for k, p in SIGNALS.items()])
    # closing of a side issue says nothing of the case itself, unless the case was satisfied
    side = F.col("side_issue") & ~F.col("satisfied")
    for k in ("denied", "no_merits", "closed"):
        flags = flags.withColumn(k, F.col(k) & ~side)
    aggs = [F.count("*").alias("movements"), F.max(day).alias("last_day")]
    for k in SIGNALS:
        aggs += [F.count_if(k).alias(f"{k}_n"), F.max(F.when(F.col(k), F.col(day))).alias(f"{k}_last")]
    return flags.groupBy(case).agg(*aggs)


def stage(s: DataFrame, case_class: Column | None = None) -> DataFrame:
    """Adds stage, seal, confidence and badges to a frame of case_signals."""
    has = lambda k: F.col(f"{k}_n") > 0
    enforcement = has("enforcement") | (F.coalesce(case_class.isin(*ENFORCEMENT_CLASSES), F.lit(False)) if case_class is not None else F.lit(False))
    before = enforcement | has("accounts")
    lost = has("denied") & (~has("issued") | (F.col("denied_last") >= F.col("issued_last")))
    pre = F.when(enforcement & has("accounts"), 0.75).otherwise(0.60)
    ladder = [
        (has("satisfied"), "closed", "satisfied", F.when(has("payment"), 0.90).otherwise(0.85)),
        (lost, "closed", "denied", F.lit(0.80)),
        (has("issued"), "issued", "issued", F.lit(0.85)),
        (has("request") & before, "issued", "issued", F.lit(0.70)),
        (before, "pre", "pre", F.when(has("final"), F.least(F.lit(0.80), pre + 0.05)).otherwise(pre)),
        (has("final") | has("granted"), "right", "right", F.when(has("final"), 0.65).otherwise(0.55)),
    ]
    pick = lambda i, rest: reduce(lambda acc, r: F.when(r[0], F.lit(r[i]) if isinstance(r[i], str) else r[i]).otherwise(acc), reversed(ladder), rest)
    out = s.withColumn("stage", pick(1, F.lit("undefined"))).withColumn("seal", pick(2, F.lit("undefined"))).withColumn("confidence", F.round(pick(3, F.lit(0.30)), 2))
    open_ = F.col("stage") != "closed"
    badges = [F.when(has("denied") & open_, "denial overtaken"), F.when(has("no_merits"), "no merits"), F.when(has("closed") & ~has("satisfied") & ~has("denied") & ~has("no_merits") & open_, "closing unclear"), F.when(has("side_issue") & ~has("satisfied"), "side issue"), F.when(has("small_claim"), "small claim"), F.when(has("payment"), "payment"), F.when(has("part_payment"), "part payment")]
    return out.withColumn("badges", F.concat_ws(",", *badges))


def features(s: DataFrame) -> DataFrame:
    """Adds the scaled counts that scores use."""
    total = F.col("issued_n") + F.col("request_n") + F.col("small_claim_n")
    return s.withColumn("f_movements", numbers.log_ratio(F.col("movements"), SCALES["movements"])).withColumn("f_signals", numbers.log_ratio(total, SCALES["signals"])).withColumn("f_paid_after", (F.col("payment_last").isNotNull() & (F.col("issued_last").isNull() | (F.col("payment_last") >= F.col("issued_last")))).cast("int")).withColumn("f_lost", (F.col("denied_last").isNotNull() & (F.col("issued_last").isNull() | (F.col("denied_last") > F.col("issued_last")))).cast("int"))


# What the features of a case seek in a movement's folded text, movement kinds that count, words of classes
# that speak against a case, and the means, deviations and bases by which features are scaled.
FEATURE_TEXTS = {
    "precat": r"precatorio",
    "rpv": r"\brpv\b",
    "request_payment": r"requisicao de pagamento",
    "office": r"oficio requisitorio",
    "cancelled": r"cancelamento de precatorio|cancelamento de rpv|revogacao de precatorio|revogacao de rpv",
    "sent": r"precatorio expedido|rpv expedida|oficio requisitorio expedido|requisicao de pagamento de pequeno valor enviada|requisicao de pagamento de precatorio enviada|determinada expedicao de precatorio|determinada expedicao de rpv|expedicao de requisicao de pagamento",
    "paid": r"alvara\s+(judicial|de\s+levantamento)|expecam?-se\s+(o\s+)?alvara|autorizo[^.]{0,150}sequestro|defiro[^.]{0,100}sequestro|sequestro\s+do\s+numerario|julgo\s+extint[oa]|mandado\s+de\s+levantamento",
    "ended": r"extin\w+.{0,40}sem\s+resolucao\s+do\s+merito|improceden|indefer\w+\s+a\s+(peticao|inicial|exordial)|denego\s+seguimento|nego\s+provimento|(decreto|reconheco|pronuncio)\s+a\s+prescri",
}
PRECAT_KINDS = ("Expedição de precatório/rpv", "Precatório")
SENT_KINDS = ("Enviada ao Tribunal", "Preparada para Envio")
ANTI_CLASSES = ("juizado especial", "recurso inominado", "procedimento comum")
YEAR_MEAN, YEAR_SD = 2019.66, 6.49
AGE_MEAN, AGE_SD = 532.24, 574.57
NEVER_DAYS = 9999
MOVEMENT_BASE, KIND_BASE, SIGNAL_BASE, PARTY_BASE = 500, 50, 20, 50


def case_features(cases: DataFrame, movements: DataFrame, parties: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The feature vector of every case: 19 features of the score and two signals for rules (``f24``, ``f30``).

    cases: key, number, class_code, class_name; movements: key, kind, text, at
    (a timestamp); parties: key, one row a party. One aggregation a table; a
    case without movements has zeros, the features of its class and year, and
    an age of ``NEVER_DAYS``. No features are null.
    """
    t = fold(F.coalesce(F.col("text"), F.lit("")))
    flags = movements.select(key, "kind", "at", *[t.rlike("(?s)" + p).alias(k) for k, p in FEATURE_TEXTS.items()])
    last = lambda k: F.max(F.when(F.col(k), F.col("at"))).alias(f"{k}_at")
    moves = flags.groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct(F.when(F.col("kind") != "", F.col("kind"))).alias("kinds"), F.max("at").alias("at"),
        F.count_if(F.col("kind").isin(*PRECAT_KINDS)).alias("precat_kind"), F.count_if(F.col("kind").isin(*SENT_KINDS)).alias("sent_kind"),
        *[F.count_if(k).alias(k) for k in FEATURE_TEXTS], *[last(k) for k in ("sent", "paid", "ended")],
    )
    d = cases.join(moves, key, "left").join(parties.groupBy(key).agg(F.count("*").alias("parties")), key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    some = lambda c: (n(F.col(c)) > 0).cast("int")
    name = F.lower(F.coalesce("class_name", F.lit("")))
    enforcement = F.coalesce(F.col("class_code").isin(*ENFORCEMENT_CLASSES), F.lit(False)).cast("int")
    anti = (name.contains(ANTI_CLASSES[0]) | name.contains(ANTI_CLASSES[1]) | name.contains(ANTI_CLASSES[2])).cast("int")
    year = ids.case_year(F.col("number"))
    age = F.coalesce(F.timestamp_diff("SECOND", F.col("at"), as_of) / 86400, F.lit(float(NEVER_DAYS)))
    after = lambda c: F.coalesce(F.col(c).isNotNull() & (F.col("sent_at").isNull() | (F.col(c) >= F.col("sent_at"))), F.lit(False)).cast("int")
    movements_log = numbers.log_ratio(n(F.col("n")), MOVEMENT_BASE)
    return d.select(
        key, enforcement.alias("f1"), anti.alias("f10"), some("precat_kind").alias("f2"), some("sent_kind").alias("f7"),
        some("precat").alias("f11"), some("rpv").alias("f12"), some("request_payment").alias("f13"), some("office").alias("f14"),
        movements_log.alias("f15"), numbers.log_ratio(n(F.col("kinds")), KIND_BASE).alias("f16"),
        numbers.log_ratio(n(F.col("precat")) + n(F.col("rpv")) + n(F.col("request_payment")) + n(F.col("office")), SIGNAL_BASE).alias("f17"),
        F.when(year > 0, numbers.z_score(year, YEAR_MEAN, YEAR_SD)).otherwise(0.0).alias("f18"), some("cancelled").alias("f19"), some("sent").alias("f20"),
        numbers.z_score(age, AGE_MEAN, AGE_SD).alias("f21"), F.when(F.col("n").isNotNull(), numbers.log_ratio(n(F.col("parties")), PARTY_BASE)).otherwise(0.0).alias("f23"),
        (enforcement * some("precat")).alias("f1xf11"), (enforcement * movements_log).alias("f1xf15"), (enforcement * some("sent")).alias("f1xf20"),
        after("paid_at").alias("f24"), after("ended_at").alias("f30"),
    )


def linear_score(columns: dict[str, Column], weights: dict[str, float], bias: float = 0.0) -> Column:
    """Sigmoid of the weighted sum; a feature without a weight counts nothing."""
    z = F.lit(float(bias))
    for k, c in columns.items():
        if weights.get(k):
            z = z + c.cast("double") * float(weights[k])
    return numbers.sigmoid(z)


def category(score: Column, enforcement: Column, signal: Column, high: Column, middle: Column, low: Column) -> Column:
    """The category ladder: high needs a signal, the others an enforcement case."""
    return F.when((score >= high) & signal, "issued").when((score >= middle) & enforcement, "pre").when((score >= low) & enforcement, "right").otherwise("none")


def overrides(court: Column, cat: Column, score: Column, promoted: Column, paid_after: Column, lost: Column) -> Column:
    """(category, score) after the signal rules: promotion first, then demotion by payment and by a lost case."""
    pays = court.isin(*PAYMENT_COURTS) & paid_after
    row = lambda c, s: F.struct(c.alias("category"), s.alias("score"))
    low = F.least(score, F.lit(DEMOTED_SCORE))
    return F.when(promoted & ~pays, row(F.lit("issued"), F.lit(PROMOTED_SCORE))).when(pays & cat.isin("issued", "pre"), row(F.lit("none"), low)).when(lost & (cat != "none"), row(F.lit("none"), low)).otherwise(row(cat, score))


def promotes(court: Column, enforcement: Column) -> Column:
    out = F.lit(False)
    for c, cols in PROMOTING.items():
        any_ = F.lit(False)
        for k in cols:
            any_ = any_ | (F.col(k) > 0)
        out = out | ((court == c) & any_)
    return out & enforcement


def contributions(features_: dict[str, Column], weights: dict[str, float], top: int = 5) -> Column:
    """The features that moved a score most: [(name, value times weight)], those under 0.001 left out."""
    parts = F.array(*[F.struct((c.cast("double") * float(weights.get(k, 0.0))).alias("c"), F.lit(k).alias("name")) for k, c in features_.items()])
    some = F.filter(parts, lambda p: F.abs(p["c"]) > 0.001)
    ordered = F.array_sort(F.transform(some, lambda p: F.struct((-F.abs(p["c"])).alias("o"), p["name"].alias("name"), p["c"].alias("c"))))
    return F.transform(F.slice(ordered, 1, top), lambda p: F.concat_ws("=", p["name"], F.format_string("%.3f", p["c"])))


# How much a label's origin weighs, heaviest first.
ORIGINS = (("human", 3), ("outcome", 2), ("export", 1))


def consolidate_labels(observations: DataFrame, key: str, origin: str, label: str) -> DataFrame:
    """One label per key, of the heaviest origin; ties go to the origin's order, then the larger label; conflict if origins differ."""
    w = F.create_map(*[F.lit(x) for o, n in ORIGINS for x in (o, n)])
    place = F.create_map(*[F.lit(x) for i, (o, _) in enumerate(ORIGINS) for x in (o, -i)])
    o = observations.withColumn("w", F.coalesce(F.try_element_at(w, F.col(origin)), F.lit(0)))
    return o.groupBy(key).agg(F.max_by(F.struct(F.col(label).alias("label"), F.col(origin).alias("origin"), F.col("w").alias("weight")), F.struct("w", F.try_element_at(place, F.col(origin)), label)).alias("m"), (F.countDistinct(label) > 1).alias("conflict")).select(key, "m.*", "conflict")


def capped_class(df: DataFrame, label: str, id_col: str, cap: int, salt: str = "") -> DataFrame:
    """Each class thinned to about ``cap`` rows by hash fraction; the same rows every time."""
    n = F.count("*").over(Window.partitionBy(label))
    return df.withColumn("__n", n).where(ids.hash_fraction(F.col(id_col), salt) < F.lit(float(cap)) / F.col("__n")).drop("__n")


def gates(metrics: DataFrame, specs: list[tuple[str, float, float]]) -> DataFrame:
    """PASS, WARN, BLOCK or NO_DATA per metric: specs are (metric, pass from, warn from)."""
    s = metrics.sparkSession.createDataFrame(specs, "metric string, pass_from double, warn_from double")
    v = F.col("value")
    return F.broadcast(s).join(metrics, "metric", "left").select("metric", "value", F.when(v.isNull(), "NO_DATA").when(v >= F.col("pass_from"), "PASS").when(v >= F.col("warn_from"), "WARN").otherwise("BLOCK").alias("gate"))


# Signals that the score has no feature for, on folded text, and what each strategy of mining asks and adds.
NOVEL = (
    r"\brpv\s+expedid", r"pagamento\s+administrativo", r"oficio\s+requisitorio\s+expedido", r"precatorio\s+(?:expedido|encaminhado|inscrito)",
    r"inscricao\s+(?:na\s+)?ordem\s+cronologica", r"transitad[oa]\s+em\s+julgado", r"liquid[oa]\s+(?:e\s+)?cert[oa]",
)
BAND_FROM, BAND_TO, BAND_ADDS = 0.10, 0.20, 0.20
NOVEL_ADDS, NOVEL_FULL = 0.30, 3
FEW_MOVEMENTS, FEW_ADDS = 5, 0.15
LIKE_FROM, LIKE_ADDS = 0.60, 0.20
DENSE_FROM, DENSE_ADDS = 0.70, 0.10
NEAR_FROM, NEAR_ADDS = 0.70, 0.05
VECTOR = ("f1", "f10", "f2", "f7", "f11", "f12", "f13", "f14", "f15", "f16", "f17", "f18", "f19", "f20", "f21", "f23", "f1xf11", "f1xf15", "f1xf20")


def novel_signals(movements: DataFrame, key: str, text: str) -> DataFrame:
    """(key, movements, novel): movements of a case and how many of the novel signals any of them shows."""
    t = fold(F.coalesce(F.col(text), F.lit("")))
    flags = movements.select(key, *[t.rlike(p).cast("int").alias(f"s{i}") for i, p in enumerate(NOVEL)])
    novel = reduce(lambda x, y: x + y, [F.max(f"s{i}") for i in range(len(NOVEL))])
    return flags.groupBy(key).agg(F.count("*").alias("movements"), novel.alias("novel"))


def nearness(features: DataFrame, leads: DataFrame, key: str) -> DataFrame:
    """(key, near): cosine of each feature vector with the mean vector of the leads; null if that is nothing."""
    mean = leads.agg(*[F.avg(c).alias(f"m_{c}") for c in VECTOR])
    add = lambda parts: reduce(lambda x, y: x + y, parts)
    dot = add([F.col(c) * F.col(f"m_{c}") for c in VECTOR])
    size = lambda name: F.sqrt(add([F.pow(F.col(name(c)), F.lit(2)) for c in VECTOR]))
    return features.crossJoin(F.broadcast(mean)).select(key, F.try_divide(dot, size(lambda c: c) * size(lambda c: f"m_{c}")).alias("near"))  # one row


def cluster_density(clustered_leads: DataFrame, k: int) -> DataFrame:
    """(cluster, dense): the cluster's share of the leads, in units of an even share, at most 1."""
    n = clustered_leads.groupBy("cluster").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # k rows
    return n.select("cluster", F.least(F.lit(1.0), F.col("n") / total * k).alias("dense"))


def mined(cases: DataFrame, key: str, home: str) -> DataFrame:
    """Cases of category none that some strategy suspects: key, suspicion (at most 1), reasons (E1 to E6).

    cases: key, court, score, movements, novel, f1, and like, dense and near,
    which are null where no model was learnt. ``home`` is the court that the
    leads are from; only other courts' cases are held against their mean.
    Cases without movements are left out.
    """
    holds = lambda c: F.coalesce(c, F.lit(False))
    rules = (
        ("E1", holds(F.col("score").between(BAND_FROM, BAND_TO)), F.lit(BAND_ADDS)),
        ("E2", holds(F.col("novel") > 0), NOVEL_ADDS * F.least(F.col("novel") / NOVEL_FULL, F.lit(1.0))),
        ("E3", holds((F.col("f1") == 1) & (F.col("movements") <= FEW_MOVEMENTS)), F.lit(FEW_ADDS)),
        ("E4", holds(F.col("like") > LIKE_FROM), F.lit(LIKE_ADDS)),
        ("E5", holds(F.col("dense") > DENSE_FROM), F.lit(DENSE_ADDS)),
        ("E6", holds((F.col("near") > NEAR_FROM) & (F.col("court") != home)), F.lit(NEAR_ADDS)),
    )
    total = reduce(lambda x, y: x + y, [F.when(c, add).otherwise(0.0) for _, c, add in rules])
    why = F.concat_ws("|", *[F.when(c, F.lit(k)) for k, c, _ in rules])
    d = cases.where("movements > 0").select(key, F.least(F.lit(1.0), total).alias("suspicion"), why.alias("reasons"))
    return d.where("reasons <> ''")


def guarded_class(probabilities: dict[str, Column], guarded: str, least: float) -> Column:
    """(class, confidence) of the likeliest class; ``guarded`` only from ``least`` on, below it the best of the others."""
    parts = [F.struct(p.alias("p"), F.lit(-i).alias("o"), F.lit(k).alias("name")) for i, (k, p) in enumerate(probabilities.items())]
    best, rest = F.greatest(*parts), F.greatest(*[x for x, k in zip(parts, probabilities) if k != guarded])
    pick = F.when((best["name"] == guarded) & (best["p"] < least), rest).otherwise(best)
    return F.struct(pick["name"].alias("class"), F.round(pick["p"], 4).alias("confidence"))


def stage_label(issued: Column, pre: Column, right: Column, satisfied: Column, extinct: Column, paid: Column, dismissed: Column) -> Column:
    """A case's label from its files: issued over pre over right, none without; closing overrides last."""
    base = F.when(issued, "issued").when(pre, "pre").when(right, "right")
    return F.when(base.isNull(), base).when(satisfied | (extinct & paid & issued) | (dismissed & ~issued), "closed").otherwise(base)


def latest_shadow(cases: DataFrame, logs: DataFrame, key: str, at: str) -> DataFrame:
    """Cases (key, court, category, score) beside the newest of their logs (key, ``at``, shadow_category, shadow_score)."""
    newest = logs.groupBy(key).agg(F.max_by(F.struct("shadow_category", "shadow_score"), F.struct(at, "shadow_score", "shadow_category")).alias("s"))
    return cases.join(newest.select(key, "s.*"), key)


def court_agreement(shadow: DataFrame, checkpoint) -> DataFrame:
    """Per court, and over all as court null: pairs, disagreements, agreement and the distance of both scores' distributions."""
    both = shadow.withColumn("court", F.explode(F.array("court", F.lit(None).cast("string"))))
    same = F.coalesce("category", F.lit("")) == F.coalesce("shadow_category", F.lit(""))
    per = both.groupBy("court").agg(F.count("*").alias("total"), F.count_if(~same).alias("disagreements"))
    sides = F.explode(F.array(F.struct(F.col("score").alias("value"), F.lit(True).alias("current")), F.struct(F.col("shadow_score").alias("value"), F.lit(False).alias("current")))).alias("v")
    ks = kolmogorov_smirnov(both.select("court", sides).select("court", "v.*").where("value IS NOT NULL"), "value", "current", ["court"], checkpoint)
    on = per["court"].eqNullSafe(ks["court"])
    return per.join(ks, on, "left").select(per["court"], "total", "disagreements", F.round(1 - F.col("disagreements") / F.col("total"), 6).alias("agreement"), "ks")


def widest_disagreements(shadow: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The cases of different categories whose scores lie furthest apart."""
    differ = F.coalesce("category", F.lit("")) != F.coalesce("shadow_category", F.lit(""))
    d = shadow.where(differ & F.col("score").isNotNull()).withColumn("delta", F.col("shadow_score") - F.col("score"))
    return d.orderBy(F.desc(F.abs("delta")), key).limit(most)


def _by_hash(key: str, seed: int, *more: Column) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)), *more))


def quota_sample(df: DataFrame, key: str, stratum: str, strata: int, limit: int, seed: int) -> DataFrame:
    """An equal share of ``limit`` from each of ``strata`` strata (at least one row), by hash of id, seed and stratum."""
    h = _by_hash(key, seed, F.col(stratum).cast("string"))
    d = df.withColumn("__h", h).withColumn("__p", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key)))
    return d.where(F.col("__p") <= max(1, limit // max(1, strata))).orderBy(stratum, "__h", key).limit(limit).drop("__h", "__p")


def validation_sample(cases: DataFrame, strategy: str, key: str, limit: int, seed: int, listed: DataFrame | None = None, seen: DataFrame | None = None, courts: int = 1, band: tuple[float, float] = (0.30, 0.50)) -> DataFrame:
    """Cases (key, court, category, score) to be looked at by a person; none of ``seen`` comes again.

    borderline: scores in the band, shared among courts; issued_high: issued
    with a score of 0.85 or more, by hash; none_top: the highest scores of none
    from 0.05; by_category: shared among the four categories; missed: listed
    cases of none from 0.30; recovered, consumed: all listed, highest first.
    """
    d = cases.join(seen.select(key), key, "left_anti") if seen is not None else cases
    first = lambda x: x.orderBy(F.desc_nulls_first("score"), F.desc(key)).limit(limit)
    if strategy == "borderline":
        return quota_sample(d.where((F.col("score") >= band[0]) & (F.col("score") < band[1])), key, "court", courts, limit, seed)
    if strategy == "issued_high":
        return d.where((F.col("category") == "issued") & (F.col("score") >= 0.85)).orderBy(_by_hash(key, seed), key).limit(limit)
    if strategy == "none_top":
        return first(d.where((F.col("category") == "none") & (F.col("score") >= 0.05)))
    if strategy == "by_category":
        return quota_sample(d.where(F.col("category").isNotNull()), key, "category", 4, limit, seed)
    if strategy not in ("missed", "recovered", "consumed") or listed is None:
        raise ValueError(f"no strategy {strategy}, or it needs a list")
    d = d.join(listed.select(key).distinct(), key, "left_semi")
    return first(d.where((F.col("category") == "none") & (F.col("score") >= 0.30)) if strategy == "missed" else d)
