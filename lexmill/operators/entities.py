"""Entity resolution: which parties are in scope, and which records are one entity.

Every merge rule is a table of (absorbed, leader) decisions, so merges can be
audited; only group keys and counts move between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import ids, text

# Fixed values, on name keys: territories stand in the names of bodies that are not theirs and own no facet; associations
# name whose members they gather and are nobody's facet. Acronyms have at least three letters.
TERRITORY = r"^(ESTADOS?|MUNICIPIOS?|PREFEITURA|DISTRITO FEDERAL|UNIAO|GOVERNO|FAZENDA)\b"
ASSOCIATION = r"\b(SINDICATO|ASSOCIACAO|COOPERATIVA|FEDERACAO|CONFEDERACAO|FUNDACAO)\b"
ACRONYM_MIN = 3

# A leader needs this share of a group's rows, this many times the second's, and absorbs up to this many rows.
DOMINANCE_SHARE, DOMINANCE_FACTOR, TYPO_ROWS = 0.9, 10, 1


def scope(name: Column, doc: Column, doc_kind: Column, kind: Column, bar: Column) -> Column:
    """(inside, reason) of a party, by the first rule that holds."""
    key = text.normal_name(name)
    out = lambda inside, why: F.struct(F.lit(inside).alias("inside"), F.lit(why).alias("reason"))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return (
        F.when(~filled(name), out(False, "no name"))
        .when(F.coalesce(kind == "lawyer", F.lit(False)) | filled(bar), out(False, "lawyer"))
        .when(ids.is_cpf(doc, doc_kind), out(False, "person"))
        .when(key.isin(*text.PLACEHOLDERS), out(False, "placeholder"))
        .when(ids.cnpj_root(doc).isNotNull(), out(True, "company number"))
        .when(F.coalesce(kind == "company", F.lit(False)), out(True, "company"))
        .when(text.is_public_body(name), out(True, "public body"))
        .otherwise(out(False, "other"))
    )


def party_kind(doc: Column, bar: Column) -> Column:
    """company, person, lawyer or unknown, from the numbers alone."""
    d = ids.digits(doc)
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(filled(bar), "lawyer").when(F.length(d) == 14, "company").when(F.length(d) == 11, "person").otherwise("unknown")


def spellings(parties: DataFrame, name: str, doc: str) -> DataFrame:
    """key, key_kind, name_key, name, n: how often each spelling stands under a company root, or a normal name without one."""
    # names are normalised once each, not once a row
    d = parties.groupBy(F.col(name).alias("name"), F.col(doc).alias("doc")).agg(F.count("*").alias("n"))
    d = d.select("name", "n", ids.cnpj_root(F.col("doc")).alias("root"), text.normal_name(F.col("name")).alias("name_key"))
    d = d.withColumn("key_kind", F.when(F.col("root").isNotNull(), "root").otherwise("name")).withColumn("key", F.coalesce("root", "name_key"))
    return d.groupBy("key", "key_kind", "name_key", "name").agg(F.sum("n").alias("n"))


def groups_of(spelled: DataFrame) -> DataFrame:
    """key, key_kind, name_key, label, rows, spellings of a table of spellings."""
    order = F.struct("n", F.col("name") != F.upper("name"), F.length("name"), "name")
    return spelled.groupBy("key", "key_kind").agg(F.max_by("name_key", order).alias("name_key"), F.max_by("name", order).alias("label"), F.sum("n").alias("rows"), F.count("*").alias("spellings"))


def group_parties(parties: DataFrame, name: str, doc: str) -> DataFrame:
    """key, key_kind, name_key, label, rows, spellings per company root, or per normal name without one."""
    return groups_of(spellings(parties, name, doc))


def dominant(groups: DataFrame, by: str) -> DataFrame:
    """Adds ``leads`` and ``dominated``: whether the group of ``by`` has a leader that dominates it."""
    w = Window.partitionBy(by)
    o = w.orderBy(F.desc("rows"), "key")
    d = groups.withColumn("place", F.row_number().over(o)).withColumn("total", F.sum("rows").over(w)).withColumn("members", F.count("*").over(w))
    top = F.max(F.when(F.col("place") == 1, F.col("rows"))).over(w)
    second = F.max(F.when(F.col("place") == 2, F.col("rows"))).over(w)
    dominated = (F.col("members") > 1) & (top >= DOMINANCE_SHARE * F.col("total")) & (top >= DOMINANCE_FACTOR * second)
    return d.withColumn("dominated", F.coalesce(dominated, F.lit(False))).withColumn("leads", F.col("place") == 1)


def _spelled_alike(groups: DataFrame) -> DataFrame:
    """Decisions on groups of few rows, spelled as a group that dominates their name."""
    d = dominant(groups, "name_key").where("dominated").withColumn("spelled", F.array_join(text.identity_tokens(F.col("label")), " "))
    lead = d.where("leads").select("name_key", F.col("key").alias("leader"), F.col("key_kind").alias("leader_kind"), F.col("spelled").alias("lead_spelled"))
    rest = d.where((~F.col("leads")) & (F.col("rows") <= TYPO_ROWS))
    return rest.join(lead, "name_key").where("spelled = lead_spelled").select(F.col("key").alias("absorbed"), F.col("key_kind").alias("absorbed_kind"), "leader", "leader_kind")


def typo_merges(groups: DataFrame) -> DataFrame:
    """Decisions: root groups of one row, spelled as a root group that dominates their name."""
    return _spelled_alike(groups.where("key_kind = 'root' AND name_key <> ''"))


def name_merges(groups: DataFrame) -> DataFrame:
    """Decisions: name groups whose name belongs to one root group, or to one that dominates."""
    d = dominant(groups.where("key_kind = 'root' AND name_key <> ''"), "name_key").where((F.col("members") == 1) | (F.col("dominated") & F.col("leads")))
    named = groups.where("key_kind = 'name'").join(d.select("name_key", F.col("key").alias("leader")), "name_key")
    return named.select(F.col("key").alias("absorbed"), F.lit("name").alias("absorbed_kind"), "leader", F.lit("root").alias("leader_kind"))


def spelling_merges(groups: DataFrame) -> DataFrame:
    """Decisions as those on typing errors, among names of which some group has no root."""
    some = F.max(F.col("key_kind") == "name").over(Window.partitionBy("name_key"))
    return _spelled_alike(groups.where("name_key <> ''").withColumn("some", some).where("some").drop("some"))


def merged(spelled: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spellings under the keys that decisions give them."""
    d = decisions.select(F.col("absorbed").alias("key"), F.col("absorbed_kind").alias("key_kind"), "leader", "leader_kind")
    key, kind = F.coalesce("leader", "key").alias("key"), F.coalesce("leader_kind", "key_kind").alias("key_kind")
    return spelled.join(d, ["key", "key_kind"], "left").groupBy(key, kind, "name_key", "name").agg(F.sum("n").alias("n"))


def consolidated(spelled: DataFrame, checkpoint) -> DataFrame:
    """Spellings after the passes on typing errors, names and spellings, in this order; ``checkpoint`` stages a table.

    Each pass decides on what the one before left: without the typing errors
    a name points to one root, and only names that then still point to none
    are left to the pass on spellings.
    """
    for decide in (typo_merges, name_merges, spelling_merges):
        spelled = checkpoint(merged(spelled, decide(groups_of(spelled))))
    return spelled


def search_variants(spellings: DataFrame, key: str, n: str, always: int = 3, least: int = 2, share: float = 0.01) -> DataFrame:
    """The spellings worth searching: the first few always, others with enough rows."""
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(F.desc(n), "name"))
    return spellings.withColumn("place", place).withColumn("total", F.sum(n).over(w)).where((F.col("place") <= always) | ((F.col(n) >= least) & (F.col(n) >= share * F.col("total")))).drop("place", "total")


def pruned_spellings(spellings: DataFrame, key: str, n: str) -> DataFrame:
    """Spellings of an entity without those that stand inside a longer one that is at least as frequent.

    Every run of words of a spelling meets the shorter spelling that it is;
    spellings are never paired with each other.
    """
    s = spellings.select(key, "name", n, F.array_join(text.identity_tokens(F.col("name")), " ").alias("span"))
    inside = s.select(key, F.col(n).alias("long_n"), F.explode(_inner_spans(F.col("span"))).alias("span")).groupBy(key, "span").agg(F.max("long_n").alias("long_n"))
    left = s.join(inside, [key, "span"], "left").where((F.col("long_n").isNull()) | (F.col(n) > F.col("long_n")))
    return left.select(key, "name", n)


def _all_spans(name: Column, most: int | None = None) -> Column:
    """Every run of words of a name, without repeats."""
    toks = F.split(name, " ")
    at = F.transform(F.sequence(F.lit(1), F.size(toks)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most if most else 2**31 - 1), F.size(toks) - i + 1)), lambda k: F.array_join(F.slice(toks, i, k), " ")))
    return F.array_distinct(F.flatten(at))


def _inner_spans(name: Column) -> Column:
    """Every run of words of a name but the whole."""
    return F.array_remove(_all_spans(name), name)


def spans(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """(name, span) for every run of words of the name, of up to ``most`` words if set."""
    df = df.select(F.col(name).alias("__n"))
    return df.select(F.col("__n").alias("name"), F.explode(_all_spans(F.col("__n"), most)).alias("span"))


def phrase_join(docs: DataFrame, id_col: str, toks: str, names: DataFrame, name: str, max_broadcast: int = 100_000, max_inline: int = 10_000) -> DataFrame:
    """(id, name) for every name that stands in a text as a phrase.

    Names meet texts at their first two words (or their only one), then the
    whole phrase is checked: no pair of text and name is tried without that.
    Up to ``max_inline`` such beginnings travel with the tasks and are sought
    inside each row, which then checks its phrases itself.
    """
    words = F.split(F.col(name), " ")
    lead = names.select(F.col(name), F.array_join(F.slice(words, 1, 2), " ").alias("lead"))
    few = lead.count() <= max_broadcast
    grams = F.concat(F.col(toks), F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col(toks), i, 2), " ")))
    known = [r["lead"] for r in lead.select("lead").distinct().limit(max_inline + 1).collect()]
    if few and len(known) <= max_inline:
        inside = F.array_distinct(F.filter(grams, lambda g: g.isin(*known)))
        # no filter before explode: it would be pushed to where the tokens are made, and make them anew for every pair
        met = docs.select(id_col, toks, F.explode(inside).alias("lead")).join(F.broadcast(lead), "lead")
        return met.where(text.has_phrase(F.col(toks), F.col(name))).select(id_col, name).distinct()
    starts = docs.select(id_col, F.explode(F.array_distinct(grams)).alias("lead"))
    hits = starts.join(F.broadcast(lead) if few else lead, "lead").select(id_col, name)
    return hits.join(docs, id_col).where(text.has_phrase(F.col(toks), F.col(name))).select(id_col, name).distinct()


def resolve_roots(pointers: DataFrame, node: str, to: str, checkpoint) -> DataFrame:
    """(node, root): pointers followed to their end by doubling; a node on a cycle, or before one, is its own root.

    ``checkpoint`` stages a table and gives it back, which cuts the lineage.
    After as many rounds as the number of nodes has bits only cycles still move.
    """
    p = checkpoint(pointers.select(F.col(node).alias("node"), F.col(to).alias("root")).where("node <> root").dropDuplicates(["node"]))
    for _ in range(p.count().bit_length() + 1):
        nxt = p.select(F.col("node").alias("root"), F.col("root").alias("next"))
        q = checkpoint(p.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        moved = q.join(p.withColumnRenamed("root", "was"), "node").where("root <> was AND node <> root").limit(1).count()
        p = q
        if not moved:
            break
    ends = p.join(p.select(F.col("node").alias("root")), "root", "left_anti")
    return p.select("node").join(ends, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def facet_plan(spelled: DataFrame, checkpoint, factor: int = 10) -> DataFrame:
    """(facet, facet_kind, owner, outcome): which entities are a part, or the acronym, of another one.

    An owner has a root and is no territory. A facet has none, is no
    association, its label holds the owner's whole label and each of its
    pruned spellings holds one of the owner's. An entity whose label is one
    word is a facet of the only owner that has this acronym, if a spelling of
    the owner's shows it. Owners that are themselves acronyms stand for their
    own owner, so two steps reach the end and no cycle can form. Outcome:
    ``merged``; ``ambiguous``, with several owners; ``not dominant``, if the
    owner has fewer than ``factor`` times the facet's rows. Owner is null
    unless merged. Labels that look broken take no part.
    """
    both = ["key", "key_kind"]
    label = F.array_join(text.identity_tokens(F.col("label")), " ")
    g = checkpoint(groups_of(spelled).select(*both, "name_key", "rows", label.alias("label")).where("label <> ''").where(text.suspicious_name(F.col("label"), F.col("rows")).isNull()))
    owns = g.where("key_kind = 'root'").where(~F.col("name_key").rlike(TERRITORY))
    parts = g.where("key_kind = 'name'").where(~F.col("name_key").rlike(ASSOCIATION))
    words = spelled.select(*both, "name_key", "name", "n", F.array_join(text.identity_tokens(F.col("name")), " ").alias("span"))

    def decided(links: DataFrame) -> DataFrame:
        """links (key, key_kind, rows, owner, owner_rows): one outcome a facet."""
        one = links.groupBy(*both, "rows").agg(F.countDistinct("owner").alias("n"), F.min("owner").alias("owner"), F.min("owner_rows").alias("owner_rows"))
        outcome = F.when(F.col("n") > 1, "ambiguous").when(F.col("owner_rows") < factor * F.col("rows"), "not dominant").otherwise("merged")
        return one.withColumn("outcome", outcome).select(F.col("key").alias("facet"), F.col("key_kind").alias("facet_kind"), F.when(F.col("outcome") == "merged", F.col("owner")).alias("owner"), "outcome", "owner_rows")

    # acronyms
    short = owns.select("key", "name_key", F.col("rows").alias("owner_rows"), text.acronym(F.col("name_key")).alias("acronym")).where((F.length("acronym") >= ACRONYM_MIN) & F.col("name_key").contains(" "))
    shows = F.array_contains(F.split("span", " "), F.col("acronym"))
    short = short.join(words.where("key_kind = 'root'").select("key", "name_key", "span"), ["key", "name_key"]).where(shows).select(F.col("key").alias("owner"), "owner_rows", F.col("acronym").alias("label")).distinct()
    single = short.withColumn("n", F.count("*").over(Window.partitionBy("label"))).where("n = 1").drop("n")
    by_acronym = checkpoint(decided(g.where(~F.col("label").contains(" ")).join(single, "label").where("NOT (key_kind = 'root' AND key = owner)")))

    # parts: by label, then by every spelling
    named = owns.select(F.col("key").alias("owner"), F.col("rows").alias("owner_rows"), F.col("label").alias("span"))
    pairs = checkpoint(parts.select(*both, "rows", F.explode(_inner_spans(F.col("label"))).alias("span")).join(named, "span").drop("span"))
    counted = pruned_spellings(words.where("key_kind = 'name'").select("key", "name", "n"), "key", "n").select("key", F.array_join(text.identity_tokens(F.col("name")), " ").alias("text")).where("text <> ''").distinct()
    told = pairs.join(counted, "key")
    inner = told.select("key", "owner", "text", F.explode(_inner_spans(F.col("text"))).alias("span"))
    holds = inner.join(words.where("key_kind = 'root'").select(F.col("key").alias("owner"), "span").distinct(), ["owner", "span"]).select("key", "owner", "text").distinct()
    broken = told.select("key", "owner", "text").join(holds, ["key", "owner", "text"], "left_anti").select("key", "owner").distinct()
    pairs = pairs.join(broken, ["key", "owner"], "left_anti")
    up = by_acronym.where("outcome = 'merged' AND facet_kind = 'root'").select(F.col("facet").alias("owner"), F.col("owner").alias("up"), F.col("owner_rows").alias("up_rows"))
    chased = pairs.join(up, "owner", "left").select(*both, "rows", F.coalesce("up", "owner").alias("owner"), F.coalesce("up_rows", "owner_rows").alias("owner_rows"))
    return by_acronym.unionByName(decided(chased)).drop("owner_rows")


def facet_merges(spelled: DataFrame, checkpoint, factor: int = 10) -> DataFrame:
    """Decisions of the facet plan."""
    p = facet_plan(spelled, checkpoint, factor).where("outcome = 'merged'")
    return p.select(F.col("facet").alias("absorbed"), F.col("facet_kind").alias("absorbed_kind"), F.col("owner").alias("leader"), F.lit("root").alias("leader_kind"))
