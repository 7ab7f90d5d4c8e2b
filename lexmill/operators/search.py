"""Text search: matching, BM25 ranking, scores by prevalence, autocomplete, standing queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.functions.text import fold_py


def postings(docs: DataFrame, id_col: str, toks: Column, terms: list[str] | None = None) -> DataFrame:
    """(id, term, tf, dl): how often each term stands in a text, and the text's length in tokens.

    With ``terms``, only their postings are exploded: texts never multiply by their length.
    """
    d = docs.select(id_col, toks.alias("toks"))
    if terms is None:
        return d.select(id_col, F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy(id_col, "term", "dl").agg(F.count("*").alias("tf"))
    wanted = F.array(*map(F.lit, terms))
    hits = F.filter(F.transform(wanted, lambda t: F.struct(t.alias("term"), F.size(F.filter(F.col("toks"), lambda x: x == t)).alias("tf"))), lambda s: s["tf"] > 0)
    return d.select(id_col, F.size("toks").alias("dl"), F.explode(hits).alias("h")).select(id_col, "dl", "h.term", "h.tf")


def bm25(docs: DataFrame, id_col: str, toks: Column, query: str, checkpoint=lambda d: d, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of texts with any of the query's words, by BM25.

    ``checkpoint`` may stage the lengths and counts, a few numbers a text, so
    that texts are cut into words once for the corpus figures and the scores.
    """
    terms = list(dict.fromkeys(re.findall("[a-z0-9]+", fold_py(query))))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).where("false")
    words = F.col("toks")
    times = lambda t: F.size(F.filter(words, lambda x: x == t))
    found = F.array(*map(times, terms))
    # every text has its one pass over its words here
    d = checkpoint(docs.select(id_col, toks.alias("toks")).select(id_col, F.size(words).alias("dl"), found.alias("tf")))
    size = d.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).alias("df"))
    j = d.where(F.exists("tf", lambda n: n > 0)).crossJoin(F.broadcast(size))  # one row
    idf = lambda n: F.log(1 + (F.col("n_docs") - n + 0.5) / (n + 0.5))
    part = lambda tf, n: idf(n) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return j.select(id_col, F.aggregate(F.zip_with("tf", "df", part), F.lit(0.0), lambda x, y: x + y).alias("score"))


def prevalence_score(base: Column, n: Column, attested: Column) -> Column:
    """A text score raised by how often an entity occurs; unknown counts are not zero counts."""
    return base * F.when(n.isNotNull(), F.log10(2 + 4 * n)).otherwise(F.log10(2 + 4 * F.coalesce(attested, F.lit(0)) * 0.5))


def best_field(scores: list[Column], tie: float = 0.1) -> Column:
    """The best field's score and a tenth of the others."""
    top = F.greatest(*scores)
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return top + tie * (total - top)


def autocomplete(entities: DataFrame, name: str, rows: str, query: str, n: int, only: Column | None = None) -> DataFrame:
    """Entities whose name has the query's words, the last as a prefix, by match and prevalence; ``only`` filters hits, not scores."""
    toks = text.tokens(F.col(name))
    exact = text.has_phrase(toks, query)
    first = F.array_join(toks, " ").startswith(" ".join(re.findall("[a-z0-9]+", fold_py(query))))
    score = best_field([F.when(first, 3.0).otherwise(0.0), F.when(exact, 2.5).otherwise(0.0), F.lit(1.0)]) * F.log10(2 + 4 * F.col(rows))
    d = entities.where(text.has_prefix_query(toks, query)).withColumn("score", F.round(score, 6))
    if only is not None:
        d = d.where(only)
    return d.orderBy(F.desc("score"), name).limit(n)


def resolve(entities: DataFrame, name: str, cases: str, rows: str, query: str) -> DataFrame:
    """The one entity a text means: all its words in the name, most cases, then most rows."""
    words = re.findall("[a-z0-9]+", fold_py(query))
    d = entities.where(text.has_all_tokens(text.tokens(F.col(name)), words))
    return d.agg(F.max_by(F.struct(name, cases, rows), F.struct(F.coalesce(cases, F.lit(-1)), rows, name)).alias("m")).where("m IS NOT NULL").select("m.*")


def standing_matches(docs: DataFrame, id_col: str, toks: str, terms: DataFrame, term_id: str, term: str) -> DataFrame:
    """(term, id) once for every monitored phrase that stands in a text."""
    from lexmill.operators.entities import phrase_join

    t = terms.select(F.col(term_id), F.array_join(text.tokens(F.col(term)), " ").alias("phrase")).where("phrase <> ''")
    return phrase_join(docs, id_col, toks, t.select("phrase").distinct(), "phrase").join(t, "phrase").select(term_id, id_col).distinct()


def weighted_tokens(fields: dict[str, Column]) -> Column:
    """Tokens with the weight letter of their field, as in term:A."""

    def marked(weight: str, c: Column) -> Column:
        return F.transform(text.tokens(c), lambda t: F.concat(t, F.lit(f":{weight}")))

    return F.concat(*[marked(w, c) for w, c in fields.items()])
