"""What callers ask of the engine, as functions that return DataFrames.

Filters are keyword arguments that may be None; every list has a total order
and a size, and pages carry an opaque cursor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import aggregates, relational, search


def _where(df: DataFrame, equal: dict[str, object], within: dict[str, tuple], listed: dict[str, list]) -> DataFrame:
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    for c, (a, b) in within.items():
        if a is not None:
            df = df.where(F.col(c) >= a)
        if b is not None:
            df = df.where(F.col(c) < b)
    for c, vs in listed.items():
        if vs:
            df = df.where(F.col(c).isin(*vs))
    return df


def cases(df: DataFrame, *, court: str = "court", day: str = "day", key: str = "case", courts: list[str] | None = None, since=None, until=None, case: str | None = None, sort: str | None = None, after: str | None = None, size: int = 50) -> DataFrame:
    """A page of cases, newest first unless ``sort`` names another column."""
    d = _where(df, {key: case}, {day: (since, until)}, {court: courts or []})
    order = sort or day
    return relational.keyset_page(d, order, key, relational.decode_cursor(after, order) if after else None, max(1, min(200, size)))


def next_cursor(page: list, sort: str, key: str, size: int) -> str | None:
    """The cursor after a page, or None if the page is not full."""
    return relational.encode_cursor([page[-1][sort], page[-1][key]], sort) if len(page) == size else None


def movements(df: DataFrame, *, case: str | None = None, kind: str | None = None, query: str | None = None, key: str = "case", kind_col: str = "kind", text_col: str = "text", day: str = "day", since=None, until=None) -> DataFrame:
    """Movements by case, kind (whatever its case), days and words."""
    d = _where(df, {key: case}, {day: (since, until)}, {})
    if kind:
        d = d.where(F.lower(kind_col) == kind.lower())
    return d.where(text.matches_query(text.tokens(F.col(text_col)), query)) if query else d


def ranked(df: DataFrame, id_col: str, text_col: str, query: str, size: int = 50) -> DataFrame:
    """The best texts by BM25, ties by id."""
    return search.bm25(df, id_col, text.tokens(F.col(text_col)), query).orderBy(F.desc("score"), id_col).limit(size)


def chart(df: DataFrame, kind: str, *, key: str | None = None, ts: str = "ts", unit: str = "day", n: int = 10) -> DataFrame:
    """facet, others or series: the most frequent values, those with the rest, or counts per time bucket."""
    if kind == "facet":
        return aggregates.facet(df, key, n)
    if kind == "others":
        return aggregates.top_with_others(df, key, n)
    if kind == "series":
        return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket")
    raise ValueError(f"unknown chart {kind}")


def leads(df: DataFrame, consumed: DataFrame, *, key: str = "case", level: str | None = None, level_col: str = "category", score: str = "score", least: float = 0.0, public: Column | None = None, size: int = 100) -> DataFrame:
    """Cases worth a look, best first, without those consumed before."""
    d = _where(df, {level_col: level}, {score: (least, None)}, {})
    if public is not None:
        d = d.where(public)
    return d.join(consumed.select(key), key, "left_anti").orderBy(F.desc(score), key).limit(size)


def consume(leads_: DataFrame, requested: DataFrame, done: DataFrame, key: str = "case") -> DataFrame:
    """created, duplicates and missing of a batch of outcomes; the same batch twice creates nothing."""
    j = requested.dropDuplicates([key]).join(leads_.select(key, F.lit(True).alias("there")), key, "left").join(done.select(key, F.lit(True).alias("done")).distinct(), key, "left")
    known = F.col("there").isNotNull()
    return j.agg(F.count_if(known & F.col("done").isNull()).alias("created"), F.count_if(known & F.col("done").isNotNull()).alias("duplicates"), F.count_if(~known).alias("missing"))
