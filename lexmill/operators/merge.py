"""Merging and repairing rows: upserts, gap filling, duplicates, poles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import fold

# Roles by pole on folded text. Short forms count only whole: as a start they would take the active roles too.
PASSIVE_WHOLE = ("reu", "re", "reu/re")
PASSIVE = ("exectd", "reqd", "requerid", "apd", "apelad", "embd", "embargad", "impd", "impetrad", "agvd", "agravad", "rcld", "reclamad", "recd", "recorrid", "executad")
ACTIVE = ("exequent", "exeqte", "reqte", "requerent", "autor", "apte", "apelant", "embte", "embargant", "impte", "impetrant", "agvte", "agravant", "rclte", "reclamant", "recte", "recorrent")


def pole_of(role: Column) -> Column:
    """passive, active or other; passive is looked for first."""
    r = fold(F.trim(F.coalesce(role, F.lit(""))))
    starts = lambda words: r.rlike(f"^({'|'.join(words)})")
    return F.when(r.isin(*PASSIVE_WHOLE) | starts(PASSIVE), "passive").when(starts(ACTIVE), "active").otherwise("other")


def recomputed_poles(parties: DataFrame, id_col: str, slot: list[str], role: str, pole: str, represents: str) -> DataFrame:
    """(id, pole) of rows of pole other whose role tells their pole.

    A row that represents nobody stays where it is if the slot (``slot``,
    role and new pole) is taken by another such row; of several rows that
    would take it, the smallest id does.
    """
    d = parties.select(id_col, *slot, role, pole, represents, pole_of(F.col(role)).alias("to"))
    moving = d.where((F.col(pole) == "other") & (F.col("to") != "other"))
    free = moving.where(F.col(represents).isNotNull()).select(id_col, F.col("to").alias("pole"))
    keys = [*slot, role, "to"]
    taken = d.where(F.col(represents).isNull()).select(*slot, role, F.col(pole).alias("to")).distinct()
    one = moving.where(F.col(represents).isNull()).groupBy(*keys).agg(F.min(id_col).alias(id_col))
    return free.unionByName(one.join(taken, keys, "left_anti").select(id_col, F.col("to").alias("pole")))


def insert_new(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows and those of the batch with keys not there yet, one per key."""
    return current.unionByName(batch.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row per key; of equal versions, the batch's."""
    both = current.withColumn("__b", F.lit(0)).unionByName(batch.withColumn("__b", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__b")).alias("r")).select(*keys, "r.*")


def summarised(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, n, first, last): rows and their earliest and latest moment; a null moment counts as a row only."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def kept_in_step(summary: DataFrame, rows: DataFrame, inserted: DataFrame, deleted: DataFrame, key: str, at: str) -> DataFrame:
    """The summary after a batch of inserts and deletes; ``rows`` are the rows after both.

    Counts are added and subtracted and new extremes taken in; rows are only
    read again for keys that lost their first or last moment. Keys without
    rows go; a null key is a key.
    """
    of = lambda d, p: summarised(d, key, at).select(F.col(key).alias(f"{p}_key"), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "first", "last")])
    base = summary.select(F.col(key).alias("s_key"), *[F.col(c).alias(f"s_{c}") for c in ("n", "first", "last")])
    j = base.join(of(inserted, "i"), F.col("s_key").eqNullSafe(F.col("i_key")) & F.col("s_n").isNotNull(), "full")
    j = j.withColumn(key, F.when(F.col("s_n").isNotNull(), F.col("s_key")).otherwise(F.col("i_key")))
    j = j.join(of(deleted, "d"), F.col(key).eqNullSafe(F.col("d_key")), "left")
    n = F.coalesce("s_n", F.lit(0)) + F.coalesce("i_n", F.lit(0)) - F.coalesce("d_n", F.lit(0))
    first, last = F.least("s_first", "i_first"), F.greatest("s_last", "i_last")
    lost = F.coalesce((F.col("d_first") <= first) | (F.col("d_last") >= last), F.lit(False))
    d = j.select(key, n.alias("n"), first.alias("first"), last.alias("last"), lost.alias("lost")).where("n > 0")
    again = d.where("lost").select(F.col(key).alias("__k"))
    fresh = summarised(rows.join(again, F.col(key).eqNullSafe(F.col("__k")), "left_semi"), key, at)
    return d.where("NOT lost").drop("lost").unionByName(fresh)


def fill_gaps(current: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns that are null or empty in current take the batch's value; all else stays."""
    b = batch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    j = current.join(b, key, "left")
    blank = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return j.select(*[F.coalesce(blank(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in current.columns])


def no_downgrade(old: Column, new: Column) -> Column:
    """The new value, unless it is empty, or masked where the old one is not."""
    empty = lambda c: c.isNull() | (c == "")
    masked = lambda c: c.rlike("[Xx*]")
    return F.when(empty(new) | (~empty(old) & masked(new) & ~masked(old)), old).otherwise(new)


def identity_route(bar: Column, doc: Column, name: Column) -> Column:
    """(path, key) by which a party is found: bar number, real document, masked document and name, or name."""
    has = lambda c: c.isNotNull() & (c != "")
    masked = doc.rlike("[Xx*]")
    route = lambda p, *k: F.struct(F.lit(p).alias("path"), F.concat_ws("|", *k).alias("key"))
    return F.when(has(bar), route("bar", bar)).when(has(doc) & ~masked, route("document", doc)).when(has(doc), route("masked", doc, name)).otherwise(route("name", name))


def survivors(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(id, keep): the smallest id of rows with the same non-null key."""
    d = df.select(F.col(id_col).alias("id"), key.alias("k")).where(F.col("k").isNotNull())
    return d.select("id", F.min("id").over(Window.partitionBy("k")).alias("keep"))


def repoint(children: DataFrame, fk: str, redirect: DataFrame, slot: list[str], id_col: str) -> DataFrame:
    """Children moved to the surviving parent; of children that then share a slot, the smallest id stays."""
    r = redirect.select(F.col("id").alias(fk), F.col("keep").alias("__keep"))
    moved = children.join(r, fk, "left").withColumn(fk, F.coalesce("__keep", fk)).drop("__keep")
    return moved.withColumn("__first", F.min(id_col).over(Window.partitionBy(*slot))).where(F.col(id_col) == F.col("__first")).drop("__first")


def merge_into_single(df: DataFrame, id_col: str, name: str, doc: str) -> DataFrame:
    """(id, keep) for rows without a document whose name belongs to exactly one row with one."""
    has = F.col(doc).isNotNull() & (F.col(doc) != "")
    one = df.where(has).groupBy(name).agg(F.min(id_col).alias("keep"), F.count("*").alias("n")).where("n = 1").drop("n")
    return df.where(~has).join(one, name).select(F.col(id_col).alias("id"), "keep")
