"""Exact dedup: two passes over digests with a Bloom filter between them.

Pass 1 counts, with partial sums in every task, how many rows fall on each
cell of a filter of ``bits_per_row`` cells a row; the cells met at least twice
are its bits. Pass 2 probes the filter by broadcast: a row whose cell no other
row has is like no other and passes straight through; only the rest carry
their digest into a shuffle. All of it is DataFrame functions.

Dense bitmaps, one a task, would have to be merged at (tasks x filter) bytes;
a cell and its count are 16 bytes for a row at most, and equal rows of a task
are one. The filter has at most ``max_filter_bytes``: with more rows than that
serves, digests are dealt over so many parts by another hash, and each part
has a filter of its own, broadcast in its turn. A digest that many rows share
is joined to its group by broadcast, so its rows do not meet in one task.

Edge cases: null text counts as empty. A null id sorts below all others. Rows
with the same text and the same largest id are one document repeated: each is
marked kept in the decisions, and ``exact_dedup`` returns one of them. Empty
tables give empty results; other columns are carried by ``exact_dedup`` as
they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, free_name, join_groups

#: Cells in a block of the filter, which is what bitmap_construct_agg packs in a row.
BLOCK = 32768


def text_digest(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def cells_for(n_rows: int, bits_per_row: int, max_filter_bytes: int) -> tuple[int, int]:
    """(cells of a filter, how many filters) for so many rows."""
    bits, most = max(n_rows * bits_per_row, BLOCK), max(BLOCK, max_filter_bytes * 8)
    parts = -(-bits // most)
    return -(-bits // parts), parts


def _cell(digest: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(1)), F.lit(cells))


def repeated_cells(rows: DataFrame, digest: str, cells: int) -> DataFrame:
    """Pass 1: block -> bitmap of the cells that two or more rows fall on."""
    twice = rows.groupBy(_cell(F.col(digest), cells).alias("cell")).agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.floor(F.col("cell") / BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("cell") % BLOCK).alias("bitmap"))


def maybe_repeated(df: DataFrame, digest: str, filter_: DataFrame, cells: int, flag: str) -> DataFrame:
    """Pass 2: adds ``flag``, false only for rows whose digest no other row has."""
    block, bitmap, cell = (free_name(df, x) for x in ("__block", "__bitmap", "__cell"))
    probe = F.broadcast(filter_.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap)))
    out = df.withColumn(cell, _cell(F.col(digest), cells)).withColumn(block, F.floor(F.col(cell) / BLOCK)).join(probe, block, "left")
    bit = F.col(cell) % BLOCK
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return out.withColumn(flag, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop(block, bitmap, cell)


def probed(df: DataFrame, digests: DataFrame, digest: str, ws: Workspace, bits_per_row: int, max_filter_bytes: int, flag: str) -> DataFrame:
    """``df`` with ``flag`` by one filter over ``digests``, which a bound on its size may make pass more rows."""
    cells = min(cells_for(digests.count(), bits_per_row, max_filter_bytes)[0], max(BLOCK, max_filter_bytes * 8))
    return maybe_repeated(df, digest, ws.save(repeated_cells(digests, digest, cells), "filter"), cells, flag)


def decisions(df: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 128 << 20) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256."""
    total = df.count()
    cells, parts = cells_for(total, bits_per_row, max_filter_bytes)
    digest = F.col("text_sha256")
    rows = df.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"))
    if parts == 1:
        rows = ws.save(rows, "digests")
        seen = maybe_repeated(rows, "text_sha256", ws.save(repeated_cells(rows, "text_sha256", cells), "filter"), cells, "maybe")
    else:
        rows = ws.save(rows.withColumn("part", F.pmod(F.xxhash64(digest), F.lit(parts)).cast("int")), "digests", by=("part",))
        done = []
        for p in range(parts):
            own = rows.where(F.col("part") == p).drop("part")
            done.append(ws.save(maybe_repeated(own, "text_sha256", ws.save(repeated_cells(own, "text_sha256", cells), "filter"), cells, "maybe"), f"probed{p}"))
        seen = reduce(DataFrame.unionByName, done)
    alone = seen.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = seen.where("maybe").select("doc_id", "text_sha256")
    groups = ws.save(some.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    joined = join_groups(some, groups, ["text_sha256"], "group_size", total).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(joined)


def exact_dedup(df: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000, **kw) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Texts are not shuffled but for rows that repeat both id and text: what
    goes is marked by id and digest and joined back, by broadcast up to
    ``max_broadcast`` marks.
    """
    key, digest, mark, twins = (free_name(df, x) for x in ("__key", "__digest", "__mark", "__twins"))
    d = decisions(df, ws, id_col, text_col, **kw).where("group_size > 1")
    marks = d.groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(mark)).agg(F.min("kept").alias("stays"), F.count("*").alias("n"))
    marks = ws.save(marks.where("NOT stays OR n > 1").select(key, mark, F.when(F.col("stays"), F.lit(True)).otherwise(False).alias(twins)), "marks")
    few = marks.count() <= max_broadcast
    own = df.withColumn(digest, text_digest(F.col(text_col)))
    out = own.join(F.broadcast(marks) if few else marks, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(mark)), "left")
    alone = out.where(F.col(twins).isNull()).select(*df.columns)
    return alone.unionByName(out.where(F.col(twins)).dropDuplicates([key, mark]).select(*df.columns))


def op4_exact_dedup(spark, sf_dir):
    from lexmill.llm.common import table

    return decisions(table(spark, sf_dir, "documents"), Workspace(spark))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
