"""Line dedup: a suffix array over line ids by distributed prefix doubling.

The corpus is one sequence of lines with words, document after document in
order of (doc_id, text). A run is consecutive lines of one document; a run of
at least ``min_words`` words that also starts earlier in the sequence is a
later copy, and its lines are removed. Blank lines stay.

Suffix array. A line that occurs once ends whatever stands before it, so the
text is cut into segments of consecutive lines that all occur more than once;
segments of fewer than ``min_words`` words hold no run. Level 0 ranks their
lines by 128-bit ids; level k + 1 ranks the pairs (rank at i, rank at i +
2**k, or none beyond the segment), so rank at level k orders all suffixes by
their first 2**k lines. Ranks are the row ids of the sorted distinct pairs,
numbered range by range. Doubling ends when no class of suffixes splits any
more: the last ranks, and the place in the sequence among equal ones, are the
suffix array.

Longest common prefixes. Of neighbours in the suffix array the levels tell the
common prefix from the top down: whenever the ranks of level k agree behind
what is known to agree, 2**k more lines do.

LCP intervals. What makes a run long enough is decided at its shortest: the
fewest lines from i on, or up to i, that have ``min_words`` words. A run of m
lines at a suffix belongs to the interval of depth m around it, which starts
at the last suffix whose common prefix with the one before is shorter than m.
All but the interval's first suffix in the sequence start a later copy. A
longer copied run is covered by the shortest ones inside it, from its start,
up to its end, or across, so runs that overlap or touch make up the maximal
ones. Equal suffixes count as one row until the copies are marked, so a group
of copies of any size is a few rows.

Edge cases: null texts have no lines and stay null; empty ones stay empty; a
text all of whose lines go becomes empty. Rows that repeat id and text are one
document, none a copy of the other. A null id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexmill.llm.common import Workspace, free_name, join_groups, table

WORD = r"[^\x20\x09-\x0D]+"
LINES = "rid long, doc_id {id}, d64 long, lines array<struct<i:int,h1:long,h2:long,words:int,fwd:int,fwd_to:int,bwd:int,bwd_from:int,no:int>>"


def shortest_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run of ``min_words`` words from each line on, and up to it; 0 if there is none."""
    c = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    end = np.searchsorted(c, c[at] + min_words, "left")
    start = np.searchsorted(c, c[at + 1] - min_words, "right") - 1
    return np.where(end < len(c), end - at, 0), np.where(start >= 0, at - start + 1, 0)


def _lines(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            out, digests = [], []
            for text in b["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                digests.append(xxhash.xxh3_64_intdigest(raw) - 2**63)
                kept = [(no, line, n) for no, line in enumerate(raw.split(b"\n")) if (n := len(line.split()))]
                fwd, bwd = shortest_runs(np.array([k[2] for k in kept], np.int64), min_words)
                rows = []
                for i, (no, line, n) in enumerate(kept):
                    h = xxhash.xxh3_128_intdigest(line)
                    f, w = int(fwd[i]), int(bwd[i])
                    rows.append({"i": i, "h1": (h >> 64) - 2**63, "h2": (h & (2**64 - 1)) - 2**63, "words": n, "fwd": f, "fwd_to": kept[i + f - 1][0] if f else 0, "bwd": w, "bwd_from": kept[i - w + 1][0] if w else 0, "no": no})
                out.append(rows)
            yield pd.DataFrame({"rid": b["rid"], "doc_id": b["doc_id"], "d64": digests, "lines": out})

    return run


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _numbered(df: DataFrame, by: tuple[str, ...], name: str, ws: Workspace, table_name: str) -> DataFrame:
    """``df`` with row numbers that rise with ``by`` (gaps between ranges)."""
    # row ids rise from one range of sorted rows to the next
    return ws.save(df.repartitionByRange(_parts(df), *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), table_name)


def _ranked(rows: DataFrame, a: str, b: str, ws: Workspace, level: int, total: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """``rows``, at most ``total``, whose (a, b) occurs ``least`` times, with its rank in place of both; and the ranks."""
    pairs = rows.groupBy(a, b).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranks = _numbered(pairs, (a, b), "rank", ws, f"ranks{level}")
    return ws.save(join_groups(rows, ranks, [a, b], "n", total).drop(a, b, "n"), f"level{level}"), ranks


def _before(ranks: DataFrame, value: str) -> list[tuple[int, int]]:
    """(number of a range, the greatest ``value`` of a range before it), one row a range."""
    rows = ranks.groupBy(F.shiftright("rank", 33).alias("range")).agg(F.max(value).alias("last")).collect()
    out, last = [], None
    for r in sorted(rows, key=lambda r: r["range"]):
        if last is not None:
            out.append((int(r["range"]), int(last)))
        last = last if r["last"] is None else r["last"]
    return out


def suffix_array(s: DataFrame, ws: Workspace, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels (rid, i, rank) and the last ranks, from ``s`` (rid, i, to the segment's ``end``, rank of the line)."""
    total, classes = s.count(), s.select("rank").distinct().count()
    levels, k = [s.select("rid", "i", "rank")], 0
    at = Window.partitionBy("rid").orderBy("i")
    rows = s.select("rid", "i", "end", "rank")
    while True:
        step = 2**k
        beyond = F.when(F.col("i") + step < F.col("end"), F.first("rank").over(at.rangeBetween(step, step))).otherwise(-1)
        pairs = rows.select("rid", "i", "end", F.col("rank").alias("r1"), beyond.alias("r2"))
        k += 1
        rows, ranks = _ranked(pairs, "r1", "r2", ws, k, total)
        levels.append(rows.select("rid", "i", "rank"))
        n = ranks.count()
        if n == classes or 2**k >= longest:
            return levels, ranks
        classes = n


def neighbours(ranks: DataFrame) -> DataFrame:
    """(rank, pred): every class of suffixes but the first, and the one before it."""
    spark = ranks.sparkSession
    first = spark.createDataFrame(_before(ranks, "rank"), "range long, last long")
    own = ranks.select("rank", F.shiftright("rank", 33).alias("range"))
    own = own.join(F.broadcast(first), "range", "left")  # one row a range
    return own.select("rank", F.when(F.col("rank") % 2**33 > 0, F.col("rank") - 1).otherwise(F.col("last")).alias("pred")).where("pred IS NOT NULL")


def common_prefixes(classes: DataFrame, pairs: DataFrame, levels: list[DataFrame], ws: Workspace) -> DataFrame:
    """(rank, lcp): lines that a class (rank, rid, i) and the one before it have in common."""
    a = classes.select("rank", F.col("rid").alias("rid1"), F.col("i").alias("i1"))
    b = classes.select(F.col("rank").alias("pred"), F.col("rid").alias("rid2"), F.col("i").alias("i2"))
    cur = pairs.join(a, "rank").join(b, "pred").select("rank", "rid1", "i1", "rid2", "i2", F.lit(0).alias("lcp"))
    for k in range(len(levels) - 1, -1, -1):
        x = levels[k].select(F.col("rid").alias("rid1"), F.col("i").alias("p1"), F.col("rank").alias("x"))
        y = levels[k].select(F.col("rid").alias("rid2"), F.col("i").alias("p2"), F.col("rank").alias("y"))
        cur = cur.withColumn("p1", F.col("i1") + F.col("lcp")).withColumn("p2", F.col("i2") + F.col("lcp"))
        cur = cur.join(x, ["rid1", "p1"], "left").join(y, ["rid2", "p2"], "left")
        cur = cur.withColumn("lcp", F.col("lcp") + F.when(F.col("x") == F.col("y"), 2**k).otherwise(0)).drop("x", "y", "p1", "p2")
        if k % 4 == 0:
            cur = ws.save(cur, f"lcp{k}")
    return cur.select("rank", "lcp")


def intervals(depths: DataFrame, ws: Workspace) -> DataFrame:
    """``depths`` (rank as cls, m, lcp) with ``interval``: the number of its first row."""
    d = _numbered(depths, ("m", "cls"), "rank", ws, "depths").withColumn("start", F.when(F.col("lcp") < F.col("m"), F.col("rank"))).withColumn("range", F.shiftright("rank", 33))
    carried = d.sparkSession.createDataFrame(_before(d, "start"), "range long, last long")
    run = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("own", F.last("start", ignorenulls=True).over(run)).join(F.broadcast(carried), "range", "left")  # one row a range
    return d.select("cls", "m", F.coalesce("own", "last").alias("interval"))


def segments(flat: DataFrame, min_words: int) -> DataFrame:
    """Rows of consecutive lines that make up ``min_words`` words, with their segment's ``start`` and ``end`` (exclusive)."""
    doc = Window.partitionBy("rid").orderBy("i")
    d = flat.withColumn("seg", F.col("i") - F.row_number().over(doc))
    seg = Window.partitionBy("rid", "seg")
    d = d.withColumn("start", F.min("i").over(seg)).withColumn("end", F.max("i").over(seg) + 1).withColumn("all", F.sum("words").over(seg))
    return d.where(F.col("all") >= min_words).drop("seg", "all", "words")


def copies(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Maximal runs of later copies: (doc_id, d64, from, to), line numbers from 0 and inclusive."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    lines = ws.save(d.mapInPandas(_lines(min_words), LINES.format(id=id_type)), "lines")
    flat = lines.select("rid", "doc_id", "d64", F.explode("lines").alias("l")).select("rid", "doc_id", "d64", "l.*")
    total = lines.agg(F.sum(F.size("lines"))).first()[0] or 0
    often, _ = _ranked(flat, "h1", "h2", ws, 0, total, least=2)
    s = ws.save(segments(often, min_words), "segments")
    ws.drop("lines", "level0")
    levels, ranks = suffix_array(s, ws, s.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0)

    pos = F.struct("doc_id", "d64", "s")
    of = levels[-1].withColumnRenamed("i", "s")
    classes = of.join(s.select("rid", F.col("i").alias("s"), "doc_id", "d64"), ["rid", "s"]).groupBy("rank").agg(F.min(F.struct("rid", "s")).alias("at"), F.min(pos).alias("first"))
    classes = ws.save(classes.select("rank", "at.rid", F.col("at.s").alias("i"), "first"), "classes")
    lcp = ws.save(common_prefixes(classes, neighbours(ranks), levels, ws), "lcp")

    fwd = s.where((F.col("fwd") > 0) & (F.col("i") + F.col("fwd") <= F.col("end"))).select("rid", "doc_id", "d64", F.col("i").alias("s"), F.col("fwd").alias("m"), F.col("no").alias("from"), F.col("fwd_to").alias("to"))
    begin = F.col("i") - F.col("bwd") + 1
    bwd = s.where((F.col("bwd") > 0) & (begin >= F.col("start"))).select("rid", "doc_id", "d64", begin.alias("s"), F.col("bwd").alias("m"), F.col("bwd_from").alias("from"), F.col("no").alias("to"))
    runs = ws.save(fwd.unionByName(bwd).distinct().join(of, ["rid", "s"]), "runs")
    depths = runs.groupBy(F.col("rank").alias("cls"), "m").agg(F.count("*").alias("n"))
    depths = ws.save(depths, "counts").join(lcp.withColumnRenamed("rank", "cls"), "cls", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))
    known = intervals(depths.select("cls", "m", "lcp"), ws)
    firsts = known.join(classes.select(F.col("rank").alias("cls"), "first"), "cls")
    oldest = ws.save(firsts.groupBy("interval").agg(F.min("first").alias("first"), F.count("*").alias("members")), "oldest")
    groups = join_groups(known, oldest, ["interval"], "members", depths.count()).join(depths.select("cls", "m", "n"), ["cls", "m"]).select(F.col("cls").alias("rank"), "m", "n", "first")
    groups = ws.save(groups, "intervals")
    later = join_groups(runs, groups, ["rank", "m"], "n", runs.count()).where(F.col("first") != pos).select("doc_id", "d64", "from", "to").distinct()
    # runs that overlap or touch are one maximal run
    doc = Window.partitionBy("doc_id", "d64").orderBy("from", "to")
    reach = F.max("to").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("from") > reach + 1), 1).otherwise(0)
    islands = later.withColumn("new", new).withColumn("island", F.sum("new").over(doc))
    return islands.groupBy("doc_id", "d64", "island").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("island")


@F.pandas_udf(LongType())
def text_digest(texts: pd.Series) -> pd.Series:
    import xxhash

    return pd.Series([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) - 2**63 for t in texts])


def line_dedup(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None, max_broadcast: int = 1_000_000, **kw) -> DataFrame:
    """``docs`` without the lines of later copies; ``removed_col`` adds how many lines went."""
    key, d64, runs = (free_name(docs, x) for x in ("__id", "__d64", "__runs"))
    cut = copies(docs, ws, id_col, text_col, **kw).groupBy("doc_id", "d64").agg(F.collect_list(F.struct("from", "to")).alias(runs))
    cut = ws.save(cut.select(F.col("doc_id").alias(key), F.col("d64").alias(d64), runs), "cut")
    ids = cut.select(key).distinct()
    small = cut.count() <= max_broadcast
    hint = F.broadcast if small else (lambda x: x)
    # only documents with an id that has copies need their digest
    some = docs.join(hint(ids), F.col(id_col).eqNullSafe(F.col(key)), "left_semi").withColumn(d64, text_digest(F.col(text_col)))
    rest = docs.join(hint(ids), F.col(id_col).eqNullSafe(F.col(key)), "left_anti")
    j = some.join(hint(cut.withColumnRenamed(d64, d64 + "_r")), F.col(id_col).eqNullSafe(F.col(key)) & (F.col(d64) == F.col(d64 + "_r")), "left")
    goes = lambda line, no: F.exists(F.coalesce(F.col(runs), F.expr("array()").cast("array<struct<from:int,to:int>>")), lambda r: (no >= r["from"]) & (no <= r["to"])) & line.rlike(WORD)
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda line, no: ~goes(line, no))
    out = {c: F.col(c) for c in docs.columns}
    if removed_col:
        out[removed_col] = (F.size(lines) - F.size(kept)).cast("long")
    out[text_col] = F.array_join(kept, "\n")
    plain = {c: F.col(c) for c in docs.columns} | ({removed_col: F.lit(0).cast("long")} if removed_col else {})
    return j.select(*[v.alias(c) for c, v in out.items()]).unionByName(rest.select(*[v.alias(c) for c, v in plain.items()]))


def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, Workspace(spark), removed_col="n_removed")
    return out.select("doc_id", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
