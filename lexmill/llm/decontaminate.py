"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are runs of ASCII digits, lower-cased ASCII letters and non-ASCII
characters. A window is ``n`` consecutive words of a benchmark item; an item
of fewer words, but not none, is one window.

One pass reads the texts. A window of L words that occurs in a text covers an
aligned stretch of q = (L + 1) div 2 words (one that starts at a multiple of
q), so each word is hashed once per distinct q, and the hashes of a text's
aligned stretches probe the set of hashes of all stretches of windows, which
is broadcast. A stretch that is in the set passes on with the words around it;
the windows that cover it are looked up among the benchmark's windows by their
words, which verifies the hit. Texts are never shuffled.

The set is broadcast for at most ``max_broadcast`` stretches. A larger one is
joined by shuffle: still only hashes of aligned stretches move, one for q
words of text, and words move only for those in the set.

Edge cases: null or empty texts have no words and no hits; items without words
have no windows; an item_id repeated is one item; a null item_id counts as an
item and is left out of the list of ids. Rows that repeat a doc_id are judged
each by its own text, and cut or dropped by id and a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, ascii_lower, free_name, join_groups, table

#: The words of a lower-cased text, and of one as it stands.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item_id, len, gram) for every window; gram holds its words joined by spaces."""
    w = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))
    return w.select("item_id", "len", F.explode(at).alias("gram")).distinct()


def _hash(q: Column, words: Column) -> Column:
    return F.xxhash64(q, words)


def _stretches(windows: DataFrame) -> DataFrame:
    """h: hashes of all stretches of q = (len + 1) div 2 words of the windows."""
    w = windows.select("len", F.expr("(len + 1) div 2").cast("int").alias("q"), F.split("gram", " ").alias("w")).distinct()
    at = F.transform(F.sequence(F.lit(1), F.col("len") - F.col("q") + 1), lambda i: _hash(F.col("q"), F.slice("w", i, F.col("q"))))
    return w.select(F.explode(at).alias("h")).distinct()


#: The row of a text itself among those of its stretches.
ITSELF = "named_struct('q', 0, 'i', 0, 'h', 0L)"


def _aligned(q: int) -> Column:
    """(q, i, h) of every aligned stretch of q words of column ``w``; i counts from 0."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / q).cast("int") - 1), lambda i: F.struct(F.lit(q).alias("q"), i.alias("i"), _hash(F.lit(q), F.slice("w", i * q + 1, F.lit(q))).alias("h")))
    return F.when(F.size("w") >= q, rows).otherwise(F.expr("cast(array() as array<struct<q:int,i:int,h:bigint>>)"))


def _near() -> tuple[Column, Column]:
    """(first position, words) around stretch i of q words: all that windows of up to 2 q words covering it can hold."""
    first = F.greatest(F.lit(1), (F.col("i") - 1) * F.col("q") + 1)
    return first.alias("at"), F.slice("w", first, (F.col("i") + 2) * F.col("q") - first + 1).alias("near")


def _windows_over(lens: list[int]) -> Column:
    """(pos, len, gram) of the windows that cover the stretch of a row, from at, q, i and near."""

    def of(n: int) -> Column:
        q = (n + 1) // 2
        start = F.col("i") * q + 1
        low, high = F.greatest(F.lit(1), start - (n - q)), F.least(start, F.col("at") + F.size("near") - n)
        rows = F.transform(F.sequence(low, high), lambda p: F.struct(p.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice("near", p - F.col("at") + 1, F.lit(n)), " ").alias("gram")))
        return F.when((F.col("q") == q) & (low <= high), rows).otherwise(F.expr("cast(array() as array<struct<pos:int,len:int,gram:string>>)"))

    return F.concat(*map(of, lens))


def scan(docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 13, max_broadcast: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Two tables: (rid, doc_id, n_words) per row of ``docs``, and verified hits (rid, pos, len, item_id)."""
    windows = ws.save(windows_of(benchmark, item_id_col, item_text_col, n), "windows")
    lens = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most n
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    n_words = F.size("w").cast("long").alias("n_words")
    if not lens:
        seen = base.select("rid", "doc_id", n_words)
        return seen, seen.where("false").select("rid", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast(benchmark.schema[item_id_col].dataType).alias("item_id"))
    stretches = ws.save(_stretches(windows), "stretches")
    qs = sorted({(x + 1) // 2 for x in lens})
    if stretches.count() <= max_broadcast:
        known = F.broadcast(stretches.union(docs.sparkSession.sql("SELECT 0L AS h")).distinct())
        hashed = base.select("rid", "doc_id", "w", F.concat(F.array(F.expr(ITSELF)), *map(_aligned, qs)).alias("s"))
        hit = hashed.select("rid", "doc_id", "w", F.explode("s").alias("s")).select("rid", "doc_id", "w", "s.*").join(known, "h", "left_semi")
        itself = F.col("q") == 0
        found = ws.save(hit.select("rid", F.when(itself, F.col("doc_id")).alias("doc_id"), F.when(itself, F.size("w").cast("long")).alias("n_words"), "q", "i", *(F.when(~itself, x).alias(k) for k, x in zip(("at", "near"), _near(), strict=True))), "found")
        seen, found = found.where("q = 0").select("rid", "doc_id", "n_words"), found.where("q > 0")
    else:
        base = ws.save(base, "base")
        seen = base.select("rid", "doc_id", n_words)
        hashed = base.select("rid", F.explode(F.concat(*map(_aligned, qs))).alias("s")).select("rid", "s.*")
        passed = ws.save(hashed.join(stretches, "h", "left_semi").select("rid", "q", "i"), "passed")
        found = passed.join(base, "rid").select("rid", "q", "i", *_near())
    grams = ws.save(found.select("rid", F.explode(_windows_over(lens)).alias("x")).select("rid", "x.*").distinct(), "grams")
    if windows.count() <= max_broadcast:
        hits = grams.join(F.broadcast(windows), ["len", "gram"])
    else:
        often = grams.groupBy("len", "gram").agg(F.count("*").alias("n"))
        hits = join_groups(grams, windows.join(often, ["len", "gram"]), ["len", "gram"], "n", grams.count())
    return seen, hits.select("rid", "pos", "len", "item_id")


def covered(spans: Column) -> Column:
    """Words covered by the union of (pos, len) spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = (x["pos"] + x["len"]).cast("long")
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], x["pos"].cast("long")))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, ws: Workspace, share: int = 20, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``.

    A row is contaminated if it has a hit and hits are at least one word in ``share``.
    """
    seen, hits = scan(docs, benchmark, ws, **names)
    spans = hits.select("rid", "pos", "len").distinct().groupBy("rid").agg(covered(F.collect_list(F.struct("pos", "len"))).alias("n_hit"))
    items = hits.select("rid", "item_id").distinct().groupBy("rid").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    out = seen.join(spans, "rid", "left").join(items, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", max_marks: int = 1_000_000, **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated.

    Ids of contaminated rows, with a hash of the text, are broadcast up to
    ``max_marks`` of them and shuffle-joined beyond.
    """
    name, d64, key = free_name(docs, "__bad"), free_name(docs, "__d64"), free_name(docs, "__key")
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("d64")).alias(key), F.col(text_col))
    found = report(keyed, benchmark, ws, id_col=key, text_col=text_col, **kw).where("contaminated")
    bad = ws.save(found.select(F.col("doc_id.id").alias(name), F.col("doc_id.d64").alias(d64)).distinct(), "bad")
    small = bad.count() <= max_marks
    return docs.join(F.broadcast(bad) if small else bad, F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(d64)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", max_marks: int = 1_000_000, **kw) -> DataFrame:
    """``docs`` with the words of hits cut out of the text; the characters between words stay.

    Spans of a row are joined back by id and a hash of the text, by broadcast
    up to ``max_marks`` texts with hits.
    """
    name, d64, spans, key = (free_name(docs, x) for x in ("__id", "__d64", "__spans", "__key"))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("d64")).alias(key), F.col(text_col))
    seen, hits = scan(keyed, benchmark, ws, id_col=key, text_col=text_col, **kw)
    cut = hits.select("rid", "pos", "len").distinct().groupBy("rid").agg(F.collect_list(F.struct("pos", "len")).alias(spans))
    cut = seen.join(cut, "rid").groupBy(F.col("doc_id.id").alias(name), F.col("doc_id.d64").alias(d64)).agg(F.first(spans).alias(spans))
    cut = ws.save(cut, "cut")
    small = cut.count() <= max_marks
    words = F.regexp_extract_all(F.col(text_col), F.lit(RAW_WORD), F.lit(0))
    gaps = F.split(F.col(text_col), RAW_WORD, -1)
    kept = F.transform(words, lambda w, i: F.when(F.exists(spans, lambda s: (i + 1 >= s["pos"]) & (i + 1 < s["pos"] + s["len"])), F.lit("")).otherwise(w))
    rebuilt = F.concat(gaps[0], F.array_join(F.zip_with(kept, F.slice(gaps, F.lit(2), F.size(words)), lambda w, g: F.concat(w, g)), ""))
    out = docs.join(F.broadcast(cut) if small else cut, F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(d64)), "left")
    return out.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(rebuilt)).select(*docs.columns)


def op1_decontamination(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT DISTINCT rid, n, i, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""
