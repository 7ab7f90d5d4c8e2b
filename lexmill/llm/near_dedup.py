"""Near-duplicates: bottom-k sketches, inverted lists, exact Jaccard.

A text's set is its distinct shingles, hashed once to 64 bits; its sketch is
the ``SKETCH`` smallest hashes. Texts with equal sets are one node. Two nodes
are linked if 100 * |A & B| >= 75 * |A | B|.

Candidates. Of linked nodes' sketches, about 75 in 100 values agree; the sure
part used by default is 44 in 100 (at J = 0.75 a miss in a million pairs where
one set contains the other, in some 10^11 where they are of equal size, for
sets much larger than a sketch). ``sketch`` and ``sure`` are parameters, and
``sketch=0`` is the exact way: whole sets instead of sketches, of which linked
ones surely share 75 in 100, at the price of a list entry for every fourth
shingle. Sketches
that agree in o of k values share one of their first k - o + 1 values in any
common order, so a node enters only the inverted lists of that many values,
rarest first. A node whose values are mostly its own enters none, however
common the passage it quotes.

Verification. Each inverted list names its most central member, the one with
the fewest values of its own, as pivot; the lists of a pivot together are one
cluster, so a group of near copies that share dozens of lists is compared
once. Clusters are compared in blocks of bounded size: members not linked to
the pivot directly against all members. Inside a block no pair is written
out: sizes and sketch overlaps sift, full sets confirm, and only links that
join two parts of the block leave it. No list, cluster or partner count has a
cap.

Components are found by large-star and small-star rounds over the links; their
tables are staged in the shared folder, so a lost executor repeats one round.

Edge cases: null and empty texts have an empty set and no links. A null doc_id
never names a component unless all its ids are null. Rows that repeat a doc_id
are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, free_name, join_salted, table
from lexmill.llm.shingles import SKETCH, _Words, shingle_set

LINK = (75, 100)
#: Share of a sketch that linked nodes surely agree in.
SURE = 0.44
#: Nodes and shingles of a block.
BLOCK_NODES, BLOCK_SHINGLES = 256, 1_000_000


def _sketches(size: int, sketch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = _Words()
        for b in batches:
            sets = [shingle_set(t, words, size) for t in b["text"]]
            yield pd.DataFrame({"rid": b["rid"], "doc_id": b["doc_id"], "d64": b["d64"], "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "sketch": [(s[:sketch] if sketch else s).view(np.int64) for s in sets]})

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = _Words()
        for b in batches:
            sets = [shingle_set(t, words, size) for t in b["text"]]
            yield pd.DataFrame({"digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "set": [s.tobytes() for s in sets]})

    return run


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LINK[1] * both >= LINK[0] * (len(a) + len(b) - both)


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate: the share of the union's bottom-k that is in both sketches."""
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)[:SKETCH]
    return np.searchsorted(both, union[-1], "right") / len(union)


def block_links(nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, sketch: int = SKETCH, sure: float = SURE) -> list[tuple[int, int]]:
    """Links between left and right members (positions) that join two parts of the block.

    Pairs are tried in order of their sketches' overlap; without ``sketch`` it rules out none.
    """
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    k = sketch or SKETCH
    sketches = [s[:k] for s in sets]
    n = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sketches), return_inverse=True)
    seen = np.zeros((len(sets), len(values)), np.float32)
    seen[np.repeat(np.arange(len(sets)), [len(s) for s in sketches]), at] = 1
    seen = seen[:, seen.sum(0) > 1]
    overlap = seen[left] @ seen[right].T
    least = np.maximum(1, np.floor(sure * np.minimum(n, k))) if sketch else np.zeros(len(sets))
    a, b = n[left][:, None], n[right][None, :]
    near = (overlap >= np.maximum(least[left][:, None], least[right][None, :])) & (LINK[1] * np.minimum(a, b) >= LINK[0] * np.maximum(a, b)) & (left[:, None] != right[None, :])
    li, ri = np.nonzero(near)
    out = []
    for x in np.argsort(-overlap[li, ri], kind="stable"):
        i, j = int(left[li[x]]), int(right[ri[x]])
        ti, tj = root(i), root(j)
        if ti != tj and linked(sets[i], sets[j]):
            parent[max(ti, tj)] = min(ti, tj)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _compare(sketch: int, sure: float):
    def run(t: pa.Table) -> pa.Table:
        """A block: its rows are (node, side, set), side 1 for the left, 2 for the right, 3 for both."""
        frame = t.select(["node", "side", "set"]).to_pandas().groupby("node", as_index=False).agg({"side": lambda s: int(np.bitwise_or.reduce(s)), "set": "first"})
        sets, side = [np.frombuffer(s, np.uint64) for s in frame["set"]], frame["side"].to_numpy()
        found = block_links(frame["node"].to_numpy(), sets, np.flatnonzero(side & 1), np.flatnonzero(side & 2), sketch, sure)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _star_check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["set"], b["pivot_set"], strict=True)]
        yield b.loc[ok, ["pivot", "node"]]


def candidates(nodes: DataFrame, sure: float = SURE) -> DataFrame:
    """(pivot, node): the members of every cluster, each pivot a member of its own."""
    entries = nodes.select("node", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    e = entries.join(shared, "value")
    node = Window.partitionBy("node")
    own = F.col("k") - F.count("*").over(node)
    e = e.withColumn("own", own).withColumn("rank", F.row_number().over(node.orderBy("df", "value")))
    shared = F.greatest(F.lit(1), F.floor(F.col("k") * sure))
    e = e.where(F.col("rank") + F.col("own") <= F.col("k") - shared + 1).select("value", "node", "own")
    lists = e.groupBy("value").agg(F.min(F.struct("own", "node")).alias("p"), F.count("*").alias("size")).where("size > 1").select("value", F.col("p.node").alias("pivot"))
    return e.join(lists, "value").select("pivot", "node").distinct()


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link."""
    e = ws.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links0")
    state, step = None, 0
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(large.where("u <> v").distinct(), f"large{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        new = ws.save(small.where("u <> v").distinct(), f"links{step + 1}")
        ws.drop(f"large{step}", f"links{step}")
        e, step = new, step + 1
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        state = tuple(now)


def links(docs: DataFrame, nodes: DataFrame, ws: Workspace, text_col: str, size: int, max_broadcast: int, sketch: int = SKETCH, sure: float = SURE) -> DataFrame:
    """(a, b): verified links that span every component."""
    members = ws.save(candidates(nodes, sure), "members")
    wanted = ws.save(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", "rep", "n"), "wanted")
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= max_broadcast else ids
    again = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text").mapInPandas(_sets(size), "digest string, set binary")
    sets = ws.save(wanted.join(again, "digest").dropDuplicates(["node"]).select("node", "n", "set"), "sets")

    m = members.join(wanted.select("node", "n"), "node")
    sizes = m.groupBy("pivot").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    sizes = ws.save(sizes.where("members > 1").withColumn("blocks", F.ceil(F.greatest(F.col("members") / BLOCK_NODES, F.col("shingles") / BLOCK_SHINGLES)).cast("int")), "sizes")
    whole = members.join(sizes.where("blocks = 1").select("pivot"), "pivot").select("pivot", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.lit(3).alias("side"))

    large = members.join(sizes.where("blocks > 1").select("pivot", "blocks"), "pivot")
    with_sets = large.where("node <> pivot").join(sets.select("node", "set"), "node")
    pivots = sizes.where("blocks > 1").select("pivot", F.col("members").alias("n"))
    pivot_sets = pivots.select(F.col("pivot").alias("node")).join(sets.select("node", F.col("set").alias("pivot_set")), "node").withColumnRenamed("node", "pivot")
    with_sets = join_salted(with_sets, pivot_sets, "pivot", pivots, pivots.agg(F.sum("n")).first()[0] or 0, F.xxhash64("node"))
    star = ws.save(with_sets.select("pivot", "node", "set", "pivot_set").mapInPandas(_star_check, "pivot long, node long"), "star")
    rest = ws.save(large.where("node <> pivot").join(star, ["pivot", "node"], "left_anti"), "rest")
    left_blocks = rest.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("left_blocks")).join(sizes.select("pivot", "blocks"), "pivot").withColumn("left_blocks", F.least("blocks", F.greatest("left_blocks", F.lit(1))))
    lb = left_blocks.select("pivot", "left_blocks")
    rnd = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    left = rest.join(lb, "pivot").select("pivot", (rnd % F.col("left_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", F.lit(1).alias("side"))
    right = large.join(lb, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), (rnd % F.col("blocks")).cast("int").alias("j"), "node", F.lit(2).alias("side"))
    blocks = whole.unionByName(left).unionByName(right).join(sets.select("node", "set"), "node")
    found = blocks.groupBy("pivot", "i", "j").applyInArrow(_compare(sketch, sure), "a long, b long")
    return found.union(star.select(F.col("pivot").alias("a"), F.col("node").alias("b")))


def classes(df: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", size: int = 5, max_broadcast: int = 1_000_000, sketch: int = SKETCH, sure: float = SURE) -> DataFrame:
    """Per row of ``df``: rid, doc_id, d64 (a hash of the text), n_shingles, component_id, kept; with ``sketch=0`` no link is missed."""
    sure = sure if sketch else LINK[0] / LINK[1]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("d64"), "text")
    d = ws.save(rows.mapInPandas(_sketches(size, sketch), f"rid long, doc_id {id_type}, d64 long, n long, digest string, sketch array<long>"), "sketches")
    nodes = ws.save(d.where("n > 0").groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    roots = components(ws.save(links(docs, nodes, ws, "text", size, max_broadcast, sketch, sure), "links"), ws)
    ws.drop("sets", "members", "star", "rest", "sizes", "wanted")
    of = nodes.select("digest", "node", "rep").join(roots, "node").select("digest", "rep", "root")
    of = of.join(of.groupBy("root").agg(F.min("rep").alias("c")), "root").select("digest", "c")
    named = nodes.select("digest", "rep").join(of, "digest", "left").select("digest", F.coalesce("c", "rep").alias("component_id"))
    named = ws.save(named, "classes")
    ws.drop("nodes", "links")
    out = d.select("rid", "doc_id", "d64", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left").drop("digest")
    own = F.col("n_shingles") == 0
    return out.withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("component_id"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(df: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 2_000_000, **kw) -> DataFrame:
    """The rows of ``df`` that stay, one per component; rows of one id and one text stay or go together."""
    name, d64 = free_name(df, "__id"), free_name(df, "__d64")
    gone = classes(df, ws, id_col=id_col, text_col=text_col, **kw).where(~F.col("kept"))
    gone = ws.save(gone.select(F.col("doc_id").alias(name), F.col("d64").alias(d64)).distinct(), "gone")
    small = gone.count() <= max_broadcast
    return df.join(F.broadcast(gone) if small else gone, F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(d64)), "left_anti")


def op9_near_dedup(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"), Workspace(spark)).select("doc_id", "n_shingles", "component_id", "kept")


# All pairs that share a shingle, on full sets, and every id that reaches a document through links.
OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.doc_id WHERE c.root < e.y),
m AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
