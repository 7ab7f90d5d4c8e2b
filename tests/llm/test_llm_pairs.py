"""Near duplicates and line dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import line_dedup, near_dedup
from lexmill.llm.common import Workspace
from lexmill.llm.shingles import SKETCH


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out)


def corpus(seed, n_groups, size, words):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(4000)
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for g in range(n_groups):
        base = [word() for _ in range(words)]
        for _ in range(size if g else size * 8):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4, 5, 6])):
                k = r.randrange(len(t))
                t[k : k + r.choice([0, 1])] = [word()]
            rows.append((i, " ".join(t)))
            i += 1
    for _ in range(40):  # a passage that many otherwise different texts share
        k = r.choice([0, 5, 12, 20, 100])
        rows.append((i, " ".join([word() for _ in range(k)] + passage)))
        i += 1
    for t in (None, "", "  \t\n", "one two", "One  TWO", "a b c d e", "a b c d f", "x " * 500, "x " * 900):
        rows.append((i, t))
        i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [8, 256])
def test_near_dedup_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", blocks)
    rows = corpus(blocks, 12, 9, 120)
    ws = Workspace(spark)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.classes(d, ws).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_classes(rows)
    ws.close()


def test_near_dedup_exact_way_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    rows = corpus(5, 8, 7, 90)
    ws = Workspace(spark)
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), ws, sketch=0).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_classes(rows)
    ws.close()


def test_near_dedup_recall_just_above_the_threshold(spark):
    r = random.Random(4)
    rows, pairs = [], 0
    while pairs < 600:
        base = [f"p{pairs}w{i}" for i in range(r.choice([60, 150, 400]))]
        other, kind = list(base), r.randrange(2)
        if kind:  # one contains the other
            other += [f"p{pairs}x{i}" for i in range(r.randrange(len(base) // 2))]
        else:
            for i in r.sample(range(len(base)), max(1, len(base) // 36)):
                other[i] = f"p{pairs}y{i}"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if 0.75 <= len(a & b) / len(a | b) < 0.80:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark)).collect()
    assert {r.doc_id for r in got if r.component_id != r.doc_id} == set(range(1, 2 * pairs, 2))


def test_near_dedup_of_very_long_texts(spark):
    long = " ".join(f"w{i % 9973}z{i // 9973}" for i in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, " ".join(long.split()[30_000:])), (4, "tail")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark)).collect()}
    assert got == {1: (59_996, 1), 2: (59_997, 1), 3: (29_996, 3), 4: (1, 4)}


def test_near_dedup_rows_and_edges(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, ""), (9, "other words are here now"), (9, "other words are here now")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__id", F.lit(1)).withColumn("digest", F.lit("x"))
    ws = Workspace(spark)
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.classes(d, ws).collect()}
    assert got == {(5, 3, False), (3, 3, True), (None, 3, False), (None, None, True), (9, 9, True)}
    out = near_dedup.near_dedup(d.where("doc_id is not null"), Workspace(spark))
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {3, 9}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.classes(empty, Workspace(spark)).count() == 0


def test_near_dedup_drops_rows_not_ids(spark):
    rows = [(3, "a b c d e f"), (None, "a b c d e f"), (None, "clean words of another text here"), (None, None), (8, "A b c d e f"), (8, "one more text that nobody else has")]
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)


def test_links_are_kept_whatever_their_union_estimate():
    # 23 of the union's 48 smallest are shared, 77 of 100 in all
    low, high = np.arange(48, dtype=np.uint64), np.arange(100, 154, dtype=np.uint64)
    a, b = np.concatenate([low[:36], high]), np.concatenate([low[:23], low[36:], high])
    assert near_dedup.linked(a, b) and near_dedup.union_estimate(a[:SKETCH], b[:SKETCH]) < 0.5
    assert near_dedup.block_links(np.array([7, 8]), [a, b], np.array([0, 1]), np.array([0, 1])) == [(7, 8)]


def test_union_estimate_is_near_the_truth():
    r = np.random.default_rng(3)
    for j in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(60):
            u = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
            side = r.random(len(u))
            a, b = np.sort(u[side < j + (1 - j) / 2]), np.sort(u[(side < j) | (side >= j + (1 - j) / 2)])
            errors.append(near_dedup.union_estimate(a[:SKETCH], b[:SKETCH]) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.04


def brute_lines(rows, least):
    """Lines covered by a run of at least ``least`` words that also starts earlier, by definition."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], []
    for d, t in order:
        lines = [(n, x) for n, x in enumerate((t or "").split("\n")) if x.split()]
        gone = set()
        for s in range(len(lines)):
            best = 0
            for other, k in [*seen, *((lines, k) for k in range(s))]:
                m = 0
                while s + m < len(lines) and k + m < len(other) and lines[s + m][1] == other[k + m][1]:
                    m += 1
                best = max(best, m)
            if sum(len(x.split()) for _, x in lines[s : s + best]) >= least:
                gone.update(n for n, _ in lines[s : s + best])
        seen += [(lines, k) for k in range(len(lines))]
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
        out.append((d, len(gone), kept if t is not None else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 6, 15])
def test_line_dedup_by_definition(spark, least):
    r = random.Random(least)
    line = lambda: " ".join("abc"[r.randrange(3)] for _ in range(r.choice([0, 1, 1, 2, 3, 5])))
    shared = [line() for _ in range(9)]
    rows = []
    for i in range(40):
        body = [line() for _ in range(r.randrange(6))]
        k = r.randrange(9)
        body[1:1] = shared[k : k + r.randrange(9)]
        rows.append((i, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(shared)), (104, "\n".join(shared)), (None, "only here " * 20), (105, "z\n" * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__runs", F.lit(1))
    for many in (1_000_000, 0):
        ws = Workspace(spark)
        out = line_dedup.line_dedup(d, ws, removed_col="gone", min_words=least, max_broadcast=many)
        assert out.columns == ["doc_id", "text", "__runs", "gone"]
        assert sorted(((x.doc_id, x.gone, x.text) for x in out.collect()), key=str) == brute_lines(rows, least)
        ws.close()


def test_line_dedup_repeated_rows_and_empty(spark):
    t = "\n".join(f"line {i} has five words" for i in range(20))
    d = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id, len(r.text)) for r in line_dedup.line_dedup(d, Workspace(spark)).collect())
    assert got == [(1, len(t)), (1, len(t)), (2, 0)]
    assert line_dedup.line_dedup(d.where("false"), Workspace(spark)).count() == 0


def test_suffix_array_and_common_prefixes(spark):
    r = random.Random(8)
    segments = [[r.randrange(2) for _ in range(r.randrange(1, 12))] for _ in range(60)] + [[0] * 9] * 3
    rows = [(seg, i, len(x), c) for seg, x in enumerate(segments) for i, c in enumerate(x)]
    ws = Workspace(spark)
    s = ws.save(spark.createDataFrame(rows, "rid long, i int, end int, rank long"), "s")
    levels, ranks = line_dedup.suffix_array(s, ws, 12)
    got = {(x.rid, x.i): x.rank for x in levels[-1].collect()}
    order = sorted(got, key=lambda k: segments[k[0]][k[1] :])
    by = sorted(got, key=lambda k: got[k])
    assert [segments[a][i:] for a, i in order] == [segments[a][i:] for a, i in by]
    assert len(set(got.values())) == len({tuple(segments[a][i:]) for a, i in got})
    classes = levels[-1].groupBy("rank").agg(F.min(F.struct("rid", "i")).alias("at")).select("rank", "at.rid", "at.i")
    lcp = {x["rank"]: x.lcp for x in line_dedup.common_prefixes(classes, line_dedup.neighbours(ranks), levels, ws).collect()}
    text = {k: segments[a][i:] for (a, i), k in got.items()}
    known = sorted(text)
    for a, b in zip(known, known[1:]):
        n = next((j for j, (x, y) in enumerate(zip(text[a], text[b])) if x != y), min(len(text[a]), len(text[b])))
        assert lcp[b] == n
    assert set(lcp) == set(known[1:])
    ws.close()


def test_line_dedup_of_very_long_texts(spark):
    t = "\n".join(f"line {i % 700} of {i // 350}" for i in range(4000))
    rows = [(1, t), (2, "own line\n" + t + "\nlast line"), (3, "\n".join(f"one {i}" for i in range(5000)))]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark)).collect()}
    assert got == {1: t, 2: "own line\nlast line", 3: rows[2][1]}


def test_shortest_runs():
    f, b = line_dedup.shortest_runs(np.array([3, 4, 1, 9]), 5)
    assert f.tolist() == [2, 2, 2, 1] and b.tolist() == [0, 2, 2, 1]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
