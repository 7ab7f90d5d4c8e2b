"""Exact dedup, decontamination, licences and mixing against plain Python, with nulls, repeats and clashing columns."""

import hashlib
import re
from importlib import resources

import pytest
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, exact_dedup, licenses, mix
from lexmill.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def ws(spark):
    w = Workspace(spark)
    yield w
    w.close()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "x" * 50_000, None), (4, "same text", "b"), (5, "same text", "b"), (6, "Same text", "b"), (None, "same text", "c"), (7, "unique", "c"), (7, "unique", "c")]


def test_exact_dedup_decisions(spark, ws):
    got = sorted(map(tuple, exact_dedup.decisions(docs(spark, ODD), ws).collect()), key=str)
    want = []
    for i, t, _ in ODD:
        group = [j for j, u, _ in ODD if (u or "") == (t or "")]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("limit", [1, 32 << 20])
def test_exact_dedup_rows_and_small_filter(spark, ws, limit):
    d = docs(spark, [(i, f"t{i % 300}", "s") for i in range(900)]).withColumn("__digest", F.lit(1)).withColumn("__MAYBE", F.lit(2))
    out = exact_dedup.exact_dedup(d, ws, max_filter_bytes=limit)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(600, 900))


def test_exact_dedup_with_several_filters(spark, ws):
    rows = [(i, f"t{i % 700}" if i % 3 else "hot", "s") for i in range(3000)]
    want = sorted(map(tuple, exact_dedup.decisions(docs(spark, rows), ws).collect()))
    got = sorted(map(tuple, exact_dedup.decisions(docs(spark, rows), Workspace(spark), bits_per_row=40, max_filter_bytes=4096).collect()))
    assert got == want and exact_dedup.cells_for(3000, 40, 4096) == (30000, 4)


def test_exact_dedup_lets_other_rows_pass(spark, ws):
    rows = [(i, f"text {i}", "s") for i in range(4000)] + [(5000 + i, "twice", "s") for i in range(50)]
    d = docs(spark, rows).select("doc_id", exact_dedup.text_digest(F.col("text")).alias("h"))
    cells, _ = exact_dedup.cells_for(4050, 16, 1 << 20)
    flagged = exact_dedup.maybe_repeated(d, "h", exact_dedup.repeated_cells(d, "h", cells), cells, "maybe").where("maybe")
    assert flagged.where("doc_id >= 5000").count() == 50 and flagged.count() < 50 + 4000 * 0.1


@pytest.mark.parametrize("many", [0, 100])
def test_exact_dedup_of_repeated_rows(spark, ws, many):
    rows = [(1, "a", "s"), (1, "a", "s"), (2, "a", "s"), (2, "a", "s"), (3, "b", "s"), (None, "c", "s"), (None, "c", "s"), (4, None, "s"), (5, "", "s")]
    out = exact_dedup.exact_dedup(docs(spark, rows), ws, max_broadcast=many)
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([(2, "a"), (3, "b"), (None, "c"), (5, "")], key=str)


def test_exact_dedup_empty(spark, ws):
    assert exact_dedup.decisions(docs(spark, []), ws).count() == 0
    assert exact_dedup.exact_dedup(docs(spark, ODD), ws).count() == 5


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, bench, n=13):
    out = []
    for i, t, _ in rows:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            bw = words(b)
            m = min(n, len(bw))
            grams = {tuple(bw[k : k + m]) for k in range(len(bw) - m + 1)} if m else set()
            for p in range(len(w) - m + 1 if m else 0):
                if tuple(w[p : p + m]) in grams:
                    hit.update(range(p, p + m))
                    items.add(item)
        ids = ",".join(sorted(str(x) for x in items))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(40))
BENCH = [(10, LONG), (2, "Short ITEM"), (3, None), (4, "!!"), (5, "École é única"), (2, "Short ITEM")]
TEXTS = [
    (1, "before " + " ".join(f"W{i}," for i in range(5, 25)) + " after", "s"), (2, "a short item here", "s"), (3, None, "s"), (4, "", "s"), (5, "short, ITEM", "s"),
    (6, "nothing to see " * 400, "s"), (7, " ".join(f"w{i}" for i in range(12)), "s"), (8, "École É ÚNICA; École é única" + " fill" * 30, "s"), (5, "short item", "s"), (9, ("filler " * 500) + LONG, "s"),
]


@pytest.mark.parametrize("many", [100_000, 1])
def test_decontamination_report(spark, ws, many):
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.report(docs(spark, TEXTS), b, ws, max_broadcast=many)
    assert sorted(map(tuple, got.collect()), key=str) == brute(TEXTS, BENCH)


def test_decontamination_empty_tables(spark, ws):
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.report(docs(spark, []), b, ws).count() == 0
    none = decontaminate.report(docs(spark, TEXTS), b.where("false"), ws).collect()
    assert len(none) == len(TEXTS) and not any(r.contaminated or r.n_items for r in none)


def test_decontamination_drops_and_cuts(spark, ws):
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = [t for t in TEXTS if t[0] != 5]
    d = docs(spark, rows).withColumn("__bad", F.lit(1))
    bad = {r[0] for r in brute(rows, BENCH) if r[5]}
    for many in (0, 10):
        assert {r.doc_id for r in decontaminate.drop_contaminated(d, b, ws, max_marks=many).collect()} == {t[0] for t in rows} - bad
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b, ws).collect()}
    assert cut[2] == "a   here" and cut[3] is None and cut[6] == TEXTS[5][1]
    assert "w20" not in cut[9] and cut[9].startswith("filler filler")


def test_spans_are_cut_from_their_own_row(spark, ws):
    b = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "clean words only", "s"), (1, "see alpha beta gamma delta", "s"), (None, "Alpha beta, gamma delta!", "s"), (None, "clean", "s"), (None, None, "s"), (2, "", "s"), (1, "clean words only", "s")]
    for many in (0, 10):
        out = decontaminate.remove_spans(docs(spark, rows), b, Workspace(spark), max_marks=many)
        assert sorted([r.text for r in out.collect()], key=str) == sorted(["clean words only", "see    ", " ,  !", "clean", None, "", "clean words only"], key=str)
    assert decontaminate.remove_spans(docs(spark, []), b, ws).count() == 0
    assert decontaminate.drop_contaminated(docs(spark, []), b, ws).count() == 0


@pytest.mark.parametrize("many", [100_000, 1])
def test_decontamination_of_very_long_texts(spark, ws, many):
    long = " ".join(f"v{i % 977}" for i in range(60_000))
    inside = long.split()
    item = " ".join(f"k{i}" for i in range(300))
    rows = [(1, long, "s"), (2, " ".join([*inside[:59_000], item, *inside]), "s"), (3, item, "s"), (4, " ".join(f"k{i}" for i in range(3, 16)), "s")]
    bench = [(7, item), (8, "v976 v0 v1 v2"), (9, "k3")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.report(docs(spark, rows), b, ws, max_broadcast=many)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, bench)


def test_license_scan(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.KNOWN["MIT"].upper().replace("SUBLICENSE", "sub-licence").replace("\n", "\n   ")
    rows = [(1, mit, "s"), (2, "Intro\nLicensed under the Apache Licence, version 2.0\nend", "s"), (3, None, "s"), (4, "", "s"), (5, licenses.KNOWN["MIT"][:-40], "s"), (6, licenses.KNOWN["ISC"], "s"), (6, licenses.KNOWN["ISC"], "s")]
    known = licenses.known_licenses(spark)
    for many in (100_000, 0):
        got = sorted((r.doc_id, r.license_id, r.notices) for r in licenses.scan(docs(spark, rows), known, max_broadcast=many).collect())
        assert got == sorted([(1, "MIT", ""), (2, None, "Apache-2.0-notice"), (3, None, ""), (4, None, ""), (5, None, ""), (6, "ISC", ""), (6, "ISC", "")], key=str)
    assert licenses.scan(docs(spark, []), known).count() == 0
    assert licenses.scan(docs(spark, rows), known.where("false")).where("license_id is not null").count() == 0


def test_license_spellings_of_neighbours(spark):
    texts = ["The licence licence is licenced", "a sub-licence sub licence of organisation organisation", "favour", "licences"]
    d = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = [r.c for r in d.orderBy("doc_id").select(licenses.canonical(F.col("text")).alias("c")).collect()]
    assert got == ["the license license is licensed", "a sublicense sublicense of organization organization", "favor", "licences"]


def test_license_scan_with_clashing_columns(spark):
    d = docs(spark, [(1, licenses.KNOWN["MIT"], "s"), (2, "words\nAll rights reserved.", "s"), (3, "x " * 100_000, "s")])
    for c in ("k", "t", "lines", "license_id", "notices", "canon_sha256"):
        d = d.withColumn(c, F.lit("clash"))
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(d, licenses.known_licenses(spark)).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "All-rights-reserved-notice"), 3: (None, "")}


def test_license_scan_digests_every_line(spark):
    one_line = [(n, " ".join(licenses.KNOWN[n].split())) for n in ("ISC", "0BSD", "Zlib", "BSD-2-Clause")]
    assert all(not re.search("licen[cs]e", t.lower()) for n, t in one_line)
    rows = [(i, f"some words\n{t}\nothers", "s") for i, (_, t) in enumerate(one_line)]
    for many in (100_000, 0):
        got = {r.doc_id: r.notices for r in licenses.scan(docs(spark, rows), licenses.known_licenses(spark), max_broadcast=many).collect()}
        assert got == {i: n for i, (n, _) in enumerate(one_line)}


def test_license_scan_knows_published_files_and_usual_notices(spark):
    files = resources.files("lexmill.llm").joinpath("license_texts")
    text = {n: files.joinpath(f"{n}.txt").read_text("utf-8") for n in licenses.FILES}
    reflowed = "\n\n".join(" ".join(p.split()) for p in text["GPL-3.0"].split("\n\n"))
    rows = [*text.items(), ("GPL-3.0", reflowed), ("Apache-2.0", text["Apache-2.0"].split("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n")]
    for name, title in (("MIT", "MIT License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License")):
        body = licenses.KNOWN[name]
        rows += [(name, f"{title}\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{body}"), (name, f"{title}\n\nCopyright (c) 2020 Someone\n\n{body}"), (name, body)]
    notices = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Mozilla Public License, v. 2.0.": "MPL-2.0", "This project is licensed under the MIT licence.": "MIT", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1"}
    rows += [(None, f"some words\n{t}\nothers") for t in notices]
    rows += [(None, "some words\nLicensed under terms of our own.\nothers")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [(i, t, "s") for i, (_, t) in enumerate(rows)]), licenses.known_licenses(spark)).collect()}
    of = lambda x: x and re.sub(r"(-notice)?(-\d+)?$", "", x)
    assert [(i, n, got[i].license_id) for i, (n, _) in enumerate(rows) if of(got[i].license_id) != n] == []
    assert [of(got[len(rows) - len(notices) - 1 + i].notices) for i in range(len(notices))] == list(notices.values()) and got[len(rows) - 1].notices == ""


def waterfill(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    t, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        for s in free:
            t[s] = rest * w[s] / sum(w[x] for x in free)
        over = {s for s in free if t[s] > cap * sizes[s]}
        if not over:
            break
        capped |= over
        for s in capped:
            t[s] = cap * sizes[s]
        if len(capped) == len(names):
            break
    return t


def test_mix_targets_and_taken(spark, ws):
    rows = [(i, "word " * (i % 17 + 1), f"src{i % 7}") for i in range(700)] + [(1000 + i, "a b c", None) for i in range(5)] + [(2000, None, "empty"), (2001, "", "empty"), (2002, "tiny", "aaa")]
    got = mix.plan(docs(spark, rows), ws).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = waterfill(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 9 for s in sizes)
    again = mix.plan(docs(spark, rows[::-1]).repartition(3), Workspace(spark), buckets=4, rows_per_task=5, max_broadcast=0)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_cuts_a_source_of_one_weight(spark, ws):
    # digits only: every document has the least quality, so all keys are large
    rows = [(i, " ".join(str(i * 7 + k) for k in range(i % 5 + 1)), "hot" if i % 10 else f"s{i % 3}") for i in range(4000)] + [(9, "1 2 3", "twin")] * 400 + [(i, "1 2 3 4", "a") for i in range(5000, 6000)]
    d = docs(spark, rows)
    want = {(r.doc_id, r.source, r.digest): r.taken for r in mix.plan(d, ws).collect()}
    few = Workspace(spark)
    got = {(r.doc_id, r.source, r.digest): r.taken for r in mix.plan(d, few, buckets=16, rows_per_task=8).collect()}
    assert {k: v for k, v in got.items() if k[1] != "twin"} == {k: v for k, v in want.items() if k[1] != "twin"}
    last = max(int(p) for p in range(9) if _exists(spark, few.path(f"cut{p}")))
    assert spark.read.parquet(few.path(f"cut{last}")).groupBy("source").count().agg(F.max("count")).first()[0] <= 8
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target, taken = waterfill(sizes), {}
    for r in mix.mix(d, Workspace(spark), rows_per_task=8).collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken.get(s, 0) - target[s]) <= 5 for s in sizes)


def _exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_mix_takes_repeated_and_null_ids_as_planned(spark, ws):
    rows = [(None if i % 4 == 0 else i % 6, f"some words of {i // 3}", f"s{i % 2}") for i in range(60)] + [(1, "the same text", "s0")] * 5 + [(None, "the same text", "s1")] * 4
    want, p = {}, mix.plan(docs(spark, rows), ws).collect()
    text = {hashlib.md5(t.encode()).hexdigest(): t for _, t, _ in rows}
    for r in p:
        k = (r.doc_id, r.source, text[r.digest])
        want[k] = want.get(k, 0) + r.times
    got = {(r.doc_id, r.source, r.text): r.n for r in mix.mix(docs(spark, rows), Workspace(spark)).groupBy("doc_id", "source", "text").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_drop_contaminated_with_null_and_repeated_ids(spark, ws):
    bench = " ".join(f"w{i}" for i in range(20))
    b = spark.createDataFrame([(1, bench)], "item_id long, text string")
    rows = [(None, bench, "s"), (None, "clean words", "s"), (None, None, "s"), (1, bench, "s"), (1, "other clean words", "s"), (2, "more", "s")]
    out = decontaminate.drop_contaminated(docs(spark, rows), b, ws)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(i, t) for i, t, _ in rows if t != bench], key=str)


def test_mix_rows_and_empty(spark, ws):
    rows = [(i, f"some words {i}", f"s{i % 3}") for i in range(60)]
    d = docs(spark, rows).withColumn("__times", F.lit(0))
    p = {r.doc_id: r.times for r in mix.plan(d, ws).collect()}
    out = mix.mix(d, Workspace(spark))
    assert out.columns == d.columns
    counts = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: v for k, v in p.items() if v}
    assert mix.plan(docs(spark, []), Workspace(spark)).count() == 0
    assert mix.plan(docs(spark, [(1, None, "a"), (2, "", None)]), Workspace(spark)).agg(F.sum("taken")).first()[0] == 0
