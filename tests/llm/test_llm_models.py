"""Quality and toxicity models: gradients, held-out accuracy, edge cases; the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bigru, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_gradients():
    grams = np.unique(bigru.gram_hashes(["abcd", "abab"])[0])
    net = bigru.new_net({"a": 0, "b": 1, "cd": 2}, np.array([0.1, 0.2, 0.3]), grams, np.ones(len(grams)))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    lookup = net.lookup(["a", "b", "abcd", "abab", "zz"])
    at, n, y = np.random.default_rng(0).integers(0, 5, (3, bigru.WINDOW)), np.array([5, 64, 20]), np.array([1.0, 0, 1])

    def loss():
        z = bigru.forward(net, net.projected(net.inputs(*lookup)), at, n)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = bigru.gradients(net, net.inputs(*lookup), lookup, at, n, y, np.ones(3))
    for k, p in net.p.items():
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        p[i] += 1e-3
        up = loss()
        p[i] -= 2e-3
        down = loss()
        p[i] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-4, k


def test_windows_cover_all_words():
    lens = np.array([0, 1, 64, 65, 112, 113, 1000])
    of, start, n = bigru.windows_of(lens)
    for i, m in enumerate(lens):
        covered = {w for s, k in zip(start[of == i], n[of == i], strict=True) for w in range(s, s + k)}
        assert covered == set(range(m)) and (of == i).sum() >= 1


def invented(seed, n):
    r = random.Random(seed)
    vocab = ["w" + "".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out = []
    for i in range(n):
        t = [r.choice(vocab) for _ in range(r.randrange(5, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                t.insert(r.randrange(len(t)), r.choice(["grumpzor", "Grumpzel!", "flumpo"]))
        out.append((" ".join(t), int(bad)))
    return out


def test_toxicity_held_out():
    rows = invented(1, 400)
    net = toxicity.learn([t for t, _ in rows[:280]], np.array([y for _, y in rows[:280]]))
    s = toxicity.Scorer(net).scores([t for t, _ in rows[280:]])
    y = np.array([y for _, y in rows[280:]])
    assert ((s >= 0.5) == (y == 1)).mean() > 0.95
    long = " ".join(["wabcde"] * 3000 + ["grumpzor", "flumpo"] + ["wabcde"] * 3000)
    a, b, c, d = toxicity.Scorer(net).scores([None, "", "?!", long])
    assert 0 <= a == b == c < 0.5 <= d
    assert np.array_equal(toxicity.Scorer(net).scores([rows[0][0]] * 3), np.repeat(toxicity.Scorer(net).scores([rows[0][0]]), 3))


def test_models_without_both_classes():
    net = toxicity.learn(["a b", "c d"], np.array([0, 0]))
    assert (toxicity.Scorer(net).scores(["a b", None]) < 0.01).all()
    m = quality.learn(np.ones((3, len(quality.vector_names()))), np.array([1, 1, 1]))
    assert m.threshold == 0 and not any(m.weights)


def test_held_out_accuracy_on_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for op, label, floor in ((quality.op8_quality, "quality", 0.95), (toxicity.op7_toxicity, "toxic", 0.9)):
        out = op(spark, SF)
        assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
        rows = out.join(labels, "doc_id").collect()
        cut, mod, held = (0.7, 4, 2) if label == "quality" else (0.5, 5, 0)
        for r in rows:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held)
        h = [r for r in rows if r.held_out]
        assert sum(r.predicted == r[label] for r in h) / len(h) > floor


def test_toxicity_finds_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    h = toxicity.op7_toxicity(spark, SF).where("held_out").join(labels.where("toxic IN (0, 1)"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in h)
    assert hit >= 0.8 * sum(r.toxic for r in h) and hit >= 0.6 * sum(r.predicted for r in h)


def test_toxic_passages_are_found_at_every_offset():
    rows = invented(1, 400)
    scorer = toxicity.Scorer(toxicity.learn([t for t, _ in rows], np.array([y for _, y in rows])))
    cue = ["grumpzor"] + ["w" + "abcdefgh"[i % 8] * 5 for i in range(20)] + ["flumpo"]
    texts = [" ".join(["wabcde"] * i + cue + ["wabcde"] * (200 - i)) for i in range(130)]
    assert (scorer.scores(texts) >= 0.5).all()


def test_toxicity_edges(spark):
    rows = invented(3, 120)
    net = toxicity.learn([t for t, _ in rows], np.array([y for _, y in rows]))
    d = spark.createDataFrame([(1, None), (1, ""), (2, "grumpzor flumpo"), (2, "grumpzor flumpo"), (None, "x " * 50_000)], "doc_id long, text string").withColumn("SCORE", F.lit("clash")).withColumn("predicted", F.lit("clash"))
    out = toxicity.scores(d, net)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = out.collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert abs(got[0].score - got[1].score) < 1e-6 and abs(got[2].score - got[3].score) < 1e-6
    assert toxicity.scores(d.where("false"), net).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.scores(empty, none).count() == 0 and toxicity.Scorer(none).scores(["a", None]).max() < 0.01


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "Plain words stand here. And more of them follow.\nThen it ends."), (4, " | ".join(["thndou", "erhaha", "eaernd", "ertible", "eronin"] * 12)), (5, "x " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("n_words", F.lit(0))
    m = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    out = {r.doc_id: r for r in quality.scores(d, m).collect()}
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out.values())
    assert out[3].predicted == 1 and out[4].predicted == 0 and out[5].predicted == 0
    kept = quality.filter_quality(d, m)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}
    assert quality.scores(d.where("false"), m).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(d, empty).threshold == 0


def test_quality_threshold_covers_all_labels(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    # labels that the text says little of, so that samples differ
    labels = d.select("doc_id", (F.crc32(F.md5(F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int").alias("quality"))
    rows = quality.with_counts(d.join(labels, "doc_id").where(quality.remainder(F.col("doc_id"), 4) != 2), "text", F.col("quality").alias("y")).select("y", *quality.vector()).toPandas()
    y, x = rows["y"].to_numpy(), rows.drop(columns="y").to_numpy(float)
    bad = int((y == 0).sum())
    for most in (len(y) // 4, len(y) // 2, 20_000):
        m = quality.fit(d, labels, max_labels=most)
        s = np.sort(m.strength(x))
        assert s[bad - 1] - 1e-9 <= m.threshold <= s[bad] + 1e-9
