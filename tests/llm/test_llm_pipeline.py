"""The pipeline's stages: on empty tables, odd rows and repeated ids, and the whole of it against its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import quality
from lexmill.llm.common import Workspace

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, docs, labels=(), benchmark=()):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def row(i, t, source="a"):
    return (i, t, "en", source, None if t is None else len(t))


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"v{x}" for x in r.integers(0, 5000, n))


def test_pipeline_on_empty_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [])).count() == 0
    one = tables(spark, tmp_path / "one", [row(1, words(1, 40)), row(2, None), row(3, ""), row(None, words(2, 40), None)])
    got = corpus_pipeline.run(spark, one).collect()
    assert {r.doc_id for r in got} <= {1, None} and len(got) >= 1


def test_stages_carry_odd_rows(spark, tmp_path):
    bench = words(9, 30)
    rows = [row(1, words(1, 60)), row(1, words(2, 60)), row(None, words(3, 60)), row(None, None), row(2, ""), row(3, bench, "b"), row(3, words(4, 60), "b"), row(4, words(1, 60) + " tail", None), row(4, words(5, 60), None), row(5, words(6, 60)), row(5, words(6, 60))]
    sf = tables(spark, tmp_path / "odd", rows, benchmark=[(1, bench)])
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("__id", F.lit(1)).withColumn("rid", F.lit("clash"))
    key = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    texts = [(r[0], r[1]) for r in rows]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, sf)
    assert good.columns == docs.columns and key(good) == sorted(texts, key=str)  # no labels: nothing is bad
    near = stages["near_duplicates"](spark, docs, sf)
    assert near.columns == docs.columns and key(near) == sorted([t for t in texts if t != texts[7]], key=str)
    clean = stages["decontamination"](spark, docs, sf)
    assert clean.columns == docs.columns and key(clean) == sorted([t for t in texts if t != texts[5]], key=str)
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and {t for t in key(mixed)} <= set(texts) - {texts[3], texts[4]}


def test_quality_stage_keeps_what_the_model_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.with_counts(docs, "text", F.col("doc_id")).select("doc_id", *quality.vector()).toPandas()
    z = model.strength(rows.drop(columns="doc_id").to_numpy(float)) - model.threshold
    want = {int(i) for i, s in zip(rows["doc_id"], z, strict=True) if 1 / (1 + np.exp(-(s + np.log(0.7 / 0.3)))) >= 0.7 - 1e-12}
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == want
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(bad - want) >= 0.9 * len(bad)


def test_runs_do_not_share_tables(spark):
    pytest.importorskip("public_tokenizers")
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    ws = Workspace(spark)
    assert ws.root != Workspace(spark).root
