"""From documents to token ids: quality, near duplicates, benchmark passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread before the next stage starts. All but the last return
the columns of ``docs``. A stage may be given the workspace in which it stages
its tables; without one it opens its own, which goes when the driver ends.

Edge cases: decisions are carried back by id and a hash of the text, so rows
of null or repeated ids are judged each by its own text, and rows that repeat
both share a decision: near copies of them all stay or go, and the mix shares
out their takes. Null and empty texts are near copies of nothing, are never
contaminated, and are never mixed in. Ties go to the smallest id. Empty tables
of documents, labels or benchmark items give results as if no document were
there, none bad and none contaminated. Columns of any further name are carried
along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, mix, near_dedup, quality, token_ids
from lexmill.llm.common import Workspace, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, ws: Workspace | None = None) -> DataFrame:
    """Documents that the quality model accepts."""
    return quality.filter_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, ws: Workspace | None = None) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.near_dedup(docs, ws or Workspace(spark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, ws: Workspace | None = None) -> DataFrame:
    """Documents without benchmark passages, by the contract's rule."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), ws or Workspace(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, ws: Workspace | None = None) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mix.mix(docs, ws or Workspace(spark))


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, ws: Workspace | None = None) -> DataFrame:
    """Token ids, written to files and summarised from them."""
    import public_tokenizers

    return token_ids.encoded(docs, ws or Workspace(spark), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", encode_ids),
]

#: The first stage learns a model, which SQL cannot express; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        own = Workspace(spark)
        docs = ws.save(stage(spark, docs, sf_dir, own), name)
        own.close()
        if i:
            ws.drop(STAGES[i - 1][0])
    return docs
