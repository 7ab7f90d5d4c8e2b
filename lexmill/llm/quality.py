"""Quality scores by Bradley-Terry pairwise ranking.

A document has a strength w . f over features of its whole text; that it is
preferred to another has probability sigmoid(w . (f1 - f2)). The weights are
learnt by logistic loss on feature differences of (good, bad) pairs. The
threshold is the quantile of strengths that leaves the share of bad documents
below it, over all rows that may be learnt from, and scores are scaled so that
it scores 0.7.

Learning reads at most ``max_labels`` labelled rows (taken in order of a hash
of their id) and makes at most ``max_pairs`` pairs of them, on the driver. With
more labels than that, the threshold is one distributed aggregate over them.
Features are counted on Arrow batches of whole texts, by byte and list
operations that need no regular expression; scores are DataFrame functions.

Edge cases: null and empty texts have all features 0. Labels other than 0 and
1 and labels without a document are left out; of a doc_id labelled twice, both
rows count. Without both classes all weights are 0 and every score is 0.7.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexmill.llm.common import table

THRESHOLD = 0.7
#: One in so many rows is the error in rank of a threshold over more labels than are learnt from.
ACCURACY = 100_000
#: What is counted in a text; each count gives its rate a word and the log of one more than it.
COUNTS = ("columns", "symbols", "shouts", "capitals", "repeats", "figures", "sentences")
NAMES = (*(f"n_{k}" for k in COUNTS), "n_words", "n_chars")
FEATURES = StructType([StructField(k, DoubleType()) for k in NAMES])
SYMBOLS, FIGURES, CAPITALS = b"$%&#*@^~=+<>{}\\", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def remainder(id_col: Column, mod: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % mod


def counts(text: str | None) -> tuple[int, ...]:
    """The values of NAMES: lone bars, symbols, !!, capitals, words said twice, digits, sentence ends, words, bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    size = len(raw)
    gone = lambda chars: size - len(raw.translate(None, chars))
    return words.count(b"|"), gone(SYMBOLS), raw.count(b"!!"), gone(CAPITALS), sum(map(operator.eq, words, islice(words, 1, None))), gone(FIGURES), gone(b".?"), len(words), size


@F.pandas_udf(FEATURES)
def text_counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts(t) for t in texts], columns=list(NAMES), dtype=float)


def with_counts(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """The kept columns and the counts by name."""
    d = docs.select(*keep, text_counts(F.col(text_col)).alias("__f"))
    return d.select(*[c for c in d.columns if c != "__f"], "__f.*")


def vector() -> list[Column]:
    """The model's inputs, from the counts by name."""
    words = F.greatest(F.col("n_words"), F.lit(1.0))
    out = []
    for k in COUNTS:
        out += [F.col(f"n_{k}") / words, F.log1p(F.col(f"n_{k}"))]
    return [*out, F.col("n_chars") / words / 10, F.log1p(F.col("n_words"))]


@dataclass
class Model:
    weights: list[float]
    means: list[float]
    scales: list[float]
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.means) / self.scales) @ np.asarray(self.weights)

    def strength_column(self) -> Column:
        """The strength, from the counts by name."""
        s = F.lit(0.0)
        for w, m, d, v in zip(self.weights, self.means, self.scales, vector(), strict=True):
            s = s + (v - F.lit(float(m))) / F.lit(float(d)) * F.lit(float(w))
        return s

    def score(self) -> Column:
        """The score, from the counts by name; in (0, 1), 0.7 at the threshold."""
        z = self.strength_column() - F.lit(self.threshold) + F.lit(float(np.log(THRESHOLD / (1 - THRESHOLD))))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def learn(x: np.ndarray, y: np.ndarray, max_pairs: int = 40_000, l2: float = 0.003, rounds: int = 25, seed: int = 11) -> Model:
    """Newton steps on the pairs' logistic loss."""
    k = len(vector_names())
    if not len(y) or y.min() == y.max():
        return Model([0.0] * k, [0.0] * k, [1.0] * k, 0.0)
    means, scales = x.mean(0), x.std(0)
    scales[scales < 1e-9] = 1.0
    z = (x - means) / scales
    good, bad = z[y == 1], z[y == 0]
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    d = good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]
    w = np.zeros(k)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) / n - l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + l2 * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
    s = np.sort(z @ w)
    n_bad = int((y == 0).sum())
    return Model(w.tolist(), means.tolist(), scales.tolist(), float((s[n_bad - 1] + s[n_bad]) / 2))


def vector_names() -> list[str]:
    return [*(f"{k}_{x}" for k in COUNTS for x in ("rate", "log")), "word_length", "words"]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 4, held: int = 2, max_labels: int = 20_000, **kw) -> Model:
    """Learns weights from at most ``max_labels`` labelled rows whose remainder is not ``held``, the threshold from all of them."""
    use = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    every = use.where(remainder(F.col("id"), mod) != held)
    use = every.orderBy(F.xxhash64("id"), "id", "y").limit(max_labels)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(use), F.col("doc_id") == F.col("id"))
    rows = with_counts(d, "text", F.col("y")).select("y", *[v.alias(f"x{i}") for i, v in enumerate(vector())]).toPandas().sort_values(["y", *(f"x{i}" for i in range(len(vector_names())))])
    model = learn(rows.drop(columns="y").to_numpy(float), rows["y"].to_numpy(int), **kw)
    if not any(model.weights) or every.limit(max_labels + 1).count() <= max_labels:
        return model
    return replace(model, threshold=threshold(docs, every, model, id_col, text_col))


def threshold(docs: DataFrame, labels: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> float:
    """The strength that leaves the share of bad rows below it, over all of ``labels`` (id, y) with a document.

    Its rank is off by at most one row in ``ACCURACY``. Strengths are shuffled, texts are not.
    """
    n, bad = labels.join(docs.select(F.col(id_col).alias("doc_id")), F.col("doc_id") == F.col("id")).agg(F.count("*"), F.count_if(F.col("y") == 0)).first()
    strengths = with_counts(docs, text_col, F.col(id_col).alias("doc_id")).select("doc_id", model.strength_column().alias("s"))
    both = F.percentile_approx("s", [bad / n, min(1.0, (bad + 1) / n)], ACCURACY)
    return float(sum(strengths.join(labels, F.col("doc_id") == F.col("id")).agg(both).first()[0]) / 2)


def scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns score and predicted; its own columns of these names are replaced."""
    s = with_counts(docs, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("row")).select("row", model.score().alias("score"))
    keep = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("score", "predicted")]
    return s.select(*keep, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` at or above the threshold."""
    s = with_counts(docs, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return s.where(model.score() >= THRESHOLD).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
