"""Toxicity: a bidirectional GRU with attention over all overlapping windows of a text.

The net is trained in numpy on the driver, on at most ``max_labels`` labelled
rows with texts of at most ``max_chars`` (in order of a hash of their id). Of
each text the window with the highest score is the one that learns, so a label
is about the worst window. Scoring is a map over Arrow batches of whole texts:
a text's score is that of its worst window. Windows start every half window,
so any passage of half a window stands whole in one.

Vocabularies come from the learning texts: words and character n-grams in
enough of them whose frequency differs most between the classes.

Edge cases: null and empty texts, and texts without a letter or digit, are one
window without words and get the net's base score. Labels other than 0 and 1
and labels without a document are left out. Without both classes every score
is the share of toxic labels, or 0. Repeated rows score alike to single
precision (what else is in a batch moves the last digits); an empty table
gives an empty one.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import bigru
from lexmill.llm.common import table
from lexmill.llm.quality import remainder

WORD = re.compile(r"[^\W_]+")
_MAX_TABLE = 300_000
_MAX_WINDOWS = 1024


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """(log odds ratio, its z value) of occurring in a text of either class."""
    a, b, c, d = pos + 0.5, neg + 0.5, n_pos - pos + 0.5, n_neg - neg + 0.5
    odds = np.log(a * d / (b * c))
    return odds, odds / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _chosen(keys: list, pos: Counter, neg: Counter, n_pos: int, n_neg: int, size: int, least: int) -> tuple[list, np.ndarray]:
    keys = [k for k in keys if pos[k] + neg[k] >= least]
    odds, z = _log_odds(np.array([pos[k] for k in keys], float), np.array([neg[k] for k in keys], float), n_pos, n_neg)
    best = np.argsort(-np.abs(z), kind="stable")[:size]
    best = best[np.abs(z[best]) >= 2]
    return [keys[i] for i in best], np.clip(odds[best], -3, 3)


class Scorer:
    """Scores texts, batch by batch; keeps the projected inputs of words met."""

    def __init__(self, net: bigru.Net):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1, 2 * self.net.p["bf"].size), np.float32)

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table for all words, and how many words each text has."""
        if len(self.index) > _MAX_TABLE:
            self.reset()
        new = list(set().union(*texts) - self.index.keys())
        if new:
            base = len(self.index)
            self.index.update((w, base + i) for i, w in enumerate(new))
            x = self.net.projected(self.net.inputs(*self.net.lookup(new)))
            self.table = np.concatenate([self.table[:base], x])
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(texts)), np.int64)
        return at, np.array([len(t) for t in texts], np.int64)

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        at, lens = self.rows(texts)
        return worst(self.net, self.table, at, lens)[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, part, size = [], [], 0
        for t in texts:
            w = words_of(t)
            part.append(w)
            size += len(w)
            if size >= 500_000:
                out.append(self.logits(part))
                part, size = [], 0
        if part:
            out.append(self.logits(part))
        z = np.concatenate(out) if out else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def worst(net: bigru.Net, table: np.ndarray, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the highest logit of its windows, the rows of that window, and its words."""
    first = np.cumsum(lens) - lens
    of, start, n = bigru.windows_of(lens)
    at = np.concatenate([at, np.zeros(bigru.WINDOW, np.int64)])
    logits = np.empty(len(of), np.float32)
    order = np.argsort(n, kind="stable")
    for i in range(0, len(of), _MAX_WINDOWS):
        k = order[i : i + _MAX_WINDOWS]
        rows = at[(first[of[k]] + start[k])[:, None] + np.arange(bigru.WINDOW)]
        logits[k] = bigru.forward(net, table, np.where(np.arange(bigru.WINDOW) < n[k][:, None], rows, 0), n[k])
    by = np.lexsort((np.arange(len(of)), -logits, of))
    best = by[np.flatnonzero(np.diff(of[by], prepend=-1))]
    rows = at[(first[of[best]] + start[best])[:, None] + np.arange(bigru.WINDOW)]
    return logits[best], np.where(np.arange(bigru.WINDOW) < n[best][:, None], rows, 0), n[best]


def learn(texts: list[str], y: np.ndarray, steps: int = 260, rate: float = 0.01, batch: int = 128, vocabulary: int = 4096, least: int = 4, seed: int = 5) -> bigru.Net:
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    if not n_pos or not n_neg:
        net = bigru.new_net({}, np.empty(0), np.empty(0, np.uint64), np.empty(0))
        net.p["out"][:] = 0
        share = n_pos / max(1, len(y))
        net.p["out_b"][:] = np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -15, 15)
        return net
    unique = list(dict.fromkeys(w for d in docs for w in d))
    number = {w: i for i, w in enumerate(unique)}
    words, grams = ({0: Counter(), 1: Counter()} for _ in "ab")
    h, of = bigru.gram_hashes(unique)
    cut = np.searchsorted(of[(order := np.argsort(of, kind="stable"))], np.arange(len(unique) + 1))
    h = h[order]
    for d, label in zip(docs, y, strict=True):
        own = set(d)
        words[int(label)].update(own)
        ids = [number[w] for w in own]
        grams[int(label)].update(np.unique(np.concatenate([h[cut[i] : cut[i + 1]] for i in ids])).tolist() if ids else ())
    vocab, word_prior = _chosen(unique, words[1], words[0], n_pos, n_neg, vocabulary, least)
    chosen, gram_prior = _chosen(sorted(grams[0].keys() | grams[1].keys()), grams[1], grams[0], n_pos, n_neg, vocabulary, least)
    order = np.argsort(np.array(chosen, np.uint64), kind="stable")
    net = bigru.new_net({w: i for i, w in enumerate(vocab)}, word_prior, np.array(chosen, np.uint64)[order], gram_prior[order], seed=seed)

    lookup = net.lookup(unique)
    at = np.fromiter((number[w] for d in docs for w in d), np.int64)
    lens = np.array([len(d) for d in docs], np.int64)
    weight = np.where(y == 1, min(4.0, n_neg / n_pos), 1.0).astype(np.float32)
    adam = bigru.Adam(rate)
    per_round = -(-len(y) // batch)
    for k in range(-(-steps // per_round)):
        if k % max(1, 24 // per_round) == 0:
            _, rows, n = worst(net, net.projected(net.inputs(*lookup)), at, lens)
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            b = order[i : i + batch]
            used, small = np.unique(rows[b], return_inverse=True)
            own, g, of = lookup
            near = np.isin(of, used)
            sub = (own[used], g[near], np.searchsorted(used, of[near]))
            x = net.inputs(*sub)
            adam.step(net.p, bigru.gradients(net, x, sub, small.reshape(rows[b].shape), n[b], y[b].astype(np.float32), weight[b]))
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 5, held: int = 0, max_labels: int = 3000, max_chars: int = 50_000, **kw) -> bigru.Net:
    """Learns from labelled rows whose remainder is not ``held``, at most ``max_labels``."""
    use = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    use = use.where(remainder(F.col("id"), mod) != held).orderBy(F.xxhash64("id"), "id", "y").limit(max_labels)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(use), F.col("doc_id") == F.col("id"))
    rows = d.where(F.length("text") <= max_chars).select("id", "y", "text").toPandas().sort_values(["id", "y", "text"])
    return learn(rows["text"].tolist(), rows["y"].to_numpy(int), **kw)


def score_udf(net: bigru.Net):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for b in batches:
            yield pd.Series(scorer.scores(b.tolist()))

    return score


def scores(docs: DataFrame, net: bigru.Net, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns score and predicted; its own columns of these names are replaced."""
    keep = [docs[c] for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = docs.select(*keep, score_udf(net)(docs[text_col]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = scores(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
