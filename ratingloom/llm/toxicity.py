"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores ``p_s = sigmoid(b + sum of its words' weights)`` and the document
scores by noisy-or, ``1 - prod(1 - p_s)``: one bad sentence is enough. Only document labels are known, so the weights are
fitted by gradient descent on the likelihood of the noisy-or; the same weights then locate the offending sentences.

A word carries weights for itself and for its leading 3, 4 and 5 bytes, so that inflected forms share evidence. Spark counts
every feature in the toxic and the clean documents among all labelled ones that aren't held out. The fit sees a bounded hash sample
of these documents, and of the sample's features those whose association with the label is significant over all of them and that
are at least ``RATIO`` times as frequent in one class as in the other.

Edge cases: a null or empty text has no sentence and scores 0; null labels and null ids are not learned from; several label
rows for one document count as their maximum; repeated document rows are scored one by one; without any label of both
classes every score is 0. Input columns that share a name with a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, cut, hot_keys, join_unique, small_batches

SENTENCE = re.compile(rb"[.!?\n]+")
#: Bounds on the labelled documents that the fit may see, and on their bytes; beyond either a hash sample of about this many is taken.
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 12_000, 64_000_000
#: A feature is of use if its share of toxic documents is so many times its share of clean ones, or the other way round.
RATIO = 2.0
PUNCT = b".,;:!?\"'()[]{}|*#$%&-"
CACHE = 400_000
RESULT = "score double, predicted int, n_sentences int, offending array<int>, worst_sentence int"


def features(token: bytes) -> list[bytes]:
    word = token.strip(PUNCT)
    if not word:
        return []
    return [b"=" + word, *(b"%d" % n + word[:n] for n in (3, 4, 5) if len(word) >= n)]


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has any."""
    return [w for s in SENTENCE.split((text or "").encode().lower()) if (w := s.split())]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -30.0


class TokenWeights(dict):
    """Raw token to summed weight, filled on demand and emptied when it outgrows its bound."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[token] = sum(self.weights.get(f, 0.0) for f in features(token))
        return value


def score_text(text: str | None, weigh, bias: float) -> tuple[float, int, int, list[int], int]:
    parts = sentences(text)
    if not parts:
        return 0.0, 0, 0, [], -1
    z = np.array([sum(map(weigh, words)) for words in parts]) + bias
    z = np.clip(z, -35, 35)
    log_clean = -np.logaddexp(0, z)  # log(1 - p_s)
    score = float(-np.expm1(log_clean.sum()))
    return score, int(score >= 0.5), len(parts), np.flatnonzero(z >= 0).tolist(), int(z.argmax())


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per feature, the toxic and clean documents of this batch that have it."""
    for pdf in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, label in zip(pdf["text"], pdf["label"]):
            tokens = set((text or "").encode().lower().replace(b".", b" ").replace(b"!", b" ").replace(b"?", b" ").split())
            seen[label].update({f for t in tokens for f in features(t)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"feature": names, "toxic": [seen[1][n] for n in names], "clean": [seen[0][n] for n in names]})


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_id, text, label) of the labelled documents that aren't held out."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (bucket(id_col, 5) != 0))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(bucket("_id", 5) != 0)
    # the same plan at every size: ids meet their labels by a shuffle, those of many rows in slices
    return join_unique(rows, cut(known).hint("shuffle_hash"), "_id", hot_keys(rows, "_id"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES, min_docs: int = 4) -> Model:
    """Weights of the words and the bias of a sentence, from document labels alone."""
    known = cut(labelled(docs, labels, id_col, text_col, label_col))
    size = {r["label"]: r for r in known.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if len(size) < 2:
        return Model()
    n1, n0 = size[1]["n"], size[0]["n"]
    share = min(1.0, max_docs / (n1 + n0), max_bytes / max(1, sum(r["bytes"] or 0 for r in size.values())))
    train = known.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_003)) < int(1_000_003 * share) + 1).select("text", "label")
    count = lambda d: d.select("text", "label").mapInPandas(_counted, "feature binary, toxic long, clean long")
    counts = count(known).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a") / n1, F.col("b") / n0
    pooled = (F.col("a") + F.col("b")) / (n1 + n0)
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    ratio = ((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1))
    telling = counts.where(F.col("a") + F.col("b") >= min_docs).withColumn("z", z).where((F.abs("z") > 3) & ((ratio >= RATIO) | (ratio <= 1 / RATIO)))
    if share < 1:
        telling = telling.join(count(train).select("feature").distinct(), "feature", "left_semi")
    chosen = [bytes(r["feature"]) for r in telling.orderBy(F.abs("z").desc(), "feature").collect()]
    index = {f: i for i, f in enumerate(chosen)}

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per document, its label, its number of sentences, and the (sentence, feature) pairs of the chosen features as bytes."""
        for pdf in batches:
            rows = []
            for text, label in zip(pdf["text"], pdf["label"]):
                parts = sentences(text)
                pairs = [(s, index[f]) for s, words in enumerate(parts) for t in words for f in features(t) if f in index]
                rows.append((label, len(parts), np.array(pairs, np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["label", "n", "pairs"])

    rows = train.mapInPandas(bags, "label int, n int, pairs binary").where("n > 0").toPandas()
    rows = rows.sort_values(["label", "n", "pairs"], kind="stable", ignore_index=True)  # so that a fit repeats
    return fit_bags(rows, chosen)


def fit_bags(rows: pd.DataFrame, chosen: list[bytes], rounds: int = 250, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """Adam on the noisy-or likelihood over the bounded sample."""
    if not len(rows):
        return Model()
    n = rows["n"].to_numpy()
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    y = rows["label"].to_numpy().astype(float)
    pairs = [np.frombuffer(p, np.int32).reshape(-1, 2) for p in rows["pairs"]]
    sent = np.concatenate([p[:, 0] + s for p, s in zip(pairs, start)])
    feat = np.concatenate([p[:, 1] for p in pairs])
    doc, total = np.repeat(np.arange(len(n)), n), int(n.sum())
    w, b = np.zeros(len(chosen) or 1), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(sent, weights=w[feat], minlength=total) + b, -35, 35)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(n))  # log P(document is clean)
        bad = np.maximum(-np.expm1(clean), 1e-12)
        # d(log-likelihood)/dz: a clean document pushes every sentence down, a toxic one pushes up those that explain it
        g = np.where(y[doc] > 0, (np.exp(clean) / bad)[doc] * p, -p)
        gw = np.bincount(feat, weights=g[sent], minlength=len(w)) / len(n) - l2 * w
        gb = g.sum() / len(n)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, b = w + step * m / (np.sqrt(v) + 1e-8), b + step * mb / (np.sqrt(vb) + 1e-8)
    return Model({f: float(x) for f, x in zip(chosen, w) if x}, float(b))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted``, ``n_sentences``, ``offending`` (indices of sentences at or over one half) and ``worst_sentence``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weigh = TokenWeights(shared.value.weights).__getitem__
        for texts in batches:
            yield pd.DataFrame([score_text(t, weigh, shared.value.bias) for t in texts], columns=["score", "predicted", "n_sentences", "offending", "worst_sentence"])

    out = docs.withColumn("_scored", scored.asNondeterministic()(F.col(text_col)))
    return out.select(*(c for c in docs.columns if c not in ("score", "predicted", "n_sentences", "offending", "worst_sentence")), "_scored.*")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    return score(docs, fit(docs, labels, id_col, text_col, label_col), text_col)
