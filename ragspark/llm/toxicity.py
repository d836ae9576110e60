"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.linear import Rows, fit_logistic, sigmoid
from ragspark.llm.tables import first_by_hash, removed, unused, written

GRAMS = (3, 4, 5, 6)
#: an n-gram is one feature for each of these counts that it reaches in a text
LEVELS = (1, 2, 4)
BUCKET_BITS = 20
#: bounds of what training reads and keeps: labelled rows of each class, and features
SAMPLE_ROWS = {1: 6_000, 0: 14_000}
FEATURES = 3_000
SMOOTHING = 1.0
THRESHOLD = 0.7
HELD_OUT = 1  # crc32(doc_id as text) mod 3 of the rows that are never trained on


def gram_buckets(text: str | None) -> np.ndarray:
    """Hash buckets of a text's character n-grams, repeats included.

    Letters are lower-cased and white space becomes single spaces, with one at both ends, so that n-grams
    know where words begin.
    """
    clean = f" {' '.join((text or '').lower().split())} "
    chars = np.frombuffer(clean.encode("utf-32-le", "replace"), np.uint32)
    if len(chars) < 3:
        return np.zeros(0, np.uint32)
    out, rolled = [], chars
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + chars[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n in GRAMS:
            out.append((rolled ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


def by_level(buckets: np.ndarray) -> list[np.ndarray]:
    """The distinct buckets that come at least 1, 2, 4 times."""
    distinct, counts = np.unique(buckets, return_counts=True)
    return [distinct[counts >= level] for level in LEVELS]


def features_of(buckets: np.ndarray) -> np.ndarray:
    """Features of n-grams with repeats: level times number of buckets, plus bucket; ascending."""
    return np.concatenate([x.astype(np.int64) + (k << BUCKET_BITS) for k, x in enumerate(by_level(buckets))])


def gram_features(text: str | None) -> np.ndarray:
    return features_of(gram_buckets(text))


@dataclass
class ToxicityModel:
    """Sorted features with their weights (log-count ratio times coefficient), and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.used: np.ndarray | None = None  # by bucket, made where the model is used

    def score(self, text: str | None) -> float:
        if self.used is None:
            self.used = np.zeros(1 << BUCKET_BITS, bool)
            self.used[self.features & ((1 << BUCKET_BITS) - 1)] = True
        buckets = gram_buckets(text)
        found = features_of(buckets[self.used[buckets]])
        if not len(self.features):
            return float(sigmoid(self.bias))
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return float(sigmoid(self.weights[at[self.features[at] == found]].sum() + self.bias))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a row is kept from training (a null id: false; such rows have no label)."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == HELD_OUT, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labelled rows that training may use."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))


def prior_shift(labels: DataFrame, sample_rows: dict[int, int] | None = None) -> float:
    """Log odds of all labelled rows less those of the sample; zero where the sample is all of them."""
    n = {r["y"]: r["count"] for r in known_labels(labels).groupBy("y").count().collect()}
    share = {y: min(1.0, k / max(n.get(y, 0), 1)) for y, k in (sample_rows or SAMPLE_ROWS).items()}
    return float(np.log(share[0] / share[1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: dict[int, int] | None = None) -> DataFrame:
    """(text, y) of at most sample_rows[y] labelled documents of each class, the first by a hash of the id.

    Rows that are held out or without label are not in it. A document with several labels counts as toxic
    if one of them says so.
    """
    rows = sample_rows or SAMPLE_ROWS
    known = known_labels(labels)
    parts = [first_by_hash(known.where(F.col("y") == y), n, "doc_id") for y, n in rows.items()]
    chosen = parts[0].unionByName(parts[1])
    # the chosen ids are bounded by sample_rows, so they go to all executors and the texts don't move
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")  # an id that repeats is one row


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample_rows: dict[int, int] | None = None) -> ToxicityModel:
    """Fit on a bounded labelled sample.

    Document frequencies of n-grams by class are counted on the executors; the `features` n-grams with the
    largest chi-squared are kept, scaled by their log-count ratios, and a logistic regression is fitted
    to the sample's rows. Where the bounds take another share of one class than of the other, the bias is moved
    to the odds of all labelled rows, so that scores mean the same at every size. Without labels of both classes all scores are the share of toxic rows (a half
    without any label).
    """
    sample = written(labelled_sample(docs, labels, sample_rows))
    size = len(LEVELS) << BUCKET_BITS

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, size), np.uint32)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                counts[y][gram_features(text)] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"bucket": seen, "neg": counts[0][seen].astype(np.int32), "pos": counts[1][seen].astype(np.int32)})

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not (n0 and n1):
        removed(sample)
        share = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.5
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    p, q = F.col("pos") / n1, F.col("neg") / n0
    shared = (F.col("pos") + F.col("neg")) / (n0 + n1)
    best = (
        sample.mapInPandas(counted, "bucket int, neg int, pos int")
        .groupBy("bucket")
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        .where("neg + pos >= 3")
        .orderBy(F.desc((p - q) * (p - q) / (shared * (1 - shared) + F.lit(1e-9))), "bucket")
        .limit(features)
        .toPandas()
        .sort_values("bucket")
    )
    kept = best["bucket"].to_numpy(np.int64)
    ratio = np.log((best["pos"] + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((best["neg"] + SMOOTHING) / (n0 + 2 * SMOOTHING))
    ratio = ratio.to_numpy()

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(kept, gram_features(t), assume_unique=True)) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "at": [x.tolist() for x in found]})

    # the same rows in the same order whatever the partitions, so that equal tables give equal models
    got = sample.mapInPandas(columns, "y int, at array<int>").orderBy("y", "at").toPandas()
    removed(sample)
    rows = Rows.of([np.asarray(x, np.int64) for x in got["at"]], len(kept), ratio)
    w, bias = fit_logistic(rows, got["y"].to_numpy(float), l2=1e-3)
    return ToxicityModel(kept, w * ratio, bias + prior_shift(labels, sample_rows))


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the toxicity of each whole text, 0 to 1 (null and empty texts: that of no n-grams)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(t) for t in batch], dtype=float)

    return docs.withColumn(out, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: (doc_id, held_out, score, predicted: 1 if score >= 0.7).

    Scores depend on the text alone. Null ids are scored and count as not held out.
    """
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those predicted toxic; null and empty texts stay unless the bias alone rejects."""
    model = train(docs, labels)
    name = unused(docs, "_score")
    return scored(docs, model, out=name).where(F.col(name) < THRESHOLD).select(docs.columns)
