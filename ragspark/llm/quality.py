"""Quality classifier by co-training: a text view and a metadata view label documents for each other."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.gbt import Trees, fit_trees
from ragspark.llm.linear import Rows, fit_logistic, sigmoid
from ragspark.llm.tables import first_by_hash

#: bounds of what training reads: labelled rows, and rows without label that the views label for each other
LABELLED_ROWS = 8_000
POOL_ROWS = 6_000
ROUNDS = 4
#: what a view must be sure of to hand a row to the other, and the share of the pool it may hand over in a round
CONFIDENT = 0.95
SHARE = 0.1
#: rows with crc32(doc_id as text) mod 5 of this value calibrate the views and their combination
CALIBRATION = 0
#: buckets of the names of sources and languages
BUCKETS = 16
#: buckets of words and word pairs (numbers of 16 bits), and folds between which their ratios are told apart in training
GRAMS = 1 << 16
FOLDS = 4
#: texts whose buckets are held in memory at a time
SLICE = 500
KEEP = 0.5


@cache
def _kinds() -> np.ndarray:
    """Per code point: 1 for letters, 2 for digits, 4 for capitals."""
    chars = map(chr, range(sys.maxunicode + 1))
    return np.fromiter((c.isalpha() + 2 * c.isdigit() + 4 * c.isupper() for c in chars), np.uint8, sys.maxunicode + 1)


def text_features(text: str | None) -> tuple[list[float], np.ndarray]:
    """Content alone: measures of length, characters, repetition and sentences; and buckets of its words and word pairs.

    Each bucket stands once, in order.
    """
    text = text or ""
    n = max(len(text), 1)
    words = text.lower().split()
    m = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:]))
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=8)
    letters, digits, capitals = (int(kinds[[k for k in range(8) if k & bit]].sum()) for bit in (1, 2, 4))
    measures = [
        np.log1p(len(words)), sum(map(len, words)) / m, letters / n, digits / n, capitals / max(letters, 1),
        sum(map(text.count, "#*&$%@^~=<>{}[]\\")) / m, text.count("|") / m, text.count("!") / m, sum(map(text.count, ".?;:")) / m, text.count(",") / m,
        len(counts) / m, max(counts.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(c for c in pairs.values() if c > 1) / m, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)), m / max(len(lines), 1),
        sum(c for w, c in counts.items() if len(w) > 20) / m, sum(c for w, c in counts.items() if re.search(r"\d", w)) / m, float(text.rstrip()[-1:] in ".!?\"'"),
    ]
    known = {w: crc32(w.encode()) for w in counts}
    h = np.array([known[w] for w in words], np.uint64)
    pair = ((h[:-1] * np.uint64(0x9E3779B1)) ^ h[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(13)
    return measures, np.unique(np.concatenate([h, pair]) % np.uint64(GRAMS)).astype(np.uint16)


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """Metadata alone: language and source by hash bucket, and the stated size."""
    missing = n_chars is None or n_chars != n_chars
    size = -1.0 if missing else float(np.log1p(max(n_chars, 0)))
    at = [crc32(f"{k}={v}".encode()) % BUCKETS for k, v in (("lang", lang), ("source", source))]
    return [size, float(missing), *(float(at[0] == b) for b in range(BUCKETS)), *(float(at[1] == b) for b in range(BUCKETS))]


MEASURES, META_FEATURES = len(text_features("")[0]), len(meta_features(None, None, None))


@dataclass
class Texts:
    """The text view of some rows: their measures, and the buckets of their words row after row."""

    measures: np.ndarray
    grams: list[np.ndarray]

    @classmethod
    def of(cls, found: list[tuple[list[float], np.ndarray]]) -> Texts:
        return cls(np.array([x for x, _ in found], float).reshape(len(found), MEASURES), [g for _, g in found])

    def __len__(self) -> int:
        return len(self.grams)

    def __getitem__(self, at: np.ndarray) -> Texts:
        at = np.flatnonzero(at) if at.dtype == bool else at
        return Texts(self.measures[at], [self.grams[k] for k in at])

    def __add__(self, more: Texts) -> Texts:
        return Texts(np.concatenate([self.measures, more.measures]), self.grams + more.grams)


def _ratios(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bucket, from the number of rows of each class that hold it: how much likelier a good row does."""
    rates = (counts + 1) / (rows + 2)[:, None]
    return np.log(rates[1]) - np.log(rates[0])


def _word_columns(grams: list[np.ndarray], ratios: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Sum, mean and both tails of each row's log-count ratios, told by the ratios of the row's fold."""
    out = np.zeros((len(grams), 4))
    for k, g in enumerate(grams):
        told = ratios[fold[k], g]
        total, m = told.sum(), max(len(g), 1)
        out[k] = total, total / m, np.count_nonzero(told > 1) / m, np.count_nonzero(told < -1) / m
    return out


@dataclass
class TextModel:
    """Boosted trees over measures and what the words' log-count ratios say."""

    ratios: np.ndarray  # one row
    trees: Trees

    def probability(self, x: Texts) -> np.ndarray:
        words = _word_columns(x.grams, self.ratios, np.zeros(len(x), np.int64))
        return self.trees.probability(np.concatenate([x.measures, words], axis=1))


def fit_view(x: Texts | np.ndarray, y: np.ndarray) -> TextModel | Trees:
    """Trees; those of the text view see ratios of the other folds' rows, as a row's own label must not tell."""
    if not isinstance(x, Texts):
        return fit_trees(x, y, trees=40, depth=3)
    fold = np.arange(len(y)) % FOLDS
    counts, rows = np.zeros((FOLDS, 2, GRAMS)), np.zeros((FOLDS, 2))
    for f, label, g in zip(fold, y.astype(int), x.grams):
        counts[f, label, g] += 1  # a row holds a bucket once
        rows[f, label] += 1
    all_counts, all_rows = counts.sum(axis=0), rows.sum(axis=0)
    others = np.stack([_ratios(all_counts - c, all_rows - n) for c, n in zip(counts, rows)])
    columns = np.concatenate([x.measures, _word_columns(x.grams, others, fold)], axis=1)
    return TextModel(_ratios(all_counts, all_rows)[None, :], fit_trees(columns, y, trees=40, depth=3))


def _with(x: Texts | np.ndarray, more: Texts | np.ndarray) -> Texts | np.ndarray:
    return x + more if isinstance(x, Texts) else np.concatenate([x, more])


@dataclass
class View:
    """A classifier over one view with its calibration: a slope and offset on the log odds."""

    model: TextModel | Trees
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: Texts | np.ndarray) -> np.ndarray:
        p = np.clip(self.model.probability(x), 1e-6, 1 - 1e-6)
        return self.slope * np.log(p / (1 - p)) + self.offset


@dataclass
class QualityModel:
    text: View | None
    meta: View | None
    weights: tuple[float, float, float]  # of the text view, the metadata view, and the bias

    def scores(self, text: Texts | np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None:
            flat = np.full(len(text), float(sigmoid(self.weights[2])))
            return flat, flat, flat
        a, b = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def _line(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on few dense columns."""
    n, m = x.shape
    scale = np.abs(x).max(axis=0) + 1e-9
    rows = Rows(np.tile(np.arange(m), n), np.arange(n) * m, np.full(n, m), np.ones(m))
    flat = (x / scale).ravel()

    class Dense(Rows):
        def dot(self, w):
            return (flat * w[self.at]).reshape(n, m).sum(axis=1)

        def transposed_dot(self, g):
            return (flat.reshape(n, m) * g[:, None]).sum(axis=0)

    w, b = fit_logistic(Dense(rows.at, rows.starts, rows.lengths, rows.scale), y, 1e-3, 400)
    return w / scale, b


def co_train(views: list[Texts | np.ndarray], y: np.ndarray, pool: list[Texts | np.ndarray], calibration: np.ndarray) -> QualityModel:
    """Fit both views on labelled rows, let each hand confident rows of the pool to the other, round by round.

    The rows of `calibration` are kept out of training; on them each view's log odds are calibrated and the
    weights of their combination fitted.
    """
    fit, held = ~calibration, calibration
    if len(set(y[fit])) < 2 or len(set(y[held])) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return QualityModel(None, None, (0.0, 0.0, float(np.log(share / (1 - share)))))
    x = [v[fit] for v in views]
    labels = [y[fit], y[fit]]
    free = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]  # rows not yet given to this view
    models: list[TextModel | Trees] = []
    for _ in range(ROUNDS):
        models = [fit_view(v, l) for v, l in zip(x, labels)]
        if not len(pool[0]):
            break
        given = False
        for teacher, pupil in ((0, 1), (1, 0)):
            p = models[teacher].probability(pool[teacher])
            most = max(1, int(SHARE * len(p)))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                at = np.flatnonzero(free[pupil] & (sure >= CONFIDENT))
                at = at[np.argsort(-sure[at], kind="stable")[:most]]
                free[pupil][at] = False
                x[pupil] = _with(x[pupil], pool[pupil][at])
                labels[pupil] = np.concatenate([labels[pupil], np.full(len(at), label)])
                given |= len(at) > 0
        if not given:
            break
    out = []
    for model, v in zip(models, views):
        view = View(model)
        w, b = _line(view.logit(v[held])[:, None], y[held])
        out.append(View(model, max(float(w[0]), 0.0), b))
    w, b = _line(np.stack([v.logit(x[held]) for v, x in zip(out, views)], axis=1), y[held])
    return QualityModel(out[0], out[1], (max(float(w[0]), 0.0), max(float(w[1]), 0.0), b))


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on bounded samples: the first labelled and unlabelled documents by a hash of the id.

    Only features of these rows reach the driver. Without labels of both classes every score is the share
    of good rows.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    some = first_by_hash(known, LABELLED_ROWS, "doc_id")
    pool = first_by_hash(docs.select("doc_id").where("doc_id is not null").join(known, "doc_id", "left_anti"), POOL_ROWS, "doc_id")
    chosen = some.unionByName(pool.withColumn("y", F.lit(None).cast("double")))
    # both samples are bounded, so their ids go to all executors
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [text_features(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "y": b["y"], "a": [x for x, _ in found], "grams": [g.tobytes() for _, g in found],
                "b": [meta_features(*r) for r in zip(b["lang"], b["source"], b["n_chars"])],
            })

    got = rows.mapInPandas(run, "doc_id long, y double, a array<double>, grams binary, b array<double>").toPandas()
    got = got.sort_values(["doc_id", "y"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)
    texts = Texts.of([(x, np.frombuffer(g, np.uint16)) for x, g in zip(got["a"], got["grams"])])
    views = [texts, np.array(got["b"].tolist(), float).reshape(len(got), META_FEATURES)]
    known_at = got["y"].notna().to_numpy()
    held = np.array([crc32(str(i).encode()) % 5 == CALIBRATION for i in got["doc_id"]], bool)
    return co_train([v[known_at] for v in views], got["y"].to_numpy()[known_at], [v[~known_at] for v in views], held[known_at])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: (doc_id, text_score, meta_score, score, keep: score >= 0.5), all scores 0 to 1.

    Whole texts are read; null texts count as empty, null metadata as a value of its own. Equal rows get
    equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # GRAMS ratios and few trees, under a megabyte
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")])

    @F.pandas_udf(schema)
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, lang, source, n_chars in batches:
            b = np.array([meta_features(*r) for r in zip(lang, source, n_chars)], float).reshape(len(text), META_FEATURES)
            parts = []
            for k in range(0, len(text), SLICE):
                a = Texts.of([text_features(t) for t in text.iloc[k : k + SLICE]])
                parts.append(np.stack(shared.value.scores(a, b[k : k + SLICE]), axis=1))
            yield pd.DataFrame(np.concatenate([*parts, np.zeros((0, 3))]), columns=schema.names)

    found = docs.select("doc_id", score("text", "lang", "source", "n_chars").alias("s")).select("doc_id", "s.*")
    return found.withColumn("keep", F.col("score") >= KEEP)
