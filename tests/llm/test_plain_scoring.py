"""Scores of trained models against plain Python, and the pipeline's edges."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from ragspark.llm import toxicity
from ragspark.llm.gbt import fit_trees

from .test_simhash import DOCS

LABELS = "doc_id long, quality int, toxic int"


def _plain_score(model, text):
    """The sum over n-grams, spelled out one by one."""
    clean, counts = f" {' '.join((text or '').lower().split())} ", Counter()
    for n in toxicity.GRAMS if len(clean) > 2 else ():
        for k in range(len(clean) - n + 1):
            h = ord(clean[k])
            for c in clean[k + 1 : k + n]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            counts[((h ^ (n * 0x5BD1E995 % 2**32)) * 0x9E3779B1 % 2**32) >> (32 - toxicity.BUCKET_BITS)] += 1
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    found = [weights.get(b + (k << toxicity.BUCKET_BITS), 0.0) for b, c in counts.items() for k, level in enumerate(toxicity.LEVELS) if c >= level]
    return 1 / (1 + math.exp(-(sum(found) + model.bias)))


def test_toxicity_scores_one_n_gram_at_a_time(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(80)]
    docs = [(i, " ".join(rng.choices(words, k=25) + (["zwurkl", "grobzwurk"] if i % 4 == 0 else [])), "en", "s", 1) for i in range(240)]
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "Zwurkl\n\nZWURKL é漢 " * 50, "en", "s", 0), (903, "a", "en", "s", 0)]
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], LABELS)
    model = toxicity.train(df, labels, features=400)
    assert len(model.features) == 400
    for r in toxicity.scored(df, model).select("text", "score").collect():
        assert r["score"] == pytest.approx(_plain_score(model, r["text"]), rel=1e-9)


def test_trees_one_row_at_a_time():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = fit_trees(x, y, trees=20, depth=3)
    for row, got in zip(x, trees.probability(x)):
        total = trees.bias
        for columns, thresholds, leaves in zip(trees.columns, trees.thresholds, trees.leaves):
            at = 0
            while at < len(columns):
                at = 2 * at + 1 + bool(row[columns[at]] > thresholds[at])
            total += leaves[at - len(columns)]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    # a row that counts twice is two rows
    weight = np.where(np.arange(300) < 100, 2.0, 1.0)
    twice = np.concatenate([np.arange(300), np.arange(100)])
    a, b = fit_trees(x, y, trees=1, depth=1, weight=weight), fit_trees(x[twice], y[twice], trees=1, depth=1)
    assert a.bias == pytest.approx(b.bias)


def _tables(spark, path, docs, labels, items, schema=DOCS):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    _tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = tmp_path / "some"
    some.mkdir()
    _tables(spark, some, [(1, "one text", "en", "s", 8), (2, None, None, None, None), (3, "", "en", "s", 0)], [], [])
    rows = corpus_pipeline.run(spark, str(some)).collect()
    assert {r["doc_id"] for r in rows} == {1, 2}  # 2 and 3 have the same fingerprint, zero


def test_pipeline_keeps_other_columns_whatever_their_names(spark, tmp_path):
    import corpus_pipeline

    extra = ["key", "h", "pos", "fp", "score", "comp", "_key", "_values", "words", "n_docs", "node", "value", "KIND"]
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    key = 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'
    docs = [(i, text() + (f" {key}" if i == 3 else ""), "en", "s", 9, *(f"{c}{i}" for c in extra)) for i in range(12)]
    docs.append((20, docs[5][1], "en", "s", 9, *("copy" for _ in extra)))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    _tables(spark, tmp_path, docs, [(i, 1, int(i == 0)) for i in range(6)], [(1, docs[7][1])], schema)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert now.columns == names
    rows = {r["doc_id"]: r for r in now.collect()}
    assert 20 not in rows and 7 not in rows and "[SECRET]" in rows[3]["text"]
    assert all(r[c] == f"{c}{i}" for i, r in rows.items() for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == len(rows)
