import random
from zlib import crc32

from pyspark.sql import types as T

from ragspark.llm import quality, toxicity

from .test_simhash import DOCS

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=600):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic, poor = i % 6 == 0, i % 5 == 1
        w = rng.choices(words, k=rng.randint(20, 120))
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["zwurkling", "zwurklord", "grobzwurk"]))
        text = " ".join(f"{x}###" for x in w) if poor else " ".join(w) + "."
        rows.append((i, text, "en", f"src{i % 7}", len(text)))
        if i % 4:
            labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in got if crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    right = sum(got[i]["predicted"] == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held)
    kept = toxicity.without_toxic(docs.withColumn("_score", docs["n_chars"]), labels)
    assert kept.columns == [*DOCS.names, "_score"]
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = corpus(spark, 300)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_edges(spark):
    docs, labels = corpus(spark, 200)
    odd = spark.createDataFrame([(None, "grobzwurk", None, None, None), (1, None, None, None, None), (2, "", None, None, None), (2, "", None, None, None), (3, "a" * 300_000, None, None, None)], DOCS)
    got = toxicity.toxicity(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 1, 1), (5, 0, 0)], LABELS)))
    assert got.count() == 205
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(odd, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality(spark):
    docs, labels = corpus(spark)
    got = quality.quality(docs.withColumn("score", docs["lang"]), labels).collect()
    assert len(got) == 600
    right = sum(r["keep"] == (r["doc_id"] % 5 != 1) for r in got)
    assert right >= 590
    assert all(0 <= r[c] <= 1 for r in got for c in ("text_score", "meta_score", "score"))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)], DOCS)
    assert quality.quality(odd.unionByName(docs), labels).count() == 603
    assert quality.quality(spark.createDataFrame([], DOCS), labels).count() == 0
    assert {r["score"] for r in quality.quality(odd, spark.createDataFrame([], LABELS)).collect()} == {0.5}


def test_views_label_for_each_other(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 900).astype(float)
    a, b = (np.stack([y + rng.normal(0, s, 900), rng.normal(0, 1, 900)], axis=1) for s in (0.2, 0.8))
    held = np.arange(900) % 5 == 0
    few = np.arange(900) < 60
    model = quality.co_train([a[few], b[few]], y[few], [a[~few], b[~few]], held[few])
    score = model.scores(a[~few], b[~few])[2]
    assert ((score > 0.5) == y[~few]).mean() > 0.93


def test_quality_from_words_alone(spark):
    """Good and poor texts of one shape, told apart by their words only; rows of the calibration fold test it."""
    rng = random.Random(8)
    good, poor, both = (["".join(rng.choices("abcdefgh", k=6)) for _ in range(150)] for _ in range(3))
    rows, labels = [], []
    for i in range(900):
        text = " ".join(rng.choices(both, k=30) + rng.choices(good if i % 2 else poor, k=10))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, i % 2, 0))
    got = quality.quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in got if crc32(str(r["doc_id"]).encode()) % 5 == quality.CALIBRATION]
    assert sum((r["text_score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in held) >= 0.95 * len(held)


def test_text_features():
    """Measures and buckets against plain counting; very long, empty and null texts."""
    for text in ("", None, "Ab 12 été Ünï x x x\n\nx x", "word " * 300_000, "𝔘𝔫 ٣ ß"):
        found, grams = quality.text_features(text)
        text = text or ""
        letters = sum(map(str.isalpha, text))
        want = [letters / max(len(text), 1), sum(map(str.isdigit, text)) / max(len(text), 1), sum(map(str.isupper, text)) / max(letters, 1)]
        assert found[2:5] == want and len(found) == quality.MEASURES
        words = text.lower().split()
        assert len(grams) <= len(set(words)) + len(set(zip(words, words[1:]))) and list(grams) == sorted(set(grams))
        assert {crc32(w.encode()) % quality.GRAMS for w in words} <= set(grams.tolist())


def test_schema_is_fixed(spark):
    docs, labels = corpus(spark, 60)
    assert toxicity.toxicity(docs, labels).schema == T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType(), False), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
