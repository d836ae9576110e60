"""Importance resampling: payloads against words hashed one by one, draws against a plain version."""

import hashlib
import math
import re
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ragspark.llm import importance as im

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _features(words, ngrams, buckets):
    runs = [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
    return [crc32(r.encode()) % buckets for r in runs]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcXYZ019 .,-\n\té漢 ", max_size=60), st.lists(st.sampled_from(["a", "b", "abc", "é", "漢漢", "x9", "c"]), max_size=6), st.integers(1, 4))
def test_scans_give_the_features_of_words_hashed_one_by_one(text, known, ngrams):
    found = im.payloads(text, im.automaton([w.encode() for w in dict.fromkeys(known)]))
    words = _words(text)
    assert [(int(p) & 0xFFFFFFFF, int(p) >> 32) for p in found] == [(crc32(w.encode()), len(w.encode())) for w in words]
    assert sorted(im.features(found, ngrams, 997).tolist()) == sorted(_features(words, ngrams, 997))


def test_composition_of_long_parts():
    parts = [(b"a" * m, b"b" * n) for m in (0, 1, 7, 300) for n in (0, 1, 2, 255, 70_000)]
    left, right = (np.array([crc32(p[k]) for p in parts], np.uint64) for k in (0, 1))
    got = im.composed(left, right, np.array([len(p[1]) for p in parts]))
    assert got.tolist() == [crc32(a + b) for a, b in parts]


def _plain(docs, target, percent, ngrams, buckets, least):
    count = lambda texts: np.bincount([b for t in texts for b in _features(_words(t), ngrams, buckets)] or [0], minlength=buckets) * bool(any(_words(t) for t in texts))
    s, t = count([d[1] for d in docs]), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found = _features(_words(text), ngrams, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(_words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted(tuple(r[:5]) for r in rows)


def test_draws_against_a_plain_version(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "Gamma", "delta", "tau", "é", "007", "x"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(120)] + [None, "", "...", "word " * 3000, "q" * 500]
    docs, target = list(enumerate(texts)), ["alpha beta beta", "tau, tau!", None]
    for ngrams in (1, 2):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        aim = spark.createDataFrame([(t,) for t in target], "text string")
        got = im.resampled(df, aim, percent=25, ngrams=ngrams, buckets=101, min_words=10, dictionary_words=4)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == _plain(docs, target, 25, ngrams, 101, 10)


def test_empty_tables_repeats_null_ids_and_clashing_names(spark):
    kind = "doc_id long, text string, weight string, rank int, n_words int"
    empty, aim = spark.createDataFrame([], kind), spark.createDataFrame([("a b",)], "text string")
    assert im.resampled(empty, aim).count() == 0
    text = "one two three " * 10
    df = spark.createDataFrame([(1, text, "w", 5, 6), (1, text, "w", 5, 6), (None, text, None, None, None)] * 4, kind)
    got = im.resampled(df, aim.where("false"), percent=50).collect()
    assert len(got) == 12 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6]
    assert len({(r["weight"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
