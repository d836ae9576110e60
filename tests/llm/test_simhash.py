import random
import re

import xxhash
from pyspark.sql import types as T

from ragspark.llm import simhash
from ragspark.llm.components import connected_components

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Smallest id reachable over pairs of fingerprints at most 4 bits apart."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_by_definition():
    rng = random.Random(1)
    texts = ["", None, "a", "A b\tC", "a b c d", "É Ä x\x0by z\n\nq", "the " * 900, "\x85 \xa0 no split"]
    texts += [" ".join(rng.choices(["ab", "cd", "Ef", "ß", "x1"], k=rng.randint(1, 1500))) for _ in range(20)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_groups_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    docs = []
    base = rng.choices(words, k=400)
    for i in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i * 3 + 100, " ".join(w)))
    docs += [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    docs += [(9000 + i, t) for i, t in enumerate(["", None, " \n", "a", "a"])]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs}
    want = slow_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_links_of_planted_distances(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(200)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), d)) for f in fps for d in (1, 3, 4, 5, 6)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = dict(tuple(r) for r in simhash.link(spark.createDataFrame([(f, 1) for f in signed], "fp long, n_docs long")).collect())
    want = slow_components(dict(zip(signed, fps)))
    assert got == want


def test_edges_of_tables(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(5, "a b c d e f", "x", "y", 1), (5, "a b c d e f", "x", "y", 1), (None, "a b c d e f", None, None, None), (None, None, None, None, None), (7, "q", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, simhash.simhash_groups(df).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (7, 7)], key=str)
    kept = simhash.deduplicated(df.withColumn("_rank", df["n_chars"]).withColumn("fp", df["lang"]))
    assert kept.columns == [*DOCS.names, "_rank", "fp"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 5, 7]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_repeated_ids_with_columns_of_any_type(spark):
    df = spark.createDataFrame([(1, "b c d", {"x": 1}), (1, "a b c", {"x": 2}), (1, "a b c", {"x": 1}), (2, "other words here", None), (None, "q", None), (None, "q", None)],
                               "doc_id long, text string, m map<string,int>")
    from ragspark.llm.simhash import deduplicated

    assert sorted((r["doc_id"] or 0, r["text"], (r["m"] or {}).get("x")) for r in deduplicated(df).collect()) == [(0, "q", None), (0, "q", None), (1, "a b c", 1), (2, "other words here", None)]
