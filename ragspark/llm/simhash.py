"""SimHash near-duplicates, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.llm.components import connected_components
from ragspark.llm.tables import written

SHINGLE_WORDS = 4
SEED = 42
#: The three segments of a 64-bit fingerprint as (lowest bit, bits). Fingerprints that differ in at most
#: five bits have a segment in which they differ in one bit at most, as three segments with two each make six.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_DISTANCE = 4
#: bits of each byte value, bit 0 first
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text over word shingles, repeats included, as an unsigned number.

    A-Z are lower-cased; words are runs without ASCII white space. A text of fewer words than a shingle is
    one shingle; a text without words (or null) has fingerprint zero. A bit is set if it is set in over
    half the shingles' XXH64 (seed 42).
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    after = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], after[:-words])).tolist()
    ends = (after[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), "<u8", len(starts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(octets) < 600:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        found = np.fromiter((fingerprint(t) for t in batch), np.uint64, len(batch))
        yield pd.Series(found.view(np.int64))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs with the SimHash of each whole text as a signed long column."""
    return docs.withColumn(out, _fingerprints(F.col(text_col)))


def _distance(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _spread(fps: DataFrame) -> DataFrame:
    """fps over as many partitions as shuffles have: few bytes become 64 times as many rows."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def variants(fps: DataFrame) -> DataFrame:
    """Index entries: fps with a column `key` for each one-wildcard variant of each segment (64 a fingerprint).

    A variant is a segment with one bit masked out, together with that bit's place. Two fingerprints share
    one exactly if they differ, in that segment, at most in the masked bit.
    """
    keys = []
    for low, n in SEGMENTS:
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1))
        for bit in range(n):
            keys.append(segment.bitwiseAND(F.lit(((1 << n) - 1) ^ (1 << bit))) + F.lit((low + bit) << 32))
    return fps.withColumn("key", F.explode(F.array(*keys)))


def _hub_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links from each fingerprint to the most frequent fingerprint of each bucket it is in, if near enough.

    Linear in the entries however large a bucket is.
    """
    bucket = Window.partitionBy("key")
    hub = F.max(F.struct("n_docs", "fp")).over(bucket)
    linked = (
        variants(_spread(fps))
        .withColumn("hub", hub)
        .select("fp", F.col("hub.fp").alias("hub"))
        .where((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= distance))
    )
    return linked.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def _rest_links(fps: DataFrame, distance: int) -> DataFrame:
    """fps(fp, comp): links between components that the hubs left apart, as pairs of components.

    Buckets whose fingerprints are one component need no comparison. In the others, what isn't of the
    bucket's largest component meets all entries of the bucket, so that a large group of near copies is
    never compared with itself.
    """
    bucket, part = Window.partitionBy("key"), Window.partitionBy("key", "comp")
    mixed = written(
        variants(_spread(fps.select("fp", "comp")))
        .withColumns({"lo": F.min("comp").over(bucket), "hi": F.max("comp").over(bucket)})
        .where("lo < hi")
        .withColumn("n", F.count(F.lit(1)).over(part))
        .withColumn("lead", F.max(F.struct("n", "comp")).over(bucket)["comp"])
        .select("key", "fp", "comp", "lead")
    )
    left = mixed.where("comp <> lead").select("key", F.col("fp").alias("fa"), F.col("comp").alias("a"))
    right = mixed.select("key", F.col("fp").alias("fb"), F.col("comp").alias("b"), "lead")
    # of two that neither belong to the lead, one order is enough
    once = (F.col("b") == F.col("lead")) | (F.col("a") < F.col("b"))
    near = _distance("fa", "fb") <= distance
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & once & near).select("a", "b").distinct()


def link(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """fps(fp, n_docs), one row a fingerprint -> (fp, comp): the smallest fingerprint reachable by links.

    Two fingerprints link if they differ in `distance` bits or fewer, 5 at most. Exact, and no pairs of a
    group are spelled out. The candidates that a fingerprint meets in the index are about
    64 * n / 2^20 for n distinct fingerprints.
    """
    if distance > 2 * len(SEGMENTS) - 1:
        raise ValueError(f"segments of this index hold for {2 * len(SEGMENTS) - 1} bits at most")
    first = connected_components(_hub_links(fps, distance))
    fps = written(
        fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("component", "fp").alias("comp"))
    )
    second = connected_components(_rest_links(fps, distance))
    return fps.join(second, fps["comp"] == second["node"], "left").select("fp", F.coalesce("component", "comp").alias("comp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """Every row of docs as (id, fingerprint, component_id).

    fingerprint: 16 lower-case hex digits. component_id: the smallest id among all rows whose fingerprints
    can be reached over links. Null and empty texts have fingerprint zero and link like any other. Rows
    that repeat are returned as often as they come; a null id takes no part in the minimum (null if a
    component has no other). An empty table gives an empty result; other columns are ignored.
    """
    own = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "fp"))
    fps = written(own.groupBy("fp").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first")))
    comps = link(fps.select("fp", "n_docs"))
    # both are written, so that neither side of the join is an aggregate and Spark can split a large component
    per_fp = written(fps.join(comps, "fp").select("fp", "first", "comp"))
    least = written(per_fp.groupBy("comp").agg(F.min("first").alias("component_id")))
    found = written(per_fp.join(least, "comp").select("fp", "component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(found, "fp").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """documents without near duplicates: of each component the row with the smallest doc_id stays.

    Of rows that repeat with the same doc_id the least stays, by text and then by the row as JSON; rows without
    a doc_id stay. Other columns may be of any type.
    """
    groups = simhash_groups(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = written(kept.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    row = F.struct(*(F.col(c) for c in docs.columns))
    least = F.min_by(row, F.struct(F.coalesce("text", F.lit("")), F.to_json(row))).alias("r")
    several = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(least).select(*(F.col("r")[c].alias(c) for c in docs.columns))
    once = kept.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(several).unionByName(docs.where("doc_id is null"))
