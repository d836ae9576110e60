"""Bucketed collections, and slices that read the rows of the slice."""

import random

import pytest
from pyspark.sql import functions as F

from ragspark.operators import buckets, slices
from ragspark.sources import corpus
from ragspark.streaming import jobs

NAMES = "id long, value double"


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (path / "rows").rglob("*.parquet")}


def _got(spark, path, version=None):
    return {r["id"]: r["value"] for r in buckets.rows(spark, str(path), NAMES, version).collect()}


def test_merges_leave_other_buckets_files_alone(spark, tmp_path):
    path, held = tmp_path / "c", {i: float(i) for i in range(60)}
    buckets.start(spark.createDataFrame(list(held.items()), NAMES), str(path), "id", 8)
    before = _files(path)
    changes = spark.createDataFrame([(1, -1.0, 0), (1, -2.0, 1), (99, 5.0, 2)], f"{NAMES}, seq int")
    touched = buckets.merge_upserts(changes, str(path), NAMES, "id", "seq", buckets=8)
    assert 1 <= len(touched) <= 2 and _got(spark, path) == held | {1: -2.0, 99: 5.0}
    after = _files(path)
    assert all(after[f] == t for f, t in before.items())  # nothing was written again
    new = {f.split("_bucket=")[1].split("/")[0] for f in after.keys() - before.keys()}
    assert new == {str(b) for b in touched}
    ops = spark.createDataFrame([(1, 0.0, "delete", 3), (2, 7.0, "update", 4), (3, 1.0, "other", 5)], f"{NAMES}, op string, seq int")
    buckets.merge_workload(ops, str(path), NAMES, "id", "seq", buckets=8)
    want = {k: v for k, v in held.items() if k != 1} | {99: 5.0, 2: 7.0}
    assert _got(spark, path) == want and buckets.versions(spark, str(path)) == [-1, 0, 1]
    # an older version stays readable until it is let go; one manifest tells all of it
    assert _got(spark, path, -1) == held and _got(spark, path, 0) == held | {1: -2.0, 99: 5.0}
    buckets.compact(spark, str(path), 2)
    assert buckets.versions(spark, str(path)) == [0, 1] and _got(spark, path, 0)[1] == -2.0 and _got(spark, path) == want
    buckets.compact(spark, str(path), 1)
    assert _got(spark, path) == want and len(_files(path)) == len(buckets.manifest(spark, str(path)))
    with pytest.raises(ValueError):
        buckets.rows(spark, str(path), NAMES, 0)
    everything = spark.createDataFrame([(k, 0.0, "delete", 9) for k in want], f"{NAMES}, op string, seq int")
    buckets.merge_workload(everything, str(path), NAMES, "id", "seq", buckets=8)
    assert _got(spark, path) == {} and buckets.manifest(spark, str(path)) == {}
    buckets.merge_upserts(changes.where("false"), str(path), NAMES, "id", "seq", buckets=8)
    assert _got(spark, path) == {} and _got(spark, tmp_path / "nothing") == {}


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "c")
    buckets.start(spark.createDataFrame([(i, 0.0) for i in range(20)], NAMES), path, "id", 4)
    reader = buckets.rows(spark, path, NAMES)
    for n in range(4):
        buckets.merge_upserts(spark.createDataFrame([(i, float(n), n) for i in range(20)], f"{NAMES}, seq int"), path, NAMES, "id", "seq", buckets=4)
    assert {r["value"] for r in reader.collect()} == {0.0} and {r["value"] for r in buckets.rows(spark, path, NAMES).collect()} == {3.0}


def test_streamed_changes(spark, tmp_path):
    """Batches that come twice have their effect once, whatever the order within them."""
    path, held = tmp_path / "c", {i: float(i) for i in range(40)}
    buckets.start(spark.createDataFrame(list(held.items()), NAMES), str(path), "id", 8)
    batches = [[(1, -1.0, "update", 0), (1, -2.0, "update", 1), (50, 5.0, "insert", 2)], [(1, 0.0, "delete", 3), (2, 7.0, "update", 4)], [], [(50, 0.0, "delete", 5)]]
    for n, batch in enumerate(batches):
        ops = spark.createDataFrame(batch, f"{NAMES}, op string, seq int")
        for again in range(2):
            buckets.merge_workload(ops, str(path), NAMES, "id", "seq", n, 8)
            for key, value, op, _ in () if again else batch:
                held.pop(key, None) if op == "delete" else held.update({key: value})
            assert _got(spark, path) == held
    source = tmp_path / "in"
    spark.createDataFrame([(7, 0.5, "update", 9), (8, 0.0, "delete", 9)], f"{NAMES}, op string, seq int").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(f"{NAMES}, op string, seq int").parquet(str(source))
    run = jobs.stream_collection_changes(stream, str(tmp_path / "s"), "id", "seq", ["id", "value"], 8).option("checkpointLocation", str(tmp_path / "k"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert _got(spark, tmp_path / "s") == {7: 0.5}


@pytest.fixture()
def small_steps(monkeypatch):
    monkeypatch.setattr(slices, "TOP_ROWS", 20)
    monkeypatch.setattr(slices, "SAMPLE_KEYS", 100)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_slices_and_prefixes_anywhere(spark, small_steps, kind):
    keys = [None, None] + [k if kind == "long" else f"k{k:05}" for k in range(0, 5000, 2)]
    shuffled = random.Random(4).sample(keys, len(keys))
    df = spark.createDataFrame(list(enumerate(shuffled)), f"n int, key {kind}").repartition(4)
    total = len(keys)
    for start, end in ((0, 3), (0, 30), (1, 90), (700, 705), (1200, 1500), (2490, 2502), (2501, 2502), (0, total)):
        got = slices.ranked_slice(df, start, end, "key", total)
        assert sorted((r["key"] for r in got.collect()), key=lambda k: (k is not None, k)) == keys[start:end], (start, end)
    for n in (0, 1, 19, 40, 1251, total - 1, total):
        assert sorted((r["key"] for r in slices.prefix(df, n, "key", total).collect()), key=lambda k: (k is not None, k)) == keys[:n], n


def test_slices_of_one_frequent_key(spark, small_steps):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, 5).otherwise(F.col("id")).alias("key"), "id")
    assert {r["key"] for r in slices.ranked_slice(df, 1000, 1400, "key", 3000).collect()} == {5}
    assert slices.ranked_slice(df, 1000, 1400, "key", 3000).count() == 400 and slices.prefix(df, 2000, "key", 3000).count() == 2000
    assert [r["key"] for r in slices.ranked_slice(df, 2890, 2910, "key", 3000).orderBy("key").collect()] == [5] * 10 + list(range(2900, 2910))


def test_a_slice_reads_its_range_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slices, "TOP_ROWS", 100)
    path = str(tmp_path / "t")
    spark.range(4000).selectExpr("id as key", "id * 2 as other").repartitionByRange(8, "key").write.parquet(path)
    found = corpus.dataset_slice(spark.read.parquet(path), 10, 200, "key")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(key" in plan and "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert [r["key"] for r in found.orderBy("key").collect()] == list(range(2000, 2010))
    short = corpus.dataset_slice(spark.read.parquet(path), 5, 1, "key")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in short and "Exchange" not in short
