"""Collections on disk that change by buckets of keys: a batch of changes rewrites the buckets of its keys alone.

path/rows/_version=n/_bucket=b holds what version n left in a bucket; path/manifest/_version=n names, for every
bucket that has rows, the version that holds it. A manifest is put in place by one rename, so a reader sees a
version whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.operators.collections import apply_workload, upsert

BUCKETS = 64


def start(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write df as the collection below path, in place of what is there."""
    fs, root = _folder(df.sparkSession, path)
    fs.delete(root, True)
    _write_rows(df, path, -1, key, buckets)
    _write_manifest(df.sparkSession, path, -1, dict.fromkeys(_written(df.sparkSession, path, -1), -1))


def rows(spark: SparkSession, path: str, names: str, version: int | None = None) -> DataFrame:
    """The collection below path, as of a version that is still kept, or the latest; names: its columns with their types.

    The versions that are read are fixed here: later changes don't touch them, until compact lets them go.
    """
    return _rows_of(spark, path, names, manifest(spark, path, version))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read, in order."""
    return _numbers(spark, f"{path}/manifest")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """bucket -> version that holds its rows, as of a version, or the latest; empty where there is none."""
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"version {version} isn't among {known}")
    if not known:
        return {}
    told = spark.read.schema("bucket int, held int").parquet(f"{path}/manifest/_version={known[-1] if version is None else version}")
    return {r[0]: r[1] for r in told.collect()}  # a row a bucket


def merge_upserts(changes: DataFrame, path: str, names: str, key: str, order_col: str, number: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """Put the latest change of each key in place; returns the buckets that were rewritten."""
    return _merged(changes, path, names, key, number, buckets, lambda held, new: upsert(held, new, key, order_col))


def merge_workload(ops: DataFrame, path: str, names: str, key: str, order_col: str, number: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """Apply inserts, updates and deletes, the last one of each key; returns the buckets that were rewritten."""
    return _merged(ops, path, names, key, number, buckets, lambda held, new: apply_workload(held, new, key, order_col))


def _merged(changes: DataFrame, path: str, names: str, key: str, number: int | None, buckets: int, apply) -> list[int]:
    """Version `number` (the next one without it) from the one before it. Run again, it replaces its own work alone."""
    spark = changes.sparkSession
    changes = changes.persist()
    try:
        touched = sorted(r[0] for r in changes.select(_bucket(key, buckets)).distinct().collect())  # no more than buckets
        known = versions(spark, path)
        number = max(known, default=-1) + 1 if number is None else number
        earlier = [v for v in known if v < number]
        live = manifest(spark, path, earlier[-1]) if earlier else {}
        held = _rows_of(spark, path, names, {b: live[b] for b in touched if b in live})
        _write_rows(apply(held, changes), path, number, key, buckets)
    finally:
        changes.unpersist()
    now = {b: v for b, v in live.items() if b not in touched} | dict.fromkeys(_written(spark, path, number), number)
    _write_manifest(spark, path, number, now)
    return touched


def compact(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Keep the last `keep` versions: drop older manifests, and the buckets' rows that no kept version names.

    Readers of dropped versions must be through.
    """
    if keep < 1:
        raise ValueError("one version is kept at least")
    known = versions(spark, path)
    kept = {(v, b) for version in known[-keep:] for b, v in manifest(spark, path, version).items()}
    fs, _ = _folder(spark, path)
    for version in known[:-keep]:
        fs.delete(_folder(spark, f"{path}/manifest/_version={version}")[1], True)
    for version in _numbers(spark, f"{path}/rows"):
        if known and version > known[-1]:  # being written
            continue
        for bucket in _written(spark, path, version):
            if (version, bucket) not in kept:
                fs.delete(_folder(spark, f"{path}/rows/_version={version}/_bucket={bucket}")[1], True)
        if not _written(spark, path, version):
            fs.delete(_folder(spark, f"{path}/rows/_version={version}")[1], True)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")


def _write_rows(df: DataFrame, path: str, number: int, key: str, buckets: int) -> None:
    told = df.select("*", _bucket(key, buckets)).repartition("_bucket")
    told.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows/_version={number}")


def _write_manifest(spark: SparkSession, path: str, number: int, held: dict[int, int]) -> None:
    fs, aside = _folder(spark, f"{path}/aside-{uuid.uuid4().hex}")
    spark.createDataFrame(sorted(held.items()), "bucket int, held int").coalesce(1).write.parquet(aside.toString())
    _, target = _folder(spark, f"{path}/manifest/_version={number}")
    fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if not fs.rename(aside, target):
        raise OSError(f"{target.toString()} could not be put in place")


def _rows_of(spark: SparkSession, path: str, names: str, held: dict[int, int]) -> DataFrame:
    """The rows of the given versions of buckets; no other folder is listed or read."""
    if not held:
        return spark.createDataFrame([], names)
    return spark.read.schema(names).parquet(*(f"{path}/rows/_version={v}/_bucket={b}" for b, v in sorted(held.items())))


def _written(spark: SparkSession, path: str, version: int) -> list[int]:
    return _numbers(spark, f"{path}/rows/_version={version}")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers n of folders name=n below path, in order."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    names = (str(f.getPath().getName()) for f in fs.listStatus(root))
    return sorted(int(n.split("=")[1]) for n in names if "=" in n)


def _folder(spark: SparkSession, path: str) -> tuple:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found
