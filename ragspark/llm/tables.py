"""Reading inputs and cutting lineage, shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.storage import shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(df: DataFrame) -> None:
    """Delete the files of a frame made by written() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_key(text: str | Column = "text") -> Column:
    """128-bit key of a text (null counts as empty), to join results back to every row that holds the text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def first_by_hash(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """k rows of df, the first by a hash of keys (all rows where there are no more).

    A threshold on the hash leaves little more than k rows before they are ordered, however many partitions
    there are.
    """
    h = F.xxhash64(*keys)
    n, some = df.count(), df
    if n > 2 * k:
        share = 1.5 * k / n + 100 / n
        near = df.where(h < F.lit(int(-(2**63) + min(share, 1.0) * (2**64 - 1))))
        some = near if near.count() >= k else df
    return some.orderBy(h, *keys).limit(k)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
