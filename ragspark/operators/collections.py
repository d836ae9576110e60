"""Collections of vectors and texts: ids, changes, filters, inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.operators.position import with_position


def pair_vectors(chunks: DataFrame, vectors: DataFrame, chunk_order: str, vector_order: str, strict: bool = True) -> DataFrame:
    """The i-th chunk beside the i-th vector. strict: ValueError where the numbers differ; else up to the shorter."""
    if strict and (a := chunks.count()) != (b := vectors.count()):
        raise ValueError(f"{a} chunks and {b} vectors")
    return with_position(chunks, chunk_order).join(with_position(vectors, vector_order), "position")


def assign_ids(df: DataFrame, order_by: str, start: int = 0) -> DataFrame:
    """df with consecutive ids that go on from a counter."""
    return with_position(df, order_by, start, "id")


def latest(changes: DataFrame, key: str, order_col: str) -> DataFrame:
    """The last change of each key; the changes that tie in order_col are settled by the other columns.

    An aggregate, so that a key with very many changes is reduced before the shuffle.
    """
    others = [c for c in changes.columns if c not in (key, order_col)]
    last = changes.groupBy(key).agg(F.max(F.struct(order_col, *others)).alias("_last"))
    return last.select(key, "_last.*").select(changes.columns)


def upsert(target: DataFrame, changes: DataFrame, key: str, order_col: str) -> DataFrame:
    """target with changes inserted or put in place by key, the latest of each key; order_col isn't kept."""
    last = latest(changes, key, order_col).select(target.columns)
    return target.join(last.select(key), key, "left_anti").select(target.columns).unionByName(last)


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti").select(target.columns)


def apply_workload(target: DataFrame, ops: DataFrame, key: str, order_col: str, op_col: str = "op") -> DataFrame:
    """target after a log of insert, update and delete operations: the last one of each key decides.

    An update of a key that isn't there inserts it. Operations of other names are left out.
    """
    last = latest(ops.where(F.col(op_col).isin("insert", "update", "delete")), key, order_col)
    stay = target.join(last.select(key), key, "left_anti").select(target.columns)
    return stay.unionByName(last.where(F.col(op_col) != "delete").select(target.columns))


def filter_query(df: DataFrame, predicate: str | Column, fields: list[str], limit: int = 10, key: str = "id") -> DataFrame:
    """The first `limit` rows by key that meet a predicate, projected."""
    return df.where(predicate).orderBy(key).limit(limit).select(*fields)


def collection_stats(collections: dict[str, DataFrame], vector_cols: dict[str, str] | None = None) -> DataFrame:
    """(name, n_rows, dim) of each collection; dim is null without vectors."""
    out = None
    for name, df in sorted(collections.items()):
        vec = (vector_cols or {}).get(name)
        dim = F.max(F.size(vec)) if vec else F.lit(None)
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), dim.cast("int").alias("dim")).select(F.lit(name).alias("name"), "n_rows", "dim")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no collections")
    return out
