"""Slices and prefixes of an ordered table that read the rows of the slice, not the table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.operators.position import with_position

#: rows up to which the first ones are kept by each task and merged; beyond, ranges of the key are read
TOP_ROWS = 10_000
#: keys that tell where a rank lies about
SAMPLE_KEYS = 10_000


def _sample(df: DataFrame, key: str, total: int) -> list[Any]:
    """Up to about 2 * SAMPLE_KEYS keys of df that aren't null, in order; only the key column is read."""
    some = df.select(key).where(F.col(key).isNotNull())
    some = some if total <= SAMPLE_KEYS else some.sample(1.5 * SAMPLE_KEYS / total, seed=42).limit(2 * SAMPLE_KEYS)
    return sorted(r[0] for r in some.collect())


def _below(key: str, bound: Any) -> Column:
    """Whether a row comes before the bound: a null key comes before all."""
    return F.col(key).isNull() | (F.col(key) < F.lit(bound))


def bracket(df: DataFrame, key: str, start: int, end: int, total: int) -> tuple[Any, Any, int]:
    """(low, high, before): keys between which the rows of ranks [start, end) lie, and the number of rows below low.

    None for low or high where nothing bounds that side. A sorted sample of keys proposes the bounds; one pass
    over the key column counts exactly how many rows lie below them, and bounds that miss the ranks are moved out.
    """
    keys = _sample(df, key, total)
    away = 2 / max(len(keys), 1) ** 0.5  # four times the error of a rank in the sample
    while True:
        at = [int(len(keys) * share) for share in (start / total - away, end / total + away)]
        low = keys[at[0]] if at[0] > 0 and at[0] < len(keys) else None
        high = keys[at[1]] if 0 <= at[1] < len(keys) else None
        under = F.lit(0) if low is None else F.count_if(_below(key, low))
        upto = F.lit(total) if high is None else F.count_if(_below(key, high) | (F.col(key) == F.lit(high)))
        before, through = df.select(key).agg(under.alias("a"), upto.alias("b")).first()
        if before <= start and through >= end:
            return low, high, before
        away *= 4


def _between(df: DataFrame, key: str, low: Any, high: Any) -> DataFrame:
    """Rows with low <= key <= high; without low those of null keys too."""
    if high is not None:
        df = df.where((F.col(key) <= F.lit(high)) if low is not None else F.col(key).isNull() | (F.col(key) <= F.lit(high)))
    return df if low is None else df.where(F.col(key) >= F.lit(low))


def ranked_slice(df: DataFrame, start: int, end: int, order_by: str, total: int) -> DataFrame:
    """The rows of ranks [start, end) of df's total rows in the order of order_by, nulls first.

    Near the beginning: the first `end` rows, of which each task keeps its own. Else only rows whose key lies
    in the range of the slice are read (a filter that reaches Parquet's statistics), ordered and counted off.
    Rows that tie in order_by come in any order.
    """
    if end <= TOP_ROWS:
        return df.orderBy(order_by).offset(start).limit(end - start)
    low, high, before = bracket(df, order_by, start, end, total)
    near = _between(df, order_by, low, high)
    if end - before <= 4 * TOP_ROWS:
        return near.orderBy(order_by).offset(start - before).limit(end - start)
    placed = with_position(near, order_by, before, "_pos")
    return placed.where((F.col("_pos") >= start) & (F.col("_pos") < end)).drop("_pos")


def prefix(df: DataFrame, n: int, order_by: str, total: int) -> DataFrame:
    """The first n of df's total rows in the order of order_by: all rows below a key, unordered, and as many at the edge as it takes."""
    if n >= total:
        return df
    if n <= TOP_ROWS:
        return df.orderBy(order_by).limit(n)
    low, high, before = bracket(df, order_by, n - 1, n, total)
    edge = ranked_slice(_between(df, order_by, low, high), 0, n - before, order_by, total)
    return edge if low is None else df.where(_below(order_by, low)).unionByName(edge)
