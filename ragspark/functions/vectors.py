"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: str | Column) -> Column:
    return F.sqrt(_total(F.transform(_double(v), lambda x: x * x)))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def similarity(metric: str, a: str | Column, b: str | Column) -> Column:
    """L2 (squared, smaller is nearer), IP or COSINE (larger is nearer)."""
    if metric == "L2":
        return squared_distance(a, b)
    if metric == "IP":
        return dot(a, b)
    if metric == "COSINE":
        return dot(a, b) / (norm(a) * norm(b))
    raise ValueError(f"metric {metric}: L2, IP and COSINE are known")


def best_first(metric: str, score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return score.asc() if metric == "L2" else score.desc()


def unit(v: str | Column) -> Column:
    """v of length one; null where its norm is zero or not a number."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n), F.transform(_double(v), lambda x: x / n))
