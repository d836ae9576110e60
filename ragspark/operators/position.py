"""Global row positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.storage import written

_IN_PARTITION = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def with_position(df: DataFrame, order_by: str | list[str], start: int = 0, name: str = "position") -> DataFrame:
    """df with consecutive positions from `start`, in the order of order_by.

    Range partitions are sorted and numbered on their own; only the partitions' row counts reach the driver.
    Rows that tie in order_by follow each other in any order: name an id last where that matters, and where one
    value is frequent, as ties stay in one partition. A column called `name` already is replaced.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    place, part = _unused(df, "_place"), _unused(df, "_part")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    ranged = written(ranged).withColumn(part, F.shiftright(place, 33))
    sizes = dict(ranged.groupBy(part).count().collect())
    offsets, total = [], start
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    first = _unused(df, "_first")
    found = ranged.join(F.broadcast(df.sparkSession.createDataFrame(offsets, f"{part} long, {first} long")), part)  # a row a partition
    at = F.col(first) + F.col(place).bitwiseAND(F.lit(_IN_PARTITION))
    return found.withColumn(name, at.cast("long")).select(*(c for c in df.columns if c.lower() != name.lower()), name)


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
