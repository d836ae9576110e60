"""String helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(_col(text)), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def token_set(text: str | Column) -> Column:
    return F.array_distinct(tokens(text))


def sanitized_name(name: str | Column, lower: bool = False) -> Column:
    """Runs of characters other than letters, digits and _ as one _."""
    clean = F.regexp_replace(_col(name), "[^\\p{L}\\p{N}_]+", "_")
    return F.lower(clean) if lower else clean


def overlap_share(wanted: Column, present: Column) -> Column:
    """Share of distinct wanted tokens that are present; 0 where nothing is wanted."""
    wanted = F.array_distinct(wanted)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, present)) / F.size(wanted)).otherwise(F.lit(0.0))


def epoch_ns(ts: str | Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    ts = _col(ts)
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long") * 1000
