"""Stage timing: intervals, breakdowns, rounds, throughput and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("embed", "retrieve", "rerank", "prompt", "generate")


def stage_intervals(stages: DataFrame) -> DataFrame:
    """stages(run_id, seq, tag, ts_ns) -> with end_ns (the run's next tag; null for the last), dur_ns and start_s from the run's start."""
    run = Window.partitionBy("run_id")
    w = run.orderBy("ts_ns", "seq")
    told = stages.withColumns({"end_ns": F.lead("ts_ns").over(w), "_t0": F.min("ts_ns").over(run)})
    return told.select(
        "run_id", "seq", "tag", "ts_ns", "end_ns", (F.col("end_ns") - F.col("ts_ns")).alias("dur_ns"),
        ((F.col("ts_ns") - F.col("_t0")) / 1e9).alias("start_s"),
    )


def stage_breakdown(intervals: DataFrame) -> DataFrame:
    """(run_id, tag, n, total_ns, mean_ns, percent of the run); intervals without end don't count."""
    per = intervals.where("dur_ns is not null").groupBy("run_id", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dur_ns").alias("total_ns"), F.avg("dur_ns").alias("mean_ns")
    )
    whole = F.sum("total_ns").over(Window.partitionBy("run_id"))
    return per.withColumn("percent", F.when(whole > 0, F.col("total_ns") * 100.0 / whole))


def round_shares(stats: DataFrame) -> DataFrame:
    """Round stats (*_ns columns of STAGES, a missing rerank counts 0) -> (run_id, round, total_ns, stage, stage_ns, share)."""
    cols = [F.coalesce(F.col(f"{s}_ns"), F.lit(0)).cast("long").alias(s) if f"{s}_ns" in stats.columns else F.lit(0).cast("long").alias(s) for s in STAGES]
    wide = stats.select("run_id", "round", *cols)
    total = sum((F.col(s) for s in STAGES[1:]), F.col(STAGES[0]))
    long = wide.withColumn("total_ns", total).unpivot(["run_id", "round", "total_ns"], list(STAGES), "stage", "stage_ns")
    return long.withColumn("share", F.when(F.col("total_ns") > 0, F.col("stage_ns") / F.col("total_ns")))


def round_index(intervals: DataFrame, opens: str = "embed") -> DataFrame:
    """intervals with `round`: 0 before the first tag `opens` of a run, then one more at each."""
    w = Window.partitionBy("run_id").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return intervals.withColumn("round", F.sum(F.when(F.col("tag") == opens, 1).otherwise(0)).over(w))


def percentile(value: str, share: float, accuracy: int | None = None) -> Column:
    """Exact interpolated percentile, or with an accuracy a value of the group whose rank is off by 1 / accuracy at most.

    The exact form keeps all distinct values of a group; the sketch keeps some multiple of `accuracy` numbers,
    is merged across tasks, and suits groups of any size.
    """
    return F.percentile(value, F.lit(share)) if accuracy is None else F.percentile_approx(value, share, accuracy)


def throughput_latency(rounds: DataFrame, accuracy: int | None = None) -> DataFrame:
    """rounds(run_id, n_queries, total_ns) -> queries a second, and the rounds' p50, p95, p99 in ms (exact, or see percentile)."""
    p = lambda q: (percentile("total_ns", q, accuracy) / 1e6).alias(f"p{round(q * 100)}_ms")
    return rounds.groupBy("run_id").agg(
        F.when(F.sum("total_ns") > 0, F.sum("n_queries") * 1e9 / F.sum("total_ns")).alias("queries_per_s"), p(0.5), p(0.95), p(0.99)
    )


def token_size_histogram(logs: DataFrame) -> DataFrame:
    """logs(file_name, value) -> (batch, size, n): how often each largest token size comes, by batch size of the file's name."""
    batch = F.regexp_extract("file_name", "wiki_batch_(\\d+)\\.log$", 1)
    size = F.regexp_extract("value", "Max Token Size in Batch:\\s*(\\d+)", 1)
    told = logs.select(batch.alias("batch"), size.alias("size")).where("batch <> '' and size <> ''")
    return told.groupBy(F.col("batch").cast("int").alias("batch"), F.col("size").cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"))
