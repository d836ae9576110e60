"""Text logs of runs: stage tags, round timings, batch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND_COLUMNS = ("embed_ns", "retrieve_ns", "rerank_ns", "prompt_ns", "generate_ns", "total_ns")


def _run_id():
    """The folder that a file lies in."""
    return F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)


def read_stage_log(spark: SparkSession, glob: str) -> DataFrame:
    """(run_id, tag, ts_ns) of lines `tag, nanoseconds`; other lines are skipped. The run is the file's folder."""
    tag, rest = F.substring_index("value", ",", 1), F.substring_index("value", ",", -1)
    # cut at the one comma without patterns; a line has little else to do
    one_comma = F.length("value") == F.length(tag) + F.length(rest) + 1
    rows = spark.read.text(glob).where(F.contains("value", F.lit(",")) & one_comma)
    rows = rows.select(_run_id().alias("run_id"), F.trim(tag).alias("tag"), F.trim(rest).try_cast("bigint").alias("ts_ns"))
    return rows.where("tag <> '' and ts_ns is not null")


def read_round_stats(spark: SparkSession, glob: str) -> DataFrame:
    """(run_id, round, *_ns) of tab-separated timings; the form without rerank (6 columns) gets rerank 0."""
    p = F.split(F.trim("value"), "\t")
    rows = spark.read.text(glob).select(_run_id().alias("run_id"), p.alias("p")).where("size(p) in (6, 7)")
    full = F.when(F.size("p") == 7, F.col("p")).otherwise(F.concat(F.slice("p", 1, 3), F.array(F.lit("0")), F.slice("p", 4, 3)))
    rows = rows.select("run_id", F.transform(full, lambda x: x.try_cast("bigint")).alias("n")).where("forall(n, x -> x is not null)")
    return rows.select("run_id", F.col("n")[0].alias("round"), *(F.col("n")[i + 1].alias(c) for i, c in enumerate(ROUND_COLUMNS)))


def read_batch_logs(spark: SparkSession, glob: str) -> DataFrame:
    """(file_name, value): lines of batch logs, for token_size_histogram."""
    return spark.read.text(glob).select(F.col("_metadata.file_name").alias("file_name"), "value")
