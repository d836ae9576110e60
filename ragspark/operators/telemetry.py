"""Telemetry: counters to rates, gauges to series, samples tagged with the stage that was active.

Every window is partitioned by run and device, so that all of them share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.operators.stages import percentile

CPU_COUNTERS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice")


def _joined(df: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """df beside the row of spans of its keys and span; null keys are equal."""
    by = [*keys, "_span"]
    right = spans.withColumnsRenamed({k: f"_of_{k}" for k in by})
    return df.join(right, [df[k].eqNullSafe(right[f"_of_{k}"]) for k in by]).drop(*(f"_of_{k}" for k in by))


def _spanned(df: DataFrame, ts: str, bucket: int) -> DataFrame:
    return df.withColumn("_span", F.floor(F.col(ts) / bucket))


def with_previous(df: DataFrame, keys: list[str], ts: str, cols: list[str], bucket: int | None = None) -> DataFrame:
    """df with `_prev`: ts and cols of the device's sample before, null for its first one.

    With a bucket (in units of ts) each device's series is cut into spans of that length, and the last sample of
    a span is carried into the next one, so that no series is one task's work: only a row a span is ordered by
    device.
    """
    here = F.struct(F.col(ts).alias("ts"), *cols)
    if not bucket:
        return df.withColumn("_prev", F.lag(here).over(Window.partitionBy(*keys).orderBy(ts)))
    cut = _spanned(df, ts, bucket)
    ends = cut.groupBy(*keys, "_span").agg(F.max(here).alias("_end"))
    carried = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_span"))).drop("_end")
    told = _joined(cut, carried, keys)
    before = F.lag(here).over(Window.partitionBy(*keys, "_span").orderBy(ts))
    return told.withColumn("_prev", F.coalesce(before, "_carried")).drop("_span", "_carried")


def counter_delta(df: DataFrame, keys: list[str], ts: str, cols: list[str], first: str = "drop", bucket: int | None = None) -> DataFrame:
    """df with <col>_delta: the difference to the device's sample before. first: drop the first sample, or "zero".

    With a bucket no series is one task's work (see with_previous).
    """
    if first not in ("drop", "zero"):
        raise ValueError("first is drop or zero")
    told = with_previous(df, keys, ts, cols, bucket)
    told = told.withColumns({f"{c}_delta": F.col(c) - F.col(f"_prev.{c}") for c in cols})
    if first == "drop":
        told = told.where("_prev is not null")
    else:
        told = told.withColumns({f"{c}_delta": F.coalesce(f"{c}_delta", F.col(c) - F.col(c)) for c in cols})
    return told.drop("_prev")


def cpu_percent(df: DataFrame, keys: list[str], ts: str, counters: list[str] | tuple[str, ...] = CPU_COUNTERS, bucket: int | None = None) -> DataFrame:
    """<counter>_pct: each counter's share of all deltas, times 100; null where nothing moved. The first sample goes."""
    told = counter_delta(df, keys, ts, list(counters), bucket=bucket)
    total = sum((F.col(f"{c}_delta") for c in counters[1:]), F.col(f"{counters[0]}_delta"))
    return told.withColumns({f"{c}_pct": F.when(total != 0, F.col(f"{c}_delta") * 100.0 / total) for c in counters}).drop(
        *(f"{c}_delta" for c in counters)
    )


def with_row_number(df: DataFrame, keys: list[str], ts: str, bucket: int, name: str = "_row") -> DataFrame:
    """df with each sample's number in its device's series, from 0: its number in a span, and the rows of the spans before."""
    cut = _spanned(df, ts, bucket)
    sizes = cut.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(ts)) - 1
    return _joined(cut, starts, keys).withColumn(name, F.col("_start") + within).drop("_span", "_start")


def smooth(df: DataFrame, col: str, keys: list[str], ts: str, w: int = 5, bucket: int | None = None, block_rows: int = 65_536) -> DataFrame:
    """<col>_smooth: the sum over w centred rows divided by w always, so that the ends are padded with zeros.

    With a bucket (in units of ts) the series is numbered by spans and cut into blocks of block_rows; the rows
    that a neighbouring block's frames reach are copied there, and give no row of their own.
    """
    if w % 2 == 0:
        raise ValueError("w is odd")
    reach = w // 2
    if not bucket:
        rows = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-reach, reach)
        return df.withColumn(f"{col}_smooth", F.sum(col).over(rows) / w)
    block_rows = max(block_rows, w)
    at = F.floor(F.col("_row") / block_rows)
    inside = F.col("_row") % block_rows
    copies = F.array_compact(F.array(at, F.when((inside < reach) & (at > 0), at - 1), F.when(inside >= block_rows - reach, at + 1)))
    dealt = with_row_number(df, keys, ts, bucket).withColumns({"_own": at, "_block": F.explode(copies)})
    rows = Window.partitionBy(*keys, "_block").orderBy("_row").rowsBetween(-reach, reach)
    return dealt.withColumn(f"{col}_smooth", F.sum(col).over(rows) / w).where("_own = _block").drop("_row", "_own", "_block")


def rate_mb_s(df: DataFrame, keys: list[str], ts_ns: str = "ts_ns", cols: tuple[str, ...] = ("sectors_read", "sectors_written"), bucket: int | None = None) -> DataFrame:
    """<col>_mb_s from counters of half-KiB sectors; null for a device's first sample and where no time passed."""
    told = with_previous(df, keys, ts_ns, list(cols), bucket)
    dt = F.col(ts_ns) - F.col("_prev.ts")
    return told.withColumns({f"{c}_mb_s": F.when(dt > 0, (F.col(c) - F.col(f"_prev.{c}")) * 1e9 * 0.5 / 1024 / dt) for c in cols}).drop("_prev")


def relative_seconds(df: DataFrame, keys: list[str], ts_ns: str = "ts_ns", base: int = 1, bucket: int | None = None) -> DataFrame:
    """rel_s from the device's first sample; with base=2 from its second, which leaves the first negative.

    With a bucket the base comes from the first samples of each span, and is handed to all spans of the device.
    """
    if not bucket:
        w = Window.partitionBy(*keys).orderBy(ts_ns).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumn("rel_s", (F.col(ts_ns) - F.nth_value(ts_ns, base).over(w)) / 1e9)
    cut = _spanned(df, ts_ns, bucket)
    nth = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy("_t"))
    few = cut.select(*keys, "_span", F.col(ts_ns).alias("_t")).withColumn("_n", nth).where(F.col("_n") <= base)
    device = Window.partitionBy(*keys)
    spans = few.groupBy(*keys, "_span").agg(F.collect_list("_t").alias("_ts"))  # `base` at most
    first = F.row_number().over(device.orderBy("_span"))
    early = F.when(first <= base, F.col("_ts"))  # the base-th sample lies in the first `base` spans
    spans = spans.withColumn("_few", early).withColumn("_t0", F.get(F.array_sort(F.flatten(F.collect_list("_few").over(device))), F.lit(base - 1)))
    return _joined(cut, spans.select(*keys, "_span", "_t0"), keys).withColumn("rel_s", (F.col(ts_ns) - F.col("_t0")) / 1e9).drop("_span", "_t0")


def memory_gib(df: DataFrame, run: str = "run_id", ts_ns: str = "ts_ns", assumed_rate: bool = False) -> DataFrame:
    """meminfo groups in KiB -> (run, t, free, available, buffers, cached in GiB).

    t is true seconds from the run's start; with assumed_rate, the sample's number by tens (100 ms a sample).
    """
    w = Window.partitionBy(run).orderBy(ts_ns)
    t = F.floor((F.row_number().over(w) - 1) / 10).cast("double") if assumed_rate else (F.col(ts_ns) - F.min(ts_ns).over(Window.partitionBy(run))) / 1e9
    gib = lambda c, name: (F.col(c) / (1024.0 * 1024.0)).alias(name)
    return df.select(
        run, t.alias("t"), gib("meminfo.basic.mem_free", "free_gib"), gib("meminfo.basic.mem_available", "available_gib"),
        gib("meminfo.kernel_cache.buffers", "buffers_gib"), gib("meminfo.kernel_cache.cached", "cached_gib"),
    )


def gpu_long(df: DataFrame, probe_names: list[str], values: str = "nvml", gpus: str = "per_gpu") -> DataFrame:
    """Samples with an array of GPUs, each with an array of metrics -> (run_id, ts_ns, gpu, probe, value)."""
    each = df.select("run_id", "ts_ns", F.posexplode(gpus).alias("gpu", "g"))
    each = each.select("run_id", "ts_ns", "gpu", F.posexplode(F.col("g")[values]).alias("at", "value"))
    names = F.array(*map(F.lit, probe_names))
    return each.select("run_id", "ts_ns", "gpu", F.coalesce(F.get(names, "at"), F.format_string("probe_%d", "at")).alias("probe"), "value")


def gpu_wide(long: DataFrame, probe_names: list[str]) -> DataFrame:
    return long.groupBy("run_id", "ts_ns", "gpu").pivot("probe", probe_names).agg(F.first("value"))


def gpu_process_memory_stack(df: DataFrame) -> DataFrame:
    """(run_id, gpu, ts_ns, slot, used_bytes) -> with gib and stacked_gib over the slots at each time.

    Slots that are zero for the whole run are left out.
    """
    used = F.max("used_bytes").over(Window.partitionBy("run_id", "gpu", "slot")) > 0
    told = df.withColumn("_used", used).where("_used").withColumn("gib", F.col("used_bytes") / 1024.0**3)
    w = Window.partitionBy("run_id", "gpu", "ts_ns").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return told.select("run_id", "gpu", "ts_ns", "slot", "gib", F.sum("gib").over(w).alias("stacked_gib"))


def tag_samples(samples: DataFrame, stages: DataFrame, bucket: int | None = None) -> DataFrame:
    """samples(run_id, ts_ns, ...), stages(run_id, ts_ns, tag) -> samples with the stage active at each (`stage`).

    A stage holds from its time to before the next one's; samples before the first stage get null. One sort
    by run and time carries the last tag forward; there is no range join. With a bucket (ns) each run is cut
    into spans of that length and the last tag before a span is carried into it, so that no run is one
    task's work.
    """
    marks = stages.select("run_id", "ts_ns", F.col("tag").alias("_tag"), F.lit(0).alias("_side"))
    both = samples.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    keys = ["run_id"]
    if bucket:
        both, keys = both.withColumn("_span", F.floor(F.col("ts_ns") / bucket)), ["run_id", "_span"]
    w = Window.partitionBy(*keys).orderBy("ts_ns", "_side").rowsBetween(Window.unboundedPreceding, 0)
    tagged = both.withColumn("stage", F.last("_tag", ignorenulls=True).over(w))
    if bucket:
        ends = both.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.struct("ts_ns", "_tag"))).alias("_end"))
        earlier = Window.partitionBy("run_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, F.last("_end", ignorenulls=True).over(earlier)["_tag"].alias("_carried"))
        tagged = tagged.where("_side = 1").join(ends, keys).withColumn("stage", F.coalesce("stage", "_carried"))
    return tagged.where("_side = 1").select(*samples.columns, "stage")


def stage_resource_summary(tagged: DataFrame, metric: str = "metric", value: str = "value", accuracy: int | None = None) -> DataFrame:
    """(run_id, stage, metric, n, avg, max, p95) of tagged samples.

    p95 is exact and interpolated, which holds every distinct value of a group; with an accuracy it comes from a
    mergeable sketch of bounded size a group, and is a value whose rank is off by 1 / accuracy of the group's
    rows at most.
    """
    return tagged.groupBy("run_id", "stage", metric).agg(
        F.count(value).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"), percentile(value, 0.95, accuracy).alias("p95")
    )


def proc_long(df: DataFrame) -> DataFrame:
    """Samples with an array of processes -> one row a process; stat, statm and io may be missing.

    Feed utime, stime and the byte counters to counter_delta for CPU time and I/O.
    """
    each = df.select("run_id", "ts_ns", F.posexplode_outer("per_proc").alias("proc", "p"))
    fields = {"stat": ("utime", "stime"), "statm": ("resident",), "io": ("read_bytes", "write_bytes")}
    return each.select("run_id", "ts_ns", "proc", *(F.col(f"p.{g}.{f}").alias(f) for g, fs in fields.items() for f in fs))
