"""Queries of stage timing, telemetry and streams, over the events table.

A user plays a run or device, an event type a stage tag, an event's value a gauge, its running sum a counter.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragspark.functions.text import epoch_ns
from ragspark.operators import buckets, stages, telemetry
from ragspark.operators.ann import choose_nprobe, ivf_build, probe_curve
from ragspark.operators.collections import apply_workload
from ragspark.operators.encoding import HashingEncoder, encode
from ragspark.operators.search import knn_exact
from ragspark.plans.corpus_queries import OPS
from ragspark.plans.registry import query, table
from ragspark.sources import frames, logs
from ragspark.storage import scratch, written
from ragspark.streaming import jobs

_EVENTS = "(select event_id, user_id as run_id, event_type as tag, epoch_us(ts) * 1000 as ts_ns, value from events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("tag"), epoch_ns("ts").alias("ts_ns"), "value"
    )


_INTERVALS = f"""(select run_id, event_id as seq, tag, ts_ns, lead(ts_ns) over w as end_ns, lead(ts_ns) over w - ts_ns as dur_ns,
    (ts_ns - min(ts_ns) over (partition by run_id)) / 1e9 as start_s from {_EVENTS} window w as (partition by run_id order by ts_ns, event_id))"""


@query(f"select run_id, seq, tag, ts_ns, end_ns, dur_ns, round(start_s, 6) as start_s from {_INTERVALS}")
def h1_stage_intervals(spark, sf_dir):
    return stages.stage_intervals(_events(spark, sf_dir)).withColumn("start_s", F.round("start_s", 6))


@query(f"""select run_id, tag, n, total_ns::bigint as total_ns, floor(mean_ns)::bigint as mean_ns, round(total_ns * 100.0 / sum(total_ns) over (partition by run_id), 4) as percent from (
    select run_id, tag, count(*) as n, sum(dur_ns) as total_ns, avg(dur_ns) as mean_ns from {_INTERVALS} where dur_ns is not null group by all)""")
def h2_stage_breakdown(spark, sf_dir):
    found = stages.stage_breakdown(stages.stage_intervals(_events(spark, sf_dir)))
    return found.select("run_id", "tag", "n", "total_ns", F.floor("mean_ns").cast("long").alias("mean_ns"), F.round("percent", 4).alias("percent"))


#: an event type as the stage of a round
_STAGE = {"signup": "embed", "view": "retrieve", "click": "rerank", "purchase": "prompt", "error": "generate"}
_CASE = "case tag " + " ".join(f"when '{k}' then '{v}'" for k, v in _STAGE.items()) + " end"


def _rounds(spark, sf_dir):
    """Time of each stage in each round, rounds opened by the embed tag."""
    tagged = stages.stage_intervals(_events(spark, sf_dir)).withColumn("tag", F.expr(_CASE))
    found = stages.round_index(tagged).where("round > 0 and dur_ns is not null")
    return found.groupBy("run_id", "round").pivot("tag", list(_STAGE.values())).agg(F.sum("dur_ns"))


_ROUNDED = f"""(select *, sum((stage = 'embed')::int) over (partition by run_id order by ts_ns, seq rows unbounded preceding) as round
    from (select *, {_CASE} as stage from {_INTERVALS}))"""
_TIMES = f"(select run_id, round::bigint as round, stage, sum(dur_ns)::bigint as stage_ns from {_ROUNDED} where round > 0 and dur_ns is not null group by all)"
_TOTALS = f"(select run_id, round, sum(stage_ns)::bigint as total_ns from {_TIMES} group by all)"


@query(f"""select t.run_id, t.round, t.total_ns, s.stage, coalesce(x.stage_ns, 0) as stage_ns, round(coalesce(x.stage_ns, 0) / t.total_ns, 4) as share
    from {_TOTALS} t cross join (values {", ".join(f"('{v}')" for v in _STAGE.values())}) s(stage) left join {_TIMES} x using (run_id, round, stage)""")
def h3_round_shares(spark, sf_dir):
    rounds = _rounds(spark, sf_dir)
    named = rounds.select("run_id", "round", *(F.col(s).alias(f"{s}_ns") for s in _STAGE.values()))
    return stages.round_shares(named).withColumn("share", F.round("share", 4))


@query(f"select run_id, seq, stage as tag, round::bigint as round from {_ROUNDED}")
def h4_round_index(spark, sf_dir):
    tagged = stages.stage_intervals(_events(spark, sf_dir)).withColumn("tag", F.expr(_CASE))
    return stages.round_index(tagged).select("run_id", "seq", "tag", "round")


@query(f"""select run_id, round(count(*) * 64 * 1e9 / sum(total_ns), 6) as queries_per_s, floor(quantile_cont(total_ns, 0.5) / 1e6)::bigint as p50_ms,
    floor(quantile_cont(total_ns, 0.95) / 1e6)::bigint as p95_ms, floor(quantile_cont(total_ns, 0.99) / 1e6)::bigint as p99_ms from {_TOTALS} group by run_id""")
def h5_throughput_latency(spark, sf_dir):
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in list(_STAGE.values())[1:]), F.coalesce(F.col("embed"), F.lit(0)))
    rounds = _rounds(spark, sf_dir).select("run_id", F.lit(64).alias("n_queries"), total.alias("total_ns"))
    found = stages.throughput_latency(rounds)
    return found.select("run_id", F.round("queries_per_s", 6).alias("queries_per_s"), *(F.floor(f"p{p}_ms").cast("long").alias(f"p{p}_ms") for p in (50, 95, 99)))


@query("""select ((doc_id % 4 + 1) * 16)::int as batch, (n_chars // 100)::int as size, count(*) as n from documents group by all""")
def h6_token_size_histogram(spark, sf_dir):
    """Batch logs written from the documents' lengths, one folder and file name a batch size, and read again."""
    path = scratch(spark)
    lines = table(spark, sf_dir, "documents").select(
        F.format_string("wiki_batch_%d.log", (F.col("doc_id") % 4 + 1) * 16).alias("file"),
        F.format_string("step %d Max Token Size in Batch: %d", "doc_id", F.floor(F.col("n_chars") / 100).cast("long")).alias("value"),
    )
    lines.write.partitionBy("file").text(path)
    # Spark chooses the files' own names; the folder has the log's
    read = spark.read.option("recursiveFileLookup", True).text(path)
    read = read.select(F.regexp_extract(F.col("_metadata.file_path"), "file=([^/]+)/", 1).alias("file_name"), "value")
    return stages.token_size_histogram(read)


#: nanoseconds of the spans that the devices' series are cut into
_DAY = 86_400 * 10**9


def _counters(spark, sf_dir):
    w = Window.partitionBy("run_id").orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, sf_dir).withColumn("counter", F.sum(F.round(F.col("value") * 100).cast("long")).over(w))


_COUNTERS = f"(select *, sum(round(value * 100)::bigint) over (partition by run_id order by ts_ns rows unbounded preceding)::bigint as counter from {_EVENTS})"


@query(f"""select run_id, seq, counter_delta from (select run_id, event_id as seq, (counter - lag(counter) over w)::bigint as counter_delta, row_number() over w as n
    from {_COUNTERS} window w as (partition by run_id order by ts_ns)) where n > 1""")
def i1_counter_delta(spark, sf_dir):
    return telemetry.counter_delta(_counters(spark, sf_dir), ["run_id"], "ts_ns", ["counter"], bucket=_DAY).select("run_id", "seq", "counter_delta")


_TYPES = ("click", "error", "purchase", "signup", "view")
_WIDE = f"""(select run_id, ts_ns, event_id as seq, {", ".join(f"sum(case when tag = '{t}' then round(value * 100)::bigint else 0 end) over w as c_{t}" for t in _TYPES)}
    from {_EVENTS} window w as (partition by run_id order by ts_ns rows unbounded preceding))"""


@query(f"""select run_id, seq, {", ".join(f"round(case when t <> 0 then d_{t} * 100.0 / t end, 4) as c_{t}_pct" for t in _TYPES)} from (
    select *, {" + ".join(f"d_{t}" for t in _TYPES)} as t from (select run_id, seq, row_number() over w as n, {", ".join(f"c_{t} - lag(c_{t}) over w as d_{t}" for t in _TYPES)}
    from {_WIDE} window w as (partition by run_id order by ts_ns)) where n > 1)""")
def i2_cpu_percent(spark, sf_dir):
    w = Window.partitionBy("run_id").orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    wide = _events(spark, sf_dir).withColumns({f"c_{t}": F.sum(F.when(F.col("tag") == t, cents).otherwise(0)).over(w) for t in _TYPES})
    found = telemetry.cpu_percent(wide, ["run_id"], "ts_ns", [f"c_{t}" for t in _TYPES], bucket=_DAY)
    return found.select("run_id", "seq", *(F.round(f"c_{t}_pct", 4).alias(f"c_{t}_pct") for t in _TYPES))


@query(f"""select run_id, event_id as seq, round(sum(value) over (partition by run_id order by ts_ns rows between 2 preceding and 2 following) / 5, 4) as value_smooth from {_EVENTS}""")
def i3_smooth(spark, sf_dir):
    found = telemetry.smooth(_events(spark, sf_dir), "value", ["run_id"], "ts_ns", 5, bucket=_DAY, block_rows=50)
    return found.select("run_id", "seq", F.round("value_smooth", 4).alias("value_smooth"))


@query(f"""select run_id, event_id as seq, round((counter - lag(counter) over w) * 1e9 * 0.5 / 1024 / (ts_ns - lag(ts_ns) over w), 8) as counter_mb_s
    from {_COUNTERS} window w as (partition by run_id order by ts_ns)""")
def i4_rate_mb_s(spark, sf_dir):
    found = telemetry.rate_mb_s(_counters(spark, sf_dir), ["run_id"], cols=("counter",), bucket=_DAY)
    return found.select("run_id", "seq", F.round("counter_mb_s", 8).alias("counter_mb_s"))


@query(f"""select run_id, event_id as seq, round((ts_ns - nth_value(ts_ns, 2) over (partition by run_id order by ts_ns rows between unbounded preceding and unbounded following)) / 1e9, 6)
    as rel_s from {_EVENTS}""")
def i5_relative_seconds(spark, sf_dir):
    found = telemetry.relative_seconds(_events(spark, sf_dir), ["run_id"], base=2, bucket=_DAY)
    return found.select("run_id", "seq", F.round("rel_s", 6).alias("rel_s"))


@query(f"""select run_id, ts_ns, round((ts_ns - min(ts_ns) over (partition by run_id)) / 1e9, 6) as t, round(value * 1000 / 1048576.0, 8) as free_gib,
    round(value * 2000 / 1048576.0, 8) as cached_gib from {_EVENTS}""")
def i6_memory_gib(spark, sf_dir):
    kib = lambda n: F.col("value") * n
    rows = _events(spark, sf_dir).withColumn(
        "meminfo",
        F.struct(
            F.struct(kib(1000).alias("mem_free"), kib(1500).alias("mem_available")).alias("basic"),
            F.struct(kib(10).alias("buffers"), kib(2000).alias("cached")).alias("kernel_cache"),
        ),
    )
    found = telemetry.memory_gib(rows)
    times = rows.select("run_id", "ts_ns", F.round((F.col("ts_ns") - F.min("ts_ns").over(Window.partitionBy("run_id"))) / 1e9, 6).alias("t"))
    out = found.select("run_id", F.round("t", 6).alias("t"), F.round("free_gib", 8).alias("free_gib"), F.round("cached_gib", 8).alias("cached_gib"))
    return out.join(times, ["run_id", "t"]).select("run_id", "ts_ns", "t", "free_gib", "cached_gib")


_PROBES = [f"p{i}" for i in range(16)]


@query("""select vec_id as ts_ns, label as run_id, gpu::int as gpu, 'p' || probe as probe, round(embedding[gpu * 16 + probe + 1]::double, 4) as value
    from embeddings, range(4) g(gpu), range(16) p(probe)""")
def i7_gpu_long(spark, sf_dir):
    """An embedding as the metrics of four GPUs, 16 probes each."""
    e = F.col("embedding").cast("array<double>")
    gpus = F.array(*(F.struct(F.slice(e, 16 * g + 1, 16).alias("nvml")) for g in range(4)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run_id"), F.col("vec_id").alias("ts_ns"), gpus.alias("per_gpu"))
    return telemetry.gpu_long(rows, _PROBES).select("run_id", "ts_ns", "gpu", "probe", F.round("value", 4).alias("value"))


@query(f"""select run_id, ts_ns, slot, round(used / 1073741824.0, 10) as gib, round(sum(used / 1073741824.0) over (partition by run_id, ts_ns order by slot rows unbounded preceding), 10) as stacked_gib
    from (select *, max(used) over (partition by run_id, slot) as m from (
      select run_id % 10 as run_id, ts_ns // 3600000000000 as ts_ns, (run_id // 10)::int as slot, sum(case when run_id % 7 = 0 then 0 else round(value * 1000000)::bigint end)::bigint as used
      from {_EVENTS} group by 1, 2, 3)) where m > 0""")
def i8_gpu_process_memory_stack(spark, sf_dir):
    used = F.when(F.col("run_id") % 7 == 0, 0).otherwise(F.round(F.col("value") * 1000000).cast("long"))
    rows = _events(spark, sf_dir).select(
        (F.col("run_id") % 10).alias("run_id"), F.lit(0).alias("gpu"), F.floor(F.col("ts_ns") / 3600000000000).cast("long").alias("ts_ns"),
        F.floor(F.col("run_id") / 10).cast("int").alias("slot"), used.alias("used"),
    )
    rows = rows.groupBy("run_id", "gpu", "ts_ns", "slot").agg(F.sum("used").alias("used_bytes"))
    found = telemetry.gpu_process_memory_stack(rows)
    return found.select("run_id", "ts_ns", "slot", F.round("gib", 10).alias("gib"), F.round("stacked_gib", 10).alias("stacked_gib"))


_TAGGED = f"""(select s.run_id, s.event_id as seq, s.ts_ns, s.tag as metric, s.value, t.tag as stage from (select * from {_EVENTS} where event_id % 2 = 1) s
    asof left join (select * from {_EVENTS} where event_id % 2 = 0) t on s.run_id = t.run_id and s.ts_ns >= t.ts_ns)"""


def _tagged(spark, sf_dir):
    """Odd events as samples, even ones as stage tags."""
    rows = _events(spark, sf_dir)
    samples = rows.where("event_id % 2 = 1").select("run_id", "seq", "ts_ns", F.col("tag").alias("metric"), "value")
    return telemetry.tag_samples(samples, rows.where("event_id % 2 = 0").select("run_id", "ts_ns", "tag"))


@query(f"select run_id, seq, ts_ns, stage from {_TAGGED}")
def i9_tag_samples(spark, sf_dir):
    return _tagged(spark, sf_dir).select("run_id", "seq", "ts_ns", "stage")


@query(f"""select run_id, stage, metric, count(value) as n, round(avg(value), 4) as avg, max(value) as max, round(quantile_cont(value, 0.95), 4) as p95
    from {_TAGGED} group by all""")
def i10_stage_resource_summary(spark, sf_dir):
    found = telemetry.stage_resource_summary(_tagged(spark, sf_dir))
    return found.withColumns({"avg": F.round("avg", 4), "p95": F.round("p95", 4)})


@query(f"""select run_id, stage, metric, count(value) as n, true as within_error from {_TAGGED} group by all""")
def i10_stage_resource_summary_sketch(spark, sf_dir):
    """p95 by a sketch of accuracy 200: whether as many samples as it claims lie up to it and below it, give or take 1/200."""
    tagged = written(_tagged(spark, sf_dir))
    told = telemetry.stage_resource_summary(tagged, accuracy=200).selectExpr("run_id as r", "stage as s", "metric as m", "n", "p95")
    met = tagged.join(told, F.expr("run_id <=> r and stage <=> s and metric <=> m")).select("run_id", "stage", "metric", "n", "p95", "value")
    ranks = met.groupBy("run_id", "stage", "metric", "n").agg(F.count_if(F.col("value") <= F.col("p95")).alias("upto"), F.count_if(F.col("value") < F.col("p95")).alias("under"))
    slack = F.col("n") / 200 + 1
    good = (F.col("upto") >= 0.95 * F.col("n") - slack) & (F.col("under") <= 0.95 * F.col("n") + slack)
    return ranks.select("run_id", "stage", "metric", "n", good.alias("within_error"))


@query(f"""select run_id, ts_ns, p::int as proc, round(value * 100)::bigint * (p + 1) as utime, round(value)::bigint as read_bytes from {_EVENTS}, range(2) r(p)""")
def i11_proc_long(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    proc = lambda n: F.struct(
        F.struct((cents * n).alias("utime"), cents.alias("stime")).alias("stat"),
        F.struct(cents.alias("resident")).alias("statm"),
        F.struct(F.round("value").cast("long").alias("read_bytes"), cents.alias("write_bytes")).alias("io"),
    )
    rows = _events(spark, sf_dir).select("run_id", "ts_ns", F.array(proc(1), proc(2)).alias("per_proc"))
    return telemetry.proc_long(rows).select("run_id", "ts_ns", "proc", "utime", "read_bytes")


@query(f"""select run_id, ts_ns, p::int as disk, round(value * 100)::bigint * (p + 1) as sectors_read, round(value * 100)::bigint as sectors_written
    from {_EVENTS}, range(2) r(p)""")
def a8_read_metric_frames(spark, sf_dir):
    """Events written as frame files, in a folder a run, and read back."""
    path = scratch(spark)
    cents = F.round(F.col("value") * 100).cast("long")
    disk = lambda n: F.struct((cents * n).alias("sectors_read"), cents.alias("sectors_written"))
    rows = _events(spark, sf_dir).select("run_id", "ts_ns", F.array(disk(1), disk(2)).alias("disk_metrics"))
    frames.write_metric_frames(rows, path, "disk")
    found = frames.disk_long(frames.read_metric_frames(spark, f"{path}/*/*.bin", "disk"))
    return found.select(F.col("run_id").cast("long").alias("run_id"), "ts_ns", "disk", "sectors_read", "sectors_written")


@query(f"select 'run=' || run_id as run_id, tag, ts_ns from {_EVENTS}")
def a9_read_stage_log(spark, sf_dir):
    """Events written as stage logs, a folder a run, with broken lines between, and read back."""
    path = scratch(spark)
    rows = _events(spark, sf_dir)
    good = rows.select(F.col("run_id").alias("run"), F.concat_ws(", ", "tag", F.col("ts_ns").cast("string")).alias("value"))
    bad = rows.where("event_id % 5 = 0").select(F.col("run_id").alias("run"), F.lit("no number, here").alias("value"))
    # a named number of tasks: Spark would make one of so few bytes, and each run is a folder to make
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    good.unionByName(bad).repartition(tasks, "run").write.partitionBy("run").text(path)
    return logs.read_stage_log(spark, f"{path}/run=*")


@query(f"""select 'run=' || run_id as run_id, event_id as round, ts_ns as embed_ns, case when event_id % 2 = 0 then 5 else 0 end::bigint as rerank_ns, (ts_ns + 7)::bigint as total_ns
    from {_EVENTS}""")
def a10_read_round_stats(spark, sf_dir):
    """Events written as round timings, every other row in the form without rerank, and read back."""
    path = scratch(spark)
    t = F.col("ts_ns").cast("string")
    parts = lambda *more: F.concat_ws("\t", F.col("event_id").cast("string"), t, F.lit("1"), *more, F.lit("2"), F.lit("3"), (F.col("ts_ns") + 7).cast("string"))
    line = F.when(F.col("event_id") % 2 == 0, parts(F.lit("5"))).otherwise(parts())
    _events(spark, sf_dir).select(F.col("run_id").alias("run"), line.alias("value")).repartition("run").write.partitionBy("run").text(path)
    return logs.read_round_stats(spark, f"{path}/run=*").select("run_id", "round", "embed_ns", "rerank_ns", "total_ns")


# ---- streams: each is run to its end over the events, as the files of a stream


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_folder(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _finished(df, spark, mode="append"):
    """What a stream gives until its input ends, written and read again."""
    path, checkpoint = scratch(spark), scratch(spark)
    run = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("""with last as (select max(ts) - interval 1 hour as t from events)
    select epoch_us(w) as start_us, epoch_us(w) + 3600000000 as end_us, metric, n, round(avg, 4) as avg, max from (
    select time_bucket(interval 1 hour, ts) as w, event_type as metric, count(*) as n, avg(value) as avg, max(value) as max from events group by all), last
    where w + interval 1 hour <= last.t""")
def j1_stream_metric_windows(spark, sf_dir):
    """Hourly windows that the watermark has closed at the end of the stream."""
    stream = _stream(spark, sf_dir).select(F.timestamp_micros((epoch_ns("ts") / 1000).cast("long")).alias("ts"), F.col("event_type").alias("metric"), "value")
    return _finished(jobs.stream_metric_windows(stream), spark).withColumn("avg", F.round("avg", 4))


@query(f"""select run_id as device, ts_ns, value - lag(value) over w as delta_raw, round(value - lag(value) over w, 4) as delta from {_EVENTS}
    window w as (partition by run_id order by ts_ns) qualify row_number() over w > 1""".replace("value - lag(value) over w as delta_raw, ", ""))
def j2_stream_counter_rate(spark, sf_dir):
    stream = _stream(spark, sf_dir).select(F.col("user_id").alias("device"), epoch_ns("ts").alias("ts_ns"), "value")
    return _finished(jobs.stream_counter_rate(stream), spark).select("device", "ts_ns", F.round("delta", 4).alias("delta"))


@query(f"""select user_id as id, arg_max(value, event_id) as value from events group by 1 having arg_max({OPS}, event_id) <> 'delete'""")
def j3_stream_collection_changes(spark, sf_dir):
    path, checkpoint = scratch(spark), scratch(spark)
    stream = _stream(spark, sf_dir).select(F.col("user_id").alias("id"), "value", F.expr(OPS).alias("op"), "event_id")
    run = jobs.stream_collection_changes(stream, path, "id", "event_id", ["id", "value"])
    run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return buckets.rows(spark, path, "id long, value double")


def _text_index(spark, sf_dir):
    """(index of the hashed documents with lists as folders, documents, lists to probe for a recall of 0.95 of other texts' searches)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = written(encode(docs, "text", lambda: HashingEncoder(64)).select("id", "vector"))
    index = ivf_build(vectors, n_lists=16, max_iter=5, path=scratch(spark))
    turns = table(spark, sf_dir, "conversations").where("conv_id % 10 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")
    asked = written(encode(turns, "text", lambda: HashingEncoder(64)).select("qid", "vector"))
    return index, docs, choose_nprobe(probe_curve(asked, index, written(knn_exact(asked, vectors, 3, "IP"))), 0.95)


@query()
def j4_stream_queries(spark, sf_dir):
    """Benchmark items arrive as a stream; each batch's contexts are gathered in a table."""
    path, checkpoint, folder = scratch(spark), scratch(spark), scratch(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    items.write.parquet(folder)
    index, docs, nprobe = _text_index(spark, sf_dir)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = jobs.stream_queries(stream, index, docs, 3, lambda found, n: found.write.mode("overwrite").parquet(f"{path}/batch={n}"), nprobe=nprobe)
    run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("qid long, contexts array<string>, batch int").parquet(path).select("qid", F.size("contexts").alias("n"), F.md5(F.array_join("contexts", "|")).alias("contexts_md5"))


def batch_workload(spark, sf_dir):
    """The batch counterpart of j3, for tests."""
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "value", F.expr(OPS).alias("op"), "event_id")
    return apply_workload(spark.createDataFrame([], "id long, value double"), ops, "id", "event_id")
