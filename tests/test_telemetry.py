import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from ragspark.operators import stages, telemetry
from ragspark.sources import frames, logs
from ragspark.streaming import jobs


@pytest.fixture(scope="module")
def log(spark):
    tags = [("load", 0), ("embed", 10), ("retrieve", 15), ("embed", 40), ("retrieve", 41), ("end", 50)]
    return spark.createDataFrame([("r", i, t, 1000 + n) for i, (t, n) in enumerate(tags)], "run_id string, seq int, tag string, ts_ns long")


def test_stages(log):
    got = stages.stage_intervals(log).orderBy("seq").collect()
    assert [r["dur_ns"] for r in got] == [10, 5, 25, 1, 9, None] and got[1]["start_s"] == pytest.approx(1e-8)
    per = {r["tag"]: r for r in stages.stage_breakdown(stages.stage_intervals(log)).collect()}
    assert per["retrieve"]["total_ns"] == 34 and per["embed"]["percent"] == 12 and "end" not in per
    assert [r["round"] for r in stages.round_index(log).orderBy("seq").collect()] == [0, 1, 1, 2, 2, 2]


def test_rounds(spark):
    stats = spark.createDataFrame([("a", 1, 10, 70, None, 5, 15)], "run_id string, round int, embed_ns long, retrieve_ns long, rerank_ns long, prompt_ns long, generate_ns long")
    got = {r["stage"]: r for r in stages.round_shares(stats).collect()}
    assert got["retrieve"]["share"] == 0.7 and got["rerank"]["stage_ns"] == 0 and got["embed"]["total_ns"] == 100
    rounds = spark.createDataFrame([("a", 10, n * 10**6) for n in range(1, 101)], "run_id string, n_queries int, total_ns long")
    t = stages.throughput_latency(rounds).first()
    assert t["queries_per_s"] == pytest.approx(1000 / 5.05) and t["p50_ms"] == 50.5 and t["p99_ms"] == pytest.approx(99.01)


def test_log_readers(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1/t.txt").write_text("embed, 12\nbroken\n, 3\nx, y\nretrieve,13\na, 1, 2\n")
    got = logs.read_stage_log(spark, f"{tmp_path}/*/t.txt").orderBy("ts_ns").collect()
    assert [tuple(r) for r in got] == [("run1", "embed", 12), ("run1", "retrieve", 13)]
    (tmp_path / "run1/s.txt").write_text("0\t1\t2\t3\t4\t10\n1\t1\t2\t9\t3\t4\t19\nbad\n")
    got = logs.read_round_stats(spark, f"{tmp_path}/*/s.txt").orderBy("round").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 1, 2, 0, 3, 4, 10), (1, 1, 2, 9, 3, 4, 19)]
    (tmp_path / "wiki_batch_32.log").write_text("x Max Token Size in Batch: 7\nMax Token Size in Batch: 7\nMax Token Size in Batch: 9\nnone\n")
    got = stages.token_size_histogram(logs.read_batch_logs(spark, f"{tmp_path}/wiki_batch_*.log")).orderBy("size").collect()
    assert [tuple(r) for r in got] == [(32, 7, 2), (32, 9, 1)]


def test_stage_logs_are_written_by_all_tasks_and_cut_without_patterns(spark):
    from ragspark.plans import telemetry_queries as t

    found = t.a9_read_stage_log(spark, "/root/testdata/sf0.001")
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in found.inputFiles()}) > 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp" not in plan


SAMPLES = {
    "cpu": {"ts_ns": 5, "core_stats": [{n: i * 300 for i, n in enumerate(telemetry.CPU_COUNTERS)}] * 2},
    "disk": {"ts_ns": 2**40, "disk_metrics": [{"sectors_read": 1, "sectors_written": 2**50}]},
    "mem": {"ts_ns": 1, "meminfo": {"basic": {"mem_total": 1, "mem_free": 2, "mem_available": 3}, "kernel_cache": None}},
    "gpu": {"ts_ns": 1, "per_gpu": [{"nvml": [1.5, -2.0], "gpm": [], "procs": [{"pid": 1, "used_gpu_memory": 2**33}]}]},
    "proc": {"ts_ns": 1, "per_proc": [{"stat": {"utime": 1, "stime": 2}, "statm": None, "io": {"read_bytes": 3, "write_bytes": 4}}]},
}


@pytest.mark.parametrize("kind", list(SAMPLES))
def test_frames(spark, tmp_path, kind):
    (tmp_path / "run7").mkdir()
    data = frames.frame([SAMPLES[kind]] * 3, kind) + frames.frame([], kind) + frames.frame([SAMPLES[kind]], kind)
    (tmp_path / "run7/f.bin").write_bytes(data)
    got = frames.read_metric_frames(spark, f"{tmp_path}/*/f.bin", kind).collect()
    assert len(got) == 4 and got[0]["run_id"] == "run7" and got[0]["ts_ns"] == SAMPLES[kind]["ts_ns"]
    if kind == "disk":
        assert got[0]["disk_metrics"][0]["sectors_written"] == 2**50
    if kind == "mem":
        assert got[0]["meminfo"]["basic"]["mem_available"] == 3 and got[0]["meminfo"]["kernel_cache"] is None
    if kind == "gpu":
        assert got[0]["per_gpu"][0]["nvml"] == [1.5, -2.0]


def test_bytes_of_the_format():
    """Messages put down by hand: a key is field number * 8 + wire type."""
    disk = bytes([0x20, 11, 0x30, 0x89, 0x06, 0x50, 0xF8, 0x06, 0xA0, 0x01, 5])  # fields 4, 6, 10 and 20
    got = frames.decode(bytes([0x08, 7, 0x12, len(disk)]) + disk, frames.LAYOUTS["disk"])
    assert got["ts_ns"] == 7 and {k: v for k, v in got["disk_metrics"][0].items() if v} == {
        "reads_completed": 11, "sectors_read": 777, "sectors_written": 888, "time_spent_flushing": 5,
    }
    stat = bytes([0x70, 0xF4, 0x03, 0x78, 0xD8, 0x04, 0x98, 0x01]) + b"\xff" * 9 + b"\x01"  # 14, 15 and 19, which is -1
    proc = bytes([0x0A, len(stat)]) + stat + bytes([0x12, 4, 0x08, 9, 0x10, 99, 0x1A, 4, 0x08, 1, 0x28, 70])
    got = frames.decode(bytes([0x12, len(proc)]) + proc, frames.LAYOUTS["proc"])["per_proc"][0]
    assert (got["stat"]["utime"], got["stat"]["stime"], got["stat"]["nice"]) == (500, 600, -1)
    assert (got["statm"]["size"], got["statm"]["resident"], got["io"]["rchar"], got["io"]["read_bytes"], got["io"]["write_bytes"]) == (9, 99, 1, 70, 0)
    mem = frames.decode(bytes([0x12, 4, 0x6A, 2, 0x10, 3]), frames.LAYOUTS["mem"])["meminfo"]
    assert mem["misc"] == {"percpu": 0, "hardware_corrupted": 3} and mem["swap"] is None
    cpu = frames.decode(bytes([0x1A, 2, 0x10, 8, 0x22, 2, 0x58, 9]), frames.LAYOUTS["cpu"])
    assert cpu["kernel_misc"]["ctxt"] == 8 and cpu["soft_irq"]["rcu"] == 9


def test_written_frames(spark, tmp_path):
    rows = spark.createDataFrame([(r, t, [{"sectors_read": t}]) for r in ("a", "b") for t in range(30)], "run_id string, ts_ns long, disk_metrics array<struct<sectors_read:long>>")
    assert frames.write_metric_frames(rows, str(tmp_path / "out"), "disk", per_frame=7) >= 2
    got = frames.read_metric_frames(spark, f"{tmp_path}/out/*/*.bin", "disk").selectExpr("run_id", "ts_ns", "disk_metrics[0].sectors_read").collect()
    assert sorted(map(tuple, got)) == sorted((r, t, t) for r in ("a", "b") for t in range(30))


def test_broken_frames():
    data = frames.frame([SAMPLES["cpu"]], "cpu")
    assert struct.unpack_from("<Q", data)[0] == len(data) - 8
    for bad in (data[:-1], data + b"\1\2", data[:5]):
        with pytest.raises(ValueError):
            list(frames.frames(bad))


def test_large_files_are_read_by_ranges(spark, tmp_path):
    samples = [{"ts_ns": n, "disk_metrics": [{"sectors_read": n * 2, "sectors_written": n}]} for n in range(400)]
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        data = b"".join(frames.frame(samples[k : k + 5], "disk") for k in range(0, 400, 5))
        (tmp_path / run / "x.bin").write_bytes(data)
    (tmp_path / "a" / "small.bin").write_bytes(frames.frame(samples[:1], "disk"))
    path = f"{tmp_path}/*/*.bin"
    whole = frames.read_metric_frames(spark, path, "disk")
    cut = frames.read_metric_frames(spark, path, "disk", large=200, range_bytes=300)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(cut) == rows(whole) and whole.count() == 801
    files = spark.read.format("binaryFile").load(path).where("length > 200")
    ranges = sorted(map(tuple, frames.frame_ranges(files, 300).collect()))
    assert all(e - s <= 300 for _, s, e in ranges) and len(ranges) > 20
    for run in ("a", "b"):  # the ranges are the file, one after the other
        own = [(s, e) for p, s, e in ranges if f"/{run}/" in p]
        assert own[0][0] == 0 and own[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    # one file's ranges are several tasks' work, and what is indexed is never read as content
    one = frames.read_metric_frames(spark, f"{tmp_path}/b/*.bin", "disk", large=200, range_bytes=300)
    assert one.select(F.spark_partition_id()).distinct().count() > 1
    assert "length, content" not in frames.frame_ranges(files, 300)._jdf.queryExecution().optimizedPlan().toString().replace("[path", "")
    (tmp_path / "b" / "x.bin").write_bytes(data[:-3])
    with pytest.raises(Exception, match="cut off"):
        frames.read_metric_frames(spark, path, "disk", large=200).count()


def test_counters(spark):
    df = spark.createDataFrame([("a", 1, 5, 0), ("a", 2, 9, 0), ("a", 3, 9, 0), ("b", 1, 1, 0)], "d string, t long, x long, y long")
    got = sorted((r["d"], r["t"], r["x_delta"]) for r in telemetry.counter_delta(df, ["d"], "t", ["x"]).collect())
    assert got == [("a", 2, 4), ("a", 3, 0)]
    zero = sorted((r["d"], r["t"], r["x_delta"]) for r in telemetry.counter_delta(df, ["d"], "t", ["x"], "zero").collect())
    assert zero == [("a", 1, 0), ("a", 2, 4), ("a", 3, 0), ("b", 1, 0)]
    pct = {r["t"]: r["x_pct"] for r in telemetry.cpu_percent(df, ["d"], "t", ["x", "y"]).collect()}
    assert pct == {2: 100.0, 3: None}


def test_spans_change_nothing(spark):
    rng = random.Random(9)
    rows = [(d, t, rng.choice([None, t * 3, t])) for d in ("a", "b") for t in sorted(rng.sample(range(1000), 60))]
    df = spark.createDataFrame(rows, "run_id string, ts_ns long, x long")
    for first in ("drop", "zero"):
        a, b = (sorted(map(str, telemetry.counter_delta(df, ["run_id"], "ts_ns", ["x"], first, k).collect())) for k in (None, 37))
        assert a == b
    told = lambda f, k: sorted(map(str, f(k).collect()))
    for f in (
        lambda k: telemetry.cpu_percent(df.withColumn("y", F.col("x") * 2 + F.col("ts_ns")), ["run_id"], "ts_ns", ["x", "y"], k),
        lambda k: telemetry.rate_mb_s(df, ["run_id"], cols=("x",), bucket=k),
        lambda k: telemetry.relative_seconds(df, ["run_id"], bucket=k),
        lambda k: telemetry.relative_seconds(df, ["run_id"], base=3, bucket=k),
        lambda k: telemetry.smooth(df, "x", ["run_id"], "ts_ns", 5, k, block_rows=7),
        lambda k: telemetry.smooth(df, "x", ["run_id"], "ts_ns", 9, k, block_rows=1),
    ):
        whole = told(f, None)
        assert len(whole) in (120, 118) and all(told(f, k) == whole for k in (1, 37, 5000))
    nobody = df.withColumn("run_id", F.when(F.col("run_id") == "a", F.col("run_id")))  # a null device is one too
    assert told(lambda k: telemetry.smooth(nobody, "x", ["run_id"], "ts_ns", 5, k, 7), 37) == told(lambda k: telemetry.smooth(nobody, "x", ["run_id"], "ts_ns", 5, k), None)
    few = df.where("ts_ns < 0")
    assert telemetry.relative_seconds(few, ["run_id"], base=2, bucket=9).count() == 0 == telemetry.smooth(few, "x", ["run_id"], "ts_ns", 5, 9).count()
    marks = spark.createDataFrame([(d, t, f"s{t}") for d in ("a", "b") for t in rng.sample(range(1000), 9)], "run_id string, ts_ns long, tag string")
    a, b = (sorted(map(str, telemetry.tag_samples(df, marks, k).collect())) for k in (None, 37))
    assert a == b


def test_series(spark):
    df = spark.createDataFrame([("a", n, float(v)) for n, v in enumerate([5, 10, 15, 20])], "d string, ts_ns long, v double")
    assert [r["v_smooth"] for r in telemetry.smooth(df, "v", ["d"], "ts_ns").orderBy("ts_ns").collect()] == [6, 10, 10, 9]
    disk = spark.createDataFrame([("a", 0, 0, 0), ("a", 10**9, 2048, 4096), ("a", 10**9, 1, 1)], "d string, ts_ns long, sectors_read long, sectors_written long")
    rates = telemetry.rate_mb_s(disk.where("sectors_read <> 1"), ["d"]).orderBy("ts_ns").collect()
    assert (rates[0]["sectors_read_mb_s"], rates[1]["sectors_read_mb_s"], rates[1]["sectors_written_mb_s"]) == (None, 1.0, 2.0)
    rel = telemetry.relative_seconds(df.withColumn("ts_ns", F.col("ts_ns") * 10**9), ["d"], base=2).orderBy("ts_ns")
    assert [r["rel_s"] for r in rel.collect()] == [-1, 0, 1, 2]


def test_gauges(spark):
    mem = "struct<basic:struct<mem_free:long,mem_available:long>,kernel_cache:struct<buffers:long,cached:long>>"
    df = spark.createDataFrame([("r", n * 10**8, ((2**20, 2**21), (0, None))) for n in range(12)], f"run_id string, ts_ns long, meminfo {mem}")
    got = telemetry.memory_gib(df, assumed_rate=True).collect()
    assert got[0]["free_gib"] == 1 and got[0]["available_gib"] == 2 and got[0]["cached_gib"] is None and sorted(r["t"] for r in got)[-1] == 1
    gpu = spark.createDataFrame([("r", 1, [([1.0, 2.0, 3.0],), ([4.0],)])], "run_id string, ts_ns long, per_gpu array<struct<nvml:array<double>>>")
    long = telemetry.gpu_long(gpu, ["a", "b"])
    assert sorted((r["gpu"], r["probe"], r["value"]) for r in long.collect()) == [(0, "a", 1), (0, "b", 2), (0, "probe_2", 3), (1, "a", 4)]
    assert telemetry.gpu_wide(long, ["a", "b"]).orderBy("gpu").first()["b"] == 2
    used = spark.createDataFrame([("r", 0, t, s, v) for t in (1, 2) for s, v in enumerate([2**30, 0, t * 2**30])], "run_id string, gpu int, ts_ns long, slot int, used_bytes long")
    got = sorted((r["ts_ns"], r["slot"], r["stacked_gib"]) for r in telemetry.gpu_process_memory_stack(used).collect())
    assert got == [(1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 2, 3)]
    proc = spark.createDataFrame(
        [("r", 1, [((1, 2), None, (3, 4))]), ("r", 2, None)],
        "run_id string, ts_ns long, per_proc array<struct<stat:struct<utime:long,stime:long>,statm:struct<resident:long>,io:struct<read_bytes:long,write_bytes:long>>>",
    )
    got = telemetry.proc_long(proc).orderBy("ts_ns").collect()
    assert (got[0]["utime"], got[0]["resident"], got[0]["write_bytes"], got[1]["proc"]) == (1, None, 4, None)


def test_tagging(spark, log):
    samples = spark.createDataFrame([("r", n, float(n)) for n in (999, 1000, 1009, 1010, 1014, 1015, 1100)] + [("other", 5, 0.0)], "run_id string, ts_ns long, value double")
    tagged = telemetry.tag_samples(samples, log)
    got = {(r["run_id"], r["ts_ns"]): r["stage"] for r in tagged.collect()}
    assert [got[("r", n)] for n in (999, 1000, 1009, 1010, 1014, 1015, 1100)] == [None, "load", "load", "embed", "embed", "retrieve", "end"]
    assert got[("other", 5)] is None and "Join" not in tagged._jdf.queryExecution().executedPlan().toString()
    per = {(r["run_id"], r["stage"]): r for r in telemetry.stage_resource_summary(tagged.withColumn("metric", F.lit("m"))).collect()}
    assert per[("r", "embed")]["n"] == 2 and per[("r", "embed")]["max"] == 1014


def test_streams(spark, tmp_path):
    rng = random.Random(3)
    rows = [(d, t, float(t * (1 + len(d)))) for d in ("a", "bb") for t in range(1, 40)]
    batches = [[r for r in rows if r[1] < 20], [r for r in rows if r[1] >= 20] + [("a", 3, 0.0)]]
    for n, batch in enumerate(batches):
        rng.shuffle(batch)
        spark.createDataFrame(batch, "device string, ts_ns long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{n}"))
    stream = spark.readStream.schema("device string, ts_ns long, value double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = jobs.stream_counter_rate(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        run.awaitTermination(120)
    finally:
        run.stop()
    got = sorted((r["device"], r["ts_ns"], r["delta"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(d, t, float(1 + len(d))) for d in ("a", "bb") for t in range(2, 40)]


def test_percentile_sketches_keep_their_rank_error(spark):
    from ragspark.operators import stages

    df = spark.range(100_000).select((F.col("id") % 2).alias("run_id"), F.lit(1).alias("n_queries"), (F.hash("id") % 1_000_000 + 1_000_000).cast("long").alias("total_ns"))
    exact, told = ({r["run_id"]: r for r in stages.throughput_latency(df, a).collect()} for a in (None, 500))
    values = {k: sorted(r["total_ns"] for r in df.where(f"run_id = {k}").collect()) for k in (0, 1)}
    import bisect

    for k, v in values.items():
        assert told[k]["queries_per_s"] == exact[k]["queries_per_s"]
        for q in (50, 95, 99):
            got = round(told[k][f"p{q}_ms"] * 1e6)
            low, high = bisect.bisect_left(v, got), bisect.bisect_right(v, got)
            assert low - len(v) / 500 <= q / 100 * len(v) <= high + len(v) / 500
            assert abs(exact[k][f"p{q}_ms"] * 1e6 - v[int(q / 100 * (len(v) - 1))]) < 200


def test_metric_windows_in_batch(spark):
    df = spark.createDataFrame([(10, "m", 1.0), (3599, "m", 3.0), (3600, "m", 9.0)], "s long, metric string, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(tuple(r) for r in jobs.stream_metric_windows(df).collect())
    assert got == [(0, 3600 * 10**6, "m", 2, 2.0, 3.0), (3600 * 10**6, 7200 * 10**6, "m", 1, 9.0, 9.0)]
    assert math.isclose(jobs.stream_metric_windows(df, slide="30 minutes").agg(F.sum("n")).first()[0], 6)
