"""Streams: windowed metrics, counter rates, collection changes, arriving queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragspark.operators import buckets
from ragspark.operators.ann import IvfIndex, ivf_search
from ragspark.operators.encoding import HashingEncoder, encode
from ragspark.operators.search import format_contexts


def stream_metric_windows(stream: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """stream(ts timestamp, metric, value) -> (start_us, end_us, metric, n, avg, max) of tumbling or sliding windows.

    Samples later than the watermark are dropped. Works on a batch frame as well.
    """
    kept = stream.withWatermark("ts", watermark)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    found = kept.groupBy(span.alias("w"), "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg"), F.max("value").alias("max"))
    return found.select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "metric", "n", "avg", "max")


def stream_counter_rate(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """stream(device, ts_ns, value) -> (device, ts_ns, delta, per_s) across micro-batches.

    The last sample of each device is its state; samples older than it are ignored, a first sample gives
    no row. With idle_ms, devices that fall silent lose their state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts_ns", kind="stable")
        last = state.get if state.exists else None
        out = []
        for ts, value in zip(rows["ts_ns"].tolist(), rows["value"].tolist()):
            if last is not None:
                if ts <= last[0]:
                    continue
                out.append((key[0], ts, value - last[1], (value - last[1]) * 1e9 / (ts - last[0])))
            last = (ts, value)
        if last is not None:
            state.update(last)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["device", "ts_ns", "delta", "per_s"])

    kind = stream.schema["device"].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("device").applyInPandasWithState(
        step, f"device {kind}, ts_ns long, delta double, per_s double", "ts_ns long, value double", "append", timeout
    )


def stream_collection_changes(stream: DataFrame, path: str, key: str, order_col: str, columns: list[str], n_buckets: int = buckets.BUCKETS, keep: int = 10) -> DataStreamWriter:
    """Apply a stream of operations to the collection below path (see operators.buckets); a micro-batch rewrites the buckets of its keys alone.

    Start from buckets.start with as many buckets, or from nothing; buckets.rows reads what is there. A batch that
    is run again starts from the version before it, so that its effect is the same. The last `keep` versions stay
    readable; older ones go.
    """
    names = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in columns)

    def step(batch: DataFrame, number: int) -> None:
        buckets.merge_workload(batch, path, names, key, order_col, number, n_buckets)
        buckets.compact(batch.sparkSession, path, keep)

    return stream.writeStream.foreachBatch(step)


def stream_queries(
    stream: DataFrame, index: IvfIndex, texts: DataFrame, k: int, sink: Callable[[DataFrame, int], None], encoder: Callable | None = None, nprobe: int = 8, metric: str = "IP"
) -> DataStreamWriter:
    """Arriving stream(qid, question) -> contexts of the k nearest rows, by micro-batch, to sink.

    index: lists of the texts' vectors (ivf_build, with a path so that lists are folders); texts(id, text). A
    micro-batch collects its encoded questions once, reads the nprobe lists nearest to each, and fetches the
    hits' texts. How many questions a batch has is the trigger's affair (maxFilesPerTrigger and the like).
    """

    dim = index.centroids.shape[1]

    def answer(batch: DataFrame, number: int) -> None:
        asked = encode(batch, "question", encoder or (lambda: HashingEncoder(dim))).select("qid", "vector")
        hits = ivf_search(asked, index, k, nprobe, metric, few=True)
        sink(format_contexts(hits.join(texts.select("id", "text"), "id")), number)

    return stream.writeStream.foreachBatch(answer)
