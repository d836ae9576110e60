"""Metric files: length-prefixed protobuf messages, read into rows.

A file is a sequence of frames, each an 8-byte little-endian length and a message.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The messages' fields, as (number, name) in the order of the format; sub-messages by their number.
#: field number -> (name, kind), kind being u (unsigned), i (signed), d (double), D (doubles), or a layout; [..] repeats


def _numbers(names: str, first: int = 1, kind: str = "u") -> dict:
    return {first + k: (name, kind) for k, name in enumerate(names.split())}


_CPU = _numbers("user nice system idle iowait irq softirq steal guest guest_nice")
_KERNEL_MISC = _numbers("intr ctxt processes procs_running procs_blocked")
_SOFT_IRQ = _numbers("total hi timer net_tx net_rx block irq_poll tasklet sched hrtimer rcu")
_DISK = _numbers(
    "reads_completed reads_merged sectors_read time_spent_reading writes_completed writes_merged sectors_written time_spent_writing "
    "io_in_progress time_spent_io weighted_time_spent_io discard_completed discard_merged discard_sectors time_spent_discarding "
    "flush_completed time_spent_flushing",
    first=4,
)
_MEM = {
    1: ("basic", _numbers("mem_total mem_free mem_available")),
    2: ("kernel_cache", _numbers("buffers cached swap_cached")),
    3: ("active_inactive", _numbers("active inactive active_anon inactive_anon active_file inactive_file")),
    4: ("non_evictable", _numbers("unevictable mlocked")),
    5: ("swap", _numbers("swap_total swap_free zswap_total zswapped")),
    6: ("dirty_writeback", _numbers("dirty writeback")),
    7: ("type", _numbers("anon_pages mapped shmem")),
    8: ("kernel", _numbers("kernel_reclaimable slab slab_reclaimable slab_unreclaimable kernel_stack page_tables")),
    9: ("tmp_buffer", _numbers("nfs_unstable bounce writeback_tmp")),
    10: ("virtual", _numbers("commit_limit committed_as vmalloc_total vmalloc_used vmalloc_chunk")),
    11: ("huge_page", _numbers(
        "anon_huge_pages shmem_huge_pages shmem_pmd_mapped file_huge_pages file_pmd_mapped hugepages_total hugepages_free hugepages_rsvd "
        "hugepages_surp hugepages_size huge_tlb"
    )),
    12: ("direct_map", _numbers("direct_map_4k direct_map_2m direct_map_4m direct_map_1g")),
    13: ("misc", _numbers("percpu hardware_corrupted")),
}
_GPU = {1: ("nvml", "D"), 2: ("gpm", "D"), 3: ("procs", [_numbers("pid used_gpu_memory")])}
_STAT = {
    3: ("state", "u"), **_numbers("minflt cminflt majflt cmajflt utime stime", 10), **_numbers("cutime cstime priority nice", 16, "i"),
    20: ("num_threads", "u"), 23: ("vsize", "u"),
}
_PROC = {
    1: ("stat", _STAT),
    2: ("statm", _numbers("size resident share text lib data dt")),
    3: ("io", _numbers("rchar wchar syscr syscw read_bytes write_bytes cancelled_write_bytes")),
}
LAYOUTS = {
    "cpu": {1: ("ts_ns", "u"), 2: ("core_stats", [_CPU]), 3: ("kernel_misc", _KERNEL_MISC), 4: ("soft_irq", _SOFT_IRQ)},
    "disk": {1: ("ts_ns", "u"), 2: ("disk_metrics", [_DISK])},
    "mem": {1: ("ts_ns", "u"), 2: ("meminfo", _MEM)},
    "gpu": {1: ("ts_ns", "u"), 2: ("per_gpu", [_GPU])},
    "proc": {1: ("ts_ns", "u"), 2: ("per_proc", [_PROC])},
}
#: a file is one frame after another; a frame holds any number of samples in field 1
SAMPLES = 1


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a message ends within a number")
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            n = {1: 8, 5: 4}.get(wire)
            if n is None:
                if wire != 2:
                    raise ValueError(f"wire type {wire}")
                n, at = _varint(data, at)
            if at + n > len(data):
                raise ValueError("a message ends within a field")
            value, at = data[at : at + n], at + n
        yield key >> 3, wire, value


def decode(data: bytes, layout: dict) -> dict:
    """A message as a dict by its layout; missing numbers are 0, missing groups None, unknown fields skipped."""
    out: dict = {name: 0 if kind in ("u", "i") else 0.0 if kind == "d" else [] if kind == "D" or isinstance(kind, list) else None for name, kind in layout.values()}
    for number, wire, value in _fields(data):
        if number not in layout:
            continue
        name, kind = layout[number]
        if kind == "u":
            out[name] = value if wire == 0 else int.from_bytes(value, "little")
        elif kind == "i":
            out[name] = value - (value >> 63 << 64)
        elif kind == "d":
            out[name] = struct.unpack("<d", value)[0]
        elif kind == "D":
            out[name] += struct.unpack(f"<{len(value) // 8}d", value)
        elif isinstance(kind, list):
            out[name].append(decode(value, kind[0]))
        else:
            out[name] = decode(value, kind)
    return out


def encode(value: dict, layout: dict) -> bytes:
    """The message that decode reads."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    out = b""
    for number, (name, kind) in layout.items():
        v = value.get(name)
        if v is None:
            continue
        if kind in ("u", "i"):
            out += varint(number << 3) + varint(v & (1 << 64) - 1)
            continue
        if kind == "d":
            out += varint(number << 3 | 1) + struct.pack("<d", v)
            continue
        bodies = [struct.pack(f"<{len(v)}d", *v)] if kind == "D" else [encode(x, kind[0]) for x in v] if isinstance(kind, list) else [encode(v, kind)]
        for body in bodies:
            out += varint(number << 3 | 2) + varint(len(body)) + body
    return out


def frame(samples: list[dict], kind: str) -> bytes:
    """One frame that holds samples."""
    message = encode({"samples": samples}, {SAMPLES: ("samples", [LAYOUTS[kind]])})
    return struct.pack("<Q", len(message)) + message


def frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"the length at byte {at} is cut off")
        n = struct.unpack_from("<Q", data, at)[0]
        if at + 8 + n > len(data):
            raise ValueError(f"the frame at byte {at} is cut off")
        yield data[at + 8 : at + 8 + n]
        at += 8 + n


def _type(layout: dict) -> T.StructType:
    def of(kind):
        if kind in ("u", "i"):
            return T.LongType()
        if kind == "d":
            return T.DoubleType()
        if kind == "D":
            return T.ArrayType(T.DoubleType())
        return T.ArrayType(_type(kind[0])) if isinstance(kind, list) else _type(kind)

    return T.StructType([T.StructField(name, of(kind)) for name, kind in layout.values()])


#: bytes of a file that is read whole, and of a range of a larger one
LARGE_FILE = 32 << 20
RANGE_BYTES = 8 << 20


def _files_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path of a path or URI."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_metric_frames(samples: DataFrame, path: str, kind: str, per_frame: int = 500) -> int:
    """Write samples(run_id, and the kind's columns) as files path/run_id/*.bin; returns how many.

    Each task writes a file a run and Arrow batch, so that no run is one task's work and files are small. A task
    that runs again writes the same names.
    """
    layout = LAYOUTS[kind]
    names = [name for name, _ in layout.values() if name in samples.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files_at(path)
        n = 0
        for batch in batches:
            runs: dict[str, list[dict]] = {}
            for row in batch.to_pylist():
                runs.setdefault(row["run_id"], []).append(row)
            for run_id, rows in runs.items():
                store.create_dir(f"{root}/{run_id}", recursive=True)
                with store.open_output_stream(f"{root}/{run_id}/{TaskContext.get().partitionId():06d}-{n:06d}.bin") as out:
                    for k in range(0, len(rows), per_frame):
                        out.write(frame(rows[k : k + per_frame], kind))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = samples.select(F.col("run_id").cast("string"), *names)
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def frame_ranges(paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """paths(path, length) -> (path, start, end): each file in ranges of whole frames, of range_bytes or one frame.

    A file's lengths are read by hopping from one to the next, eight bytes a frame; nothing else of it is. A file
    whose last frame is cut off raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                store, plain = _files_at(path)
                rows, start, at = [], 0, 0
                with store.open_input_file(plain) as file:
                    while at < length:
                        head = file.read_at(8, at)
                        after = at + 8 + (struct.unpack("<Q", head)[0] if len(head) == 8 else length)
                        if after > length:
                            raise ValueError(f"{path}: the frame at byte {at} is cut off")
                        if at > start and after - start > range_bytes:
                            rows.append((path, start, at))
                            start = at
                        at = after
                yield pd.DataFrame([*rows, (path, start, at)] if at > start else rows, columns=["path", "start", "end"])

    return paths.select("path", "length").mapInPandas(run, "path string, start long, end long")


def read_metric_frames(spark: SparkSession, path: str, kind: str, large: int = LARGE_FILE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Samples of a kind (cpu, disk, mem, gpu, proc) with run_id, the file's folder; a cut-off file raises.

    Files of up to `large` bytes come whole, one after the other. A larger one is indexed by its frames' lengths,
    and its ranges are dealt over the tasks, each of which reads a range at a time; its bytes are never one cell.
    """
    layout = LAYOUTS[kind]
    schema = T.StructType([T.StructField("run_id", T.StringType()), *_type(layout).fields])
    run_id = F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("run_id")

    def told(run: str, content: bytes) -> Iterator[pd.DataFrame]:
        for message in frames(content):
            rows = decode(message, {SAMPLES: ("samples", [layout])})["samples"]
            if rows:
                yield pd.DataFrame([{"run_id": run, **r} for r in rows], columns=schema.names)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run, content in zip(batch["run_id"], batch["content"]):
                yield from told(run, content)

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run, name, start, end in zip(batch["run_id"], batch["path"], batch["start"], batch["end"]):
                store, plain = _files_at(name)
                with store.open_input_file(plain) as file:
                    yield from told(run, file.read_at(end - start, start))

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= large).select(run_id, "content").mapInPandas(whole, schema)
    ranges = frame_ranges(files.where(F.col("length") > large), range_bytes)
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    return small.unionByName(ranges.select(run_id, "path", "start", "end").mapInPandas(ranged, schema))


def cpu_long(samples: DataFrame) -> DataFrame:
    """(run_id, ts_ns, core, counters): core 0 is the whole machine."""
    return samples.select("run_id", "ts_ns", F.posexplode("core_stats").alias("core", "s")).select("run_id", "ts_ns", "core", "s.*")


def disk_long(samples: DataFrame) -> DataFrame:
    """(run_id, ts_ns, disk, counters)."""
    return samples.select("run_id", "ts_ns", F.posexplode("disk_metrics").alias("disk", "s")).select("run_id", "ts_ns", "disk", "s.*")
