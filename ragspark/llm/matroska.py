"""Media columns in Matroska: texts stored as 8-bit samples, and containers parsed into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the container format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CONTENT_ENCODINGS, CONTENT_ENCODING, COMPRESSION, COMPRESSION_ALGORITHM, COMPRESSION_SETTINGS, ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
HEADER_STRIPPING = 3
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: what may stand in a cluster of unknown size ends where one of these begins
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

FRAME = 192  # samples a packet; 24 ms at 8 kHz
RATE = 8000
LACED = 8  # packets a block
BLOCKS = 20  # blocks a cluster


# ---- writing


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def vint(value: int) -> bytes:
    """value as a variable-length size; all ones are kept for an unknown size."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def _element(number: int, body: bytes) -> bytes:
    return _id(number) + vint(len(body)) + body


def _unsigned(number: int, value: int) -> bytes:
    return _element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    """Lace header and frames of a block."""
    sizes = [len(f) for f in frames]
    if lacing == NO_LACING:
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING:
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for before, size in zip(sizes, sizes[1:-1]):
            difference, n = size - before, 1
            while abs(difference) >= (1 << 7 * n - 1) - 1:
                n += 1
            head += (difference + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing takes frames of one size")
    return head + b"".join(frames)


def mux(payload: bytes, lacing: int = FIXED_LACING) -> bytes:
    """A Matroska file with one track of 8-bit PCM at 8 kHz that holds payload, whole, in 24 ms packets."""
    header = _element(
        EBML,
        _unsigned(EBML_VERSION, 1) + _unsigned(EBML_READ_VERSION, 1) + _unsigned(EBML_MAX_ID, 4) + _unsigned(EBML_MAX_SIZE, 8)
        + _element(DOC_TYPE, b"matroska") + _unsigned(DOC_TYPE_VERSION, 4) + _unsigned(DOC_TYPE_READ_VERSION, 2),
    )
    info = _element(
        INFO,
        _unsigned(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE))
        + _element(MUXING_APP, b"ragspark") + _element(WRITING_APP, b"ragspark"),
    )
    audio = _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _unsigned(CHANNELS, 1) + _unsigned(BIT_DEPTH, 8)
    tracks = _element(
        TRACKS,
        _element(
            TRACK_ENTRY,
            _unsigned(TRACK_NUMBER, 1) + _unsigned(TRACK_UID, 1) + _unsigned(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT")
            + _unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + _element(AUDIO, audio),
        ),
    )
    packet_ms, out, cues = FRAME * 1000 // RATE, [info, tracks], []
    at, per_block = len(info) + len(tracks), FRAME * (LACED if lacing else 1)
    for start in range(0, len(payload), per_block * BLOCKS):
        time = start // FRAME * packet_ms
        parts = [_unsigned(TIMESTAMP, time)]
        for k in range(start, min(start + per_block * BLOCKS, len(payload)), per_block):
            chunk = payload[k : k + per_block]
            frames = [chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)]
            body = b"\x81" + struct.pack(">hB", k // FRAME * packet_ms - time, 0x80 | lacing << 1) + _laced(frames, lacing)
            parts.append(_element(SIMPLE_BLOCK, body))
        cluster = _element(CLUSTER, b"".join(parts))
        positions = _unsigned(CUE_TRACK, 1) + _unsigned(CUE_CLUSTER_POSITION, at)
        cues.append(_element(CUE_POINT, _unsigned(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, positions)))
        out.append(cluster)
        at += len(cluster)
    out.append(_element(CUES, b"".join(cues)))
    return header + _element(SEGMENT, b"".join(out))


# ---- reading


@dataclass
class Media:
    """Packet table of a file as columns; times in ns, offsets from the file's start."""

    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, the cluster's offset
    clusters: list[tuple[int, int]] = field(default_factory=list)  # offset, time in ns
    duration_ns: int = 0
    scale: int = 1_000_000  # ns a unit of time
    track: list[int] = field(default_factory=list)
    time: list[int] = field(default_factory=list)
    keyframe: list[bool] = field(default_factory=list)
    cluster: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)


def _vint(data: bytes, at: int, marked: bool = False) -> tuple[int, int, int]:
    """(value, next position, bytes) of the variable-length number at `at`; ids keep their length mark."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    return value if marked else value ^ 1 << 7 * n, at + n, n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int | None]]:
    """(id, start of the body, its end or None if unknown) of each element in data[at:end]."""
    while at < end:
        number, body, _ = _vint(data, at, marked=True)
        size, body, n = _vint(data, body)
        if size == (1 << 7 * n) - 1:
            yield number, body, None
            return
        if body + size > end:
            raise ValueError(f"element {number:x} at byte {at} ends beyond its parent")
        yield number, body, body + size
        at = body + size


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def _lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[int, list[int]]:
    """Where a block's first frame starts, and its frames' sizes."""
    if lacing == NO_LACING:
        return at, [end - at]
    n, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        if (end - at) % n:
            raise ValueError(f"fixed lacing at byte {at}: {end - at} bytes for {n} frames")
        return at, [(end - at) // n] * n
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH_LACING:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, at, length = _vint(data, at)
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * length - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"lacing at byte {at}: frames longer than their block")
    return at, [*sizes, last]


def _block(out: Media, data: bytes, a: int, b: int, cluster_time: int, scale: int, key: bool | None = None) -> None:
    """key: whether its packets are key frames, where the block doesn't say so itself."""
    track, at, _ = _vint(data, a)
    relative, flags = struct.unpack_from(">hB", data, at)
    at, sizes = _lace_sizes(data, at + 3, b, flags >> 1 & 3)
    time, step = (cluster_time + relative) * scale, out.tracks.get(track, {}).get("default_duration", 0)
    for k, size in enumerate(sizes):
        out.track.append(track)
        out.time.append(time + k * step)
        out.keyframe.append(bool(flags & 0x80) if key is None else key)
        out.cluster.append(len(out.clusters) - 1)
        out.offset.append(at)
        out.size.append(size)
        at += size


def _cluster(out: Media, data: bytes, a: int, b: int, scale: int) -> int:
    """Packets of a cluster; returns where it ends (before the next top-level element if its size is unknown)."""
    time, at = 0, a
    while at < b:
        number, start, stop = next(elements(data, at, b))
        if number in TOP_LEVEL:
            return at
        if stop is None:
            raise ValueError(f"element {number:x} of unknown size in a cluster")
        if number == TIMESTAMP:
            time = _number(data, start, stop)
            out.clusters[-1] = (out.clusters[-1][0], time * scale)
        elif number == SIMPLE_BLOCK:
            _block(out, data, start, stop, time, scale)
        elif number == BLOCK_GROUP:
            group = [(inner, s, e) for inner, s, e in elements(data, start, stop)]
            key = all(inner != REFERENCE_BLOCK for inner, _, _ in group)
            for inner, s, e in group:
                if inner == BLOCK:
                    _block(out, data, s, e, time, scale, key)
        at = stop
    return b


def _encoding(data: bytes, a: int, b: int) -> tuple[bytes, bool]:
    """(bytes that every packet of a track begins with but doesn't store, whether that is all there is to undo)."""
    head, known = b"", True
    for n, s, e in elements(data, a, b):
        if n == CONTENT_ENCODING:
            parts = {m: (x, y) for m, x, y in elements(data, s, e)}
            inner = {m: (x, y) for m, x, y in elements(data, *parts[COMPRESSION])} if COMPRESSION in parts else {}
            algorithm = _number(data, *inner.get(COMPRESSION_ALGORITHM, (0, 0)))
            known &= ENCRYPTION not in parts and algorithm == HEADER_STRIPPING
            x, y = inner.get(COMPRESSION_SETTINGS, (0, 0))
            head = data[x:y] + head
    return head, known


def demux(data: bytes) -> Media:
    """Parse a Matroska file: tracks, clusters, packets with times and byte ranges, cues.

    Sizes may be unknown for the segment and clusters. Raises ValueError for broken files.
    """
    out, scale, at = Media(), 1_000_000, 0
    try:
        segment = next(((s, len(data) if e is None else e) for n, s, e in elements(data, 0, len(data)) if n == SEGMENT), None)
        if segment is None:
            raise ValueError("no segment")
        base, end = segment
        at = base
        while at < end:
            number, start, stop = next(elements(data, at, end))
            begins, at = at, end if stop is None else stop
            if number == INFO:
                for n, s, e in elements(data, start, stop):
                    if n == TIMESTAMP_SCALE:
                        scale = out.scale = _number(data, s, e)
                    elif n == DURATION:
                        out.duration_ns = round(_float(data, s, e) * scale)
            elif number == TRACKS:
                for n, s, e in elements(data, start, stop):
                    if n == TRACK_ENTRY:
                        entry = {"default_duration": 0, "codec": "", "type": 0, "head": b"", "plain": True}
                        for m, a, b in elements(data, s, e):
                            if m == TRACK_NUMBER:
                                out.tracks[_number(data, a, b)] = entry
                            elif m == CODEC_ID:
                                entry["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
                            elif m == CONTENT_ENCODINGS:
                                entry["head"], entry["plain"] = _encoding(data, a, b)
                            elif m in (DEFAULT_DURATION, TRACK_TYPE):
                                entry["default_duration" if m == DEFAULT_DURATION else "type"] = _number(data, a, b)
            elif number == CLUSTER:
                out.clusters.append((begins, 0))
                at = _cluster(out, data, start, at, scale)
            elif number == CUES:
                for n, s, e in elements(data, start, stop):
                    if n == CUE_POINT:
                        time, found = 0, []
                        for m, a, b in elements(data, s, e):
                            if m == CUE_TIME:
                                time = _number(data, a, b) * scale
                            elif m == CUE_TRACK_POSITIONS:
                                got = {i: _number(data, x, y) for i, x, y in elements(data, a, b)}
                                found.append((got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER_POSITION, 0)))
                        out.cues += [(time, *x) for x in found]
    except (IndexError, struct.error) as e:
        raise ValueError(f"the file ends early, after byte {at}") from e
    return out


def seek(data: bytes, media: Media, time_ns: int, track: int = 1) -> Media:
    """The packets of the cluster to which the last cue at or before a time leads (none without such a cue)."""
    out = Media(tracks=media.tracks, scale=media.scale)
    place = max((c for c in media.cues if c[1] == track and c[0] <= time_ns), default=None)
    if place is None:
        return out
    number, start, stop = next(elements(data, place[2], len(data)))
    if number != CLUSTER:
        raise ValueError(f"a cue leads to byte {place[2]}, where no cluster is")
    out.clusters.append((place[2], 0))
    _cluster(out, data, start, len(data) if stop is None else stop, media.scale)
    return out


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's packets, joined in the order of the file; stripped headers are put back.

    Compressed or encrypted packets raise ValueError.
    """
    entry = media.tracks.get(track, {})
    if not entry.get("plain", True):
        raise ValueError(f"track {track} is compressed or encrypted")
    head = entry.get("head", b"")
    return b"".join(head + data[o : o + n] for t, o, n in zip(media.track, media.offset, media.size) if t == track)


# ---- on tables


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes of a text, with spaces up to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


@F.pandas_udf(T.BinaryType())
def _muxed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([mux(payload_of(t)) for t in batch])


def with_media(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """docs with a binary column: each whole text (null: empty) as a Matroska file.

    A column that is called `out` already is replaced; others stay.
    """
    return docs.withColumn(out, _muxed(F.col(text_col)))


PACKETS = "packet_no long, track int, timestamp_ns long, keyframe boolean, cluster_no int, cluster_offset long, offset long, size long, cued boolean"


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a packet: number in its file, track, time, cluster, byte range, and whether a cue leads to its cluster.

    Null and empty files have no packets; broken files raise.
    """
    id_type = media.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if not data:
                    continue
                m = demux(data)
                cued = {x[2] for x in m.cues}
                starts = [m.clusters[c][0] for c in m.cluster]
                n = len(m.size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), pa.array(range(n), pa.int64()),
                        pa.array(m.track, pa.int32()), pa.array(m.time, pa.int64()), pa.array(m.keyframe, pa.bool_()),
                        pa.array(m.cluster, pa.int32()), pa.array(starts, pa.int64()), pa.array(m.offset, pa.int64()),
                        pa.array(m.size, pa.int64()), pa.array([s in cued for s in starts], pa.bool_()),
                    ],
                    ["id", "packet_no", "track", "timestamp_ns", "keyframe", "cluster_no", "cluster_offset", "offset", "size", "cued"],
                )

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(parse, f"id {id_type}, {PACKETS}").withColumnRenamed("id", id_col)


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(data: bytes) -> tuple:
    media = demux(data)
    payload = samples(data, media)
    # the packets that the cues find in the middle must be those of the table
    middle = seek(data, media, media.duration_ns // 2)
    first = media.offset.index(middle.offset[0])
    if (middle.offset, middle.size) != (media.offset[first : first + len(middle.size)], media.size[first : first + len(middle.size)]):
        raise ValueError("cues and clusters disagree")
    values = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero(np.diff((values >= 128).astype(np.int8))))
    feature = (
        f"packets={len(media.size)};clusters={len(media.clusters)};cues={len(media.cues)};ms={media.duration_ns // 1_000_000}"
        f";seek={middle.time[0] // 1_000_000}@{middle.offset[0]}"
        f";mean={values.mean():.3f};rms={np.sqrt(np.mean(np.square(values.astype(np.float64)))):.3f};crossings={crossings}"
    )
    tail = zlib.crc32(payload[-16:])
    return len(payload), hashlib.sha256(payload).hexdigest(), tail, len(data), hashlib.sha256(data).hexdigest(), feature


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text's length in bytes, and what is read back from its Matroska file.

    A null or empty text gives 192 spaces. Rows with a null or repeated id are returned as they come; equal
    texts give equal values.
    """

    schema = T.StructType.fromDDL(DIGEST)

    @F.pandas_udf(schema)
    def read_back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_digest(x) for x in batch], columns=schema.names)

    stored = with_media(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return stored.select(
        F.col("id").alias(id_col), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), read_back("media").alias("d")
    ).select(id_col, "n_bytes", "d.*")
