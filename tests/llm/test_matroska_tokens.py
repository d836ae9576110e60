import hashlib
import random
import struct
import zlib

import pytest

from ragspark.llm import matroska as m
from ragspark.llm import sentencepiece_tokens as sp

from .test_simhash import DOCS

TEXTS = [None, "", "a", "x" * 192, "x" * 193, "ñandú 日本 \n", "w " * 40_000]


@pytest.mark.parametrize("lacing", [m.NO_LACING, m.XIPH_LACING, m.FIXED_LACING, m.EBML_LACING])
def test_mux_demux(lacing):
    for n in (192, 384, 192 * 8 * 20 + 192, 192 * 999):
        payload = random.Random(n).randbytes(n)
        data = m.mux(payload, lacing)
        media = m.demux(data)
        assert m.samples(data, media) == payload
        assert media.time == [k * 24_000_000 for k in range(n // 192)] and set(media.size) == {192}
        assert [c[2] for c in media.cues] == [c[0] for c in media.clusters]
        assert [c[0] for c in media.cues] == [c[1] for c in media.clusters]
        assert media.duration_ns == n // 192 * 24_000_000


def test_lacing_of_uneven_frames():
    frames = [b"a" * n for n in (3, 700, 254, 255, 256, 1, 70_000)]
    for lacing in (m.XIPH_LACING, m.EBML_LACING):
        body = m._laced(frames, lacing)
        at, sizes = m._lace_sizes(body, 0, len(body), lacing)
        assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def test_unknown_sizes_groups_and_other_elements():
    block = lambda t: b"\x81" + struct.pack(">hB", t, 0) + b"xy"
    cluster = m._id(m.CLUSTER) + b"\x01" + b"\xff" * 7
    body = m._unsigned(m.TIMESTAMP, 5) + m._element(m.BLOCK_GROUP, m._element(m.BLOCK, block(2)) + m._element(0x9B, b"\1")) + m._element(0xEC, b"\0" * 9)
    data = m._element(m.EBML, b"") + m._id(m.SEGMENT) + b"\xff" + m._element(m.INFO, m._unsigned(m.TIMESTAMP_SCALE, 1000)) + cluster + body + cluster + body
    media = m.demux(data)
    assert media.time == [7000, 7000] and media.cluster == [0, 1] and m.samples(data, media) == b"xyxy"


def test_broken_files():
    data = m.mux(b"z" * 1920)
    for bad in (b"", data[:100], data[:-3], b"\0" + data, m._element(m.EBML, b"")):
        with pytest.raises(ValueError):
            m.demux(bad)


def test_media_digests(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "a", None, None, None), (2, "a", None, None, None)], DOCS)
    got = m.media_digests(df.withColumn("media", df["lang"])).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        raw = ("a" if r["doc_id"] is None else TEXTS[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert len(payload) % 192 == 0 and payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(m.mux(payload)), hashlib.sha256(m.mux(payload)).hexdigest())
    assert m.media_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_packet_table(spark):
    df = spark.createDataFrame([(1, "y" * 2000), (2, None)], "doc_id long, text string")
    rows = m.packet_table(m.with_media(df)).orderBy("doc_id", "packet_no").collect()
    assert len(rows) == 12 and all(r["cued"] and r["size"] == 192 for r in rows)
    data = m.mux(m.payload_of("y" * 2000))
    assert b"".join(data[r["offset"] : r["offset"] + r["size"]] for r in rows if r["doc_id"] == 1) == m.payload_of("y" * 2000)


ODD = ["", None, "a", "  a  b ", "\n\tx\n", "<s> </s> <unk>", "▁▁a", " ", "日本 🤗", "\x00a", "<0x0A>", "a" * 3000, "\nfoo", "a\n\nb c\n d \n", "wörd " * 3000]


def _peer():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=sp.MODEL_PATH)


def test_tokens_equal_sentencepiece(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "a", None, None, None)], DOCS)
    got = sp.encoded(df.withColumn("n_tokens", df["lang"]), want=("input_ids", "n_tokens", "parity")).collect()
    peer = _peer()
    for r in got:
        ids = peer.encode(r["text"] or "")
        assert r["input_ids"] == ids and r["n_tokens"] == len(ids) and r["parity"]
    back = {r["doc_id"]: r["decoded"] for r in sp.decoded(sp.encoded(df)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(ODD))


def test_token_digests(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)], DOCS)
    for r in sp.token_digests(df).collect():
        ids = _peer().encode(ODD[r["doc_id"]] or "")
        assert r["ids_md5"] == hashlib.md5(",".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)
        assert r["parity"] and r["round_trip"] == ("▁" not in (ODD[r["doc_id"]] or ""))
    assert sp.token_digests(spark.createDataFrame([], DOCS)).count() == 0


def _message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3 & 127 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_unigram_model():
    """A hand-made unigram model with white space collapsed: ids by both libraries agree."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("▁a", -2.0, 1), ("abc", -2.5, 1), ("c", -5.0, 1)]
    data = b"".join(_message([(1, _message([(1, p.encode()), (2, s), (3, k)]))]) for p, s, k in pieces)
    data += _message([(2, _message([(3, 1)])), (3, _message([(1, b"identity"), (3, 1), (4, 1), (5, 1)]))])
    model = sp.parse_model(data)
    assert model.kind == sp.UNIGRAM and model.collapse_spaces and len(model.pieces) == 9
    codec = sp.Codec(sp.build_tokenizer(model), data)
    texts = ["ab abc", "  c  ab  ", "", "abcab b a", "c"]
    ids, same = codec.encode(texts)
    import numpy as np

    assert [np.frombuffer(x, "<i4").tolist() for x in ids] == [codec.peer.encode(t) for t in texts] and all(same)


def test_key_frames_of_groups_and_stripped_headers():
    block = lambda n, body: b"\x81" + struct.pack(">hB", n, 0) + body
    stripping = m._element(m.COMPRESSION, m._unsigned(m.COMPRESSION_ALGORITHM, 3) + m._element(m.COMPRESSION_SETTINGS, b"ab"))
    entry = lambda c: m._element(m.TRACKS, m._element(m.TRACK_ENTRY, m._unsigned(m.TRACK_NUMBER, 1) + m._element(m.CONTENT_ENCODINGS, m._element(m.CONTENT_ENCODING, c))))
    group = lambda body, more=b"": m._element(m.BLOCK_GROUP, m._element(m.BLOCK, body) + more)
    cluster = m._element(m.CLUSTER, m._unsigned(m.TIMESTAMP, 0) + group(block(0, b"xx")) + group(block(1, b"yy"), m._element(m.REFERENCE_BLOCK, b"\xff")))
    data = m._element(m.SEGMENT, entry(stripping) + cluster)
    media = m.demux(data)
    assert media.keyframe == [True, False] and m.samples(data, media) == b"abxxabyy"
    data = m._element(m.SEGMENT, entry(m._element(m.COMPRESSION, m._unsigned(m.COMPRESSION_ALGORITHM, 0))) + cluster)
    with pytest.raises(ValueError):
        m.samples(data, m.demux(data))


def test_seek_by_cues():
    payload = bytes(range(192)) * 400
    data = m.mux(payload)
    media = m.demux(data)
    for time, _, offset in media.cues:
        found = m.seek(data, media, time)
        k = media.offset.index(found.offset[0])
        assert found.clusters[0][0] == offset and found.time == media.time[k : k + len(found.time)]
    assert m.seek(data, media, -1).offset == []
