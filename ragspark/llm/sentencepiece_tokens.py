"""SentencePiece models encoded and decoded by the tokenizers library, with parity against sentencepiece."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: characters that go to the library at once; bounds the memory of its encodings
BATCH_CHARS = 1 << 18
#: bytes of texts that a worker holds in words and tokens at once
PART_BYTES = 1 << 20
#: words whose ids a worker keeps, in each of two halves
KNOWN_WORDS = 250_000
#: rows decoded at once
DECODE_ROWS = 256


# ---- the model file


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, type
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True
    suffix_mark: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-size values come as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        elif wire == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire} in a model file")
        yield key >> 3, value


def parse_model(data: bytes) -> Model:
    """The parts of a SentencePiece model file that encoding needs."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            score = struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0]
            model.pieces.append((got.get(1, b"").decode("utf-8"), score, got.get(3, NORMAL)))
        elif number == 2:
            got = dict(_fields(value))
            model.kind = got.get(3, UNIGRAM)
            model.suffix_mark = bool(got.get(24, 0))
            model.byte_fallback = bool(got.get(35, 0))
        elif number == 3:
            got = dict(_fields(value))
            model.charsmap = got.get(2, b"")
            model.dummy_prefix, model.collapse_spaces, model.escape_spaces = (bool(got.get(k, 1)) for k in (3, 4, 5))
    model.unk_id = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.kind}: unigram (1) and BPE (2) are supported")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Merge rules of a BPE model: each way to make a piece of two others, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind in (NORMAL, USER_DEFINED):
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    found.append((-score, i, left, right, piece[:k], piece[k:]))
    return [x[4:] for x in sorted(found)]


def marks_only_lead(model: Model) -> bool:
    """Whether no piece has a mark after another character, so that no token reaches over the start of a word."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def build_tokenizer(model: Model) -> tuple[str, str | None]:
    """JSON of a tokenizers.Tokenizer for normalised text, and of its normaliser (None: text as it is).

    The normaliser has the file's character map and white-space rules. Words (marks and what follows them)
    are split before the model wherever that can't change the result, so that repeated words come from
    the library's cache.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix_mark:
        raise ValueError("models with white space as a suffix are not supported")
    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = Tokenizer(
            models.BPE(vocab, _merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
        )
    else:
        core = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback))
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.collapse_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if marks_only_lead(model):
        core.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    # marks become spaces once in the whole text, not token by token
    undo = [decoders.ByteFallback()] * model.byte_fallback + [decoders.Fuse(), decoders.Replace(MARK, " ")]
    core.decoder = decoders.Sequence(undo + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    norm = Tokenizer(models.BPE())
    norm.normalizer = normalizers.Sequence(steps)
    return core.to_str(), norm.to_str() if steps else None


# ---- encoding


class Codec:
    """Encoder and decoder of one worker; keeps the ids of words it has encoded and verified."""

    def __init__(self, built: tuple[str, str | None], data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # threads of a batch: a task has few cores, and each thread holds memory
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_str(built[0])
        self.core.encode_special_tokens = True
        self.normalizer = Tokenizer.from_str(built[1]).normalizer if built[1] else None
        self.model = m = parse_model(data)
        self.peer = SentencePieceProcessor(model_proto=data)
        self.plain = m.escape_spaces and m.dummy_prefix and not m.charsmap and not m.collapse_spaces
        self.by_words = marks_only_lead(m) and self.plain
        self.leads = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        # no piece holds a line break, so that no token reaches over one
        self.lone_breaks = not any("\n" in p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))
        # ids by word without its first mark, as little-endian int32; an older and a newer half
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.unequal: set[str] = set()

    def normalized(self, text: str) -> str:
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.normalizer.normalize_str(text) if self.normalizer and text else text

    def _library(self, texts: list[str]) -> list[bytes]:
        """Ids of normalised texts, in batches that the library spreads over its threads."""
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_CHARS or i == len(texts) - 1:
                got = self.core.encode_batch_fast(texts[start : i + 1], add_special_tokens=False)
                out += [np.array(x.ids, "<i4").tobytes() for x in got]
                start, size = i + 1, 0
        return out

    def _words(self, text: str) -> list[str]:
        """A text's words, the first mark of each left out. A word is marks (spaces) and what follows them.

        Where no token reaches over a line break, what follows one is a word of its own, without mark.
        """
        if "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " ":
            if self.lone_breaks and "\n" in text:
                text = text.replace("\n", " \n")
            return text.split(" ") if text else []
        word = f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*" if self.lone_breaks else f"{MARK}+[^{MARK}]*"
        return [w[1:] if w[0] == MARK else w for w in re.findall(word, self.normalized(text))]

    def _unmarked(self, word: str) -> bool:
        return self.lone_breaks and word[:1] == "\n"

    def _learn(self, words: set[str]) -> None:
        """Encode words with both libraries; of words on which they differ, sentencepiece's ids are kept."""
        new = [w for w in words if w not in self.known and w not in self.older]
        plain = sorted(w for w in new if w and MARK not in w)
        single = [w for w in new if not w or MARK in w]
        runs = [plain[k : k + 2048] for k in range(0, len(plain), 2048)]
        ours = self._library([MARK + MARK.join(run) for run in runs])
        theirs = self.peer.encode([" ".join(run) for run in runs], num_threads=1)
        for run, a, b in zip(runs, ours, theirs):
            ids = np.array(b, "<i4")
            starts = np.nonzero(self.leads[ids])[0]
            # a word's first token is the only one of it that begins with the mark
            if ids.tobytes() == a and len(starts) == len(run):
                cuts = [*(starts * 4).tolist(), len(a)]
                self.known.update(zip(run, (a[i + 4 * self._unmarked(w) : j] for w, i, j in zip(run, cuts, cuts[1:]))))
            else:
                single += run
        theirs = self.peer.encode([w.replace(MARK, " ") for w in single], num_threads=1)
        for w, a, b in zip(single, self._library([MARK + w for w in single]), theirs):
            b = np.array(b, "<i4").tobytes() if w else a  # a mark alone can't be asked for
            if a != b:
                self.unequal.add(w)
            self.known[w] = b[4 * self._unmarked(w) :]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as little-endian int32, and whether both libraries agree on them."""
        if not self.by_words:
            ours = self._library([self.normalized(t) for t in texts])
            theirs = [np.array(x, "<i4").tobytes() for x in self.peer.encode(texts, num_threads=1)]
            return theirs, [a == b for a, b in zip(ours, theirs)]
        words = [self._words(t) for t in texts]
        self._learn(set().union(*words))
        ids, known, older = [], self.known, self.older
        for ws in words:
            try:
                ids.append(b"".join(map(known.__getitem__, ws)))
            except KeyError:
                known.update((w, older[w]) for w in ws if w not in known)
                ids.append(b"".join(map(known.__getitem__, ws)))
        same = [self.unequal.isdisjoint(ws) for ws in words] if self.unequal else [True] * len(words)
        if len(known) > KNOWN_WORDS:
            self.known, self.older = {}, known
        return ids, same

    def forget(self) -> None:
        """Drop the words; between tasks they would hold memory that other stages on the executor need."""
        self.known, self.older, self.unequal = {}, {}, set()

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of token ids."""
        out: list[str] = []
        for k in range(0, len(ids), 64):
            out += self.core.decode_batch(ids[k : k + 64], skip_special_tokens=False)
        return out


_codecs: dict[str, Codec] = {}


def _codec(built: tuple[str, str | None], data: bytes) -> Codec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(built, data)
    return _codecs[key]


def _model_bytes(spark, path: str) -> bytes:
    """A model file from a local path, or through Spark's readers where the path has a scheme."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


#: columns that encoding can give, with their types
COLUMNS = {"input_ids": "array<int>", "n_tokens": "bigint", "ids_md5": "string", "parity": "boolean", "round_trip": "boolean"}


def encoded(
    docs: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH, want: tuple[str, ...] = ("input_ids", "parity")
) -> DataFrame:
    """docs with the wanted columns of COLUMNS.

    input_ids: the whole text's tokens. n_tokens: their number. ids_md5: MD5 of the ids joined by commas.
    parity: whether sentencepiece gives the same ids; a text without parity gets the ids of sentencepiece
    itself. round_trip: whether decoding gives the text back. Null and empty texts have no tokens, parity
    and round trip. Strings of control pieces in a text are ordinary text. Other columns stay; those named
    like wanted ones are replaced. The model file (its size is fixed) is read once by the driver and
    broadcast.
    """
    spark = docs.sparkSession
    data = _model_bytes(spark, model_path)
    shared = spark.sparkContext.broadcast((build_tokenizer(parse_model(data)), data))
    docs = docs.drop(*want)
    names, at = docs.columns, docs.columns.index(text_col)

    def columns(codec: Codec, texts: list[str]) -> dict[str, pa.Array]:
        ids, same = codec.encode(texts)
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
        out = {"n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "parity": pa.array(same, pa.bool_())}
        if "input_ids" in want:
            out["input_ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        if {"ids_md5", "round_trip"} & set(want):
            lists = [np.frombuffer(x, "<i4").tolist() for x in ids]
            out["ids_md5"] = pa.array([hashlib.md5(repr(x)[1:-1].replace(" ", "").encode()).hexdigest() for x in lists])
            if "round_trip" in want:
                out["round_trip"] = pa.array([a == b for a, b in zip(texts, codec.decode(lists))], pa.bool_())
        return out

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
            cuts = np.unique(np.searchsorted(np.cumsum(lengths), np.arange(0, lengths.sum() + 1, PART_BYTES)))
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                got = columns(codec, [x or "" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *(got[k] for k in want)], [*names, *want])
        codec.forget()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(encode, ", ".join([schema, *(f"{k} {COLUMNS[k]}" for k in want)]))


def decoded(tokens: DataFrame, ids_col: str = "input_ids", out: str = "decoded", model_path: str = MODEL_PATH) -> DataFrame:
    """tokens with a column of the texts that the ids stand for (null and empty: an empty text)."""
    spark = tokens.sparkSession
    data = _model_bytes(spark, model_path)
    shared = spark.sparkContext.broadcast((build_tokenizer(parse_model(data)), data))
    tokens = tokens.drop(out)
    names, at = tokens.columns, tokens.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(a, DECODE_ROWS)
                ids = [x or [] for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(ids), pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(decode, f"{schema}, `{out}` string")


def token_digests(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """Per row: (doc_id, n_tokens, ids_md5 of the comma-joined ids, round_trip, parity)."""
    want = ("n_tokens", "ids_md5", "round_trip", "parity")
    return encoded(docs.select("doc_id", "text"), model_path=model_path, want=want).select("doc_id", *want)
