"""Importance resampling towards a target: hashed features of words found by an Aho-Corasick dictionary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import unused, written
from ragspark.operators.position import with_position

BUCKETS = 10_000
NGRAMS = 1
MIN_WORDS = 20
#: share of the eligible documents that are drawn, in percent
PERCENT = 10
SEED = 2024
#: words of the dictionary, the most frequent ones, and bytes of the longest; other words are hashed where they stand
DICTIONARY_WORDS = 65_536
WORD_BYTES = 64
#: distinct words that a task counts before it hands their counts on
_COUNTED = 200_000
#: delimiters as a space, A-Z as a-z; bytes of other characters than ASCII stay
_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SPACE = crc32(b" ")
_automata: dict[int, ahocorasick.Automaton] = {}


def words_of(text: str | None) -> list[bytes]:
    """The words of a text (runs of digits, letters a-z after lower-casing A-Z, and non-ASCII characters) as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def _zeros(power: int) -> np.ndarray:
    """How each bit of a CRC-32 (without pre- and post-conditioning) moves through 2^power zero bytes."""
    columns = [1 << i for i in range(32)]
    for i, c in enumerate(columns):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        columns[i] = c
    for _ in range(power):
        columns = [_through(columns, c) for c in columns]
    return np.array(columns, np.uint64)


def _through(columns: list[int], crc: int) -> int:
    out, i = 0, 0
    while crc:
        if crc & 1:
            out ^= columns[i]
        crc >>= 1
        i += 1
    return out


_SHIFTS: list[np.ndarray] = []


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of their parts and the right part's bytes (arrays)."""
    out = left.astype(np.uint64)
    for power in range(int(length.max(initial=0)).bit_length()):
        if power == len(_SHIFTS):
            _SHIFTS.append(_zeros(power))
        moved = (length >> power) & 1 == 1
        now, after = out[moved], np.zeros(int(moved.sum()), np.uint64)
        for i in range(32):
            after ^= np.where((now >> np.uint64(i)) & np.uint64(1) == 1, _SHIFTS[power][i], np.uint64(0))
        out[moved] = after
    return out ^ right.astype(np.uint64)


def automaton(words: list[bytes]) -> ahocorasick.Automaton:
    """Words between two delimiters, each with its payload: CRC-32 in the low 32 bits, length above."""
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for w in words:
        found.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | crc32(w))
    if len(found):
        found.make_automaton()
    return found


def payloads(text: str | None, known: ahocorasick.Automaton) -> np.ndarray:
    """The payload of each word of a text, in order.

    The scan gives those of the dictionary's words; a stretch between two of them is hashed word by word.
    """
    line = b" ".join([b"", *words_of(text), b""])
    out: list[int] = []
    end = 0  # of the last word, where the next one's delimiter stands
    if len(known):
        for at, payload in known.iter(line.decode("latin-1")):
            start = at - (payload >> 32) - 1
            if start > end:
                out += [len(w) << 32 | crc32(w) for w in line[end:start].split()]
            out.append(payload)
            end = at
    if end < len(line) - 1:
        out += [len(w) << 32 | crc32(w) for w in line[end:].split()]
    return np.array(out, np.int64)


def features(found: np.ndarray, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of 1 to ngrams consecutive words, from adjacent words' payloads."""
    crc, length = (found & 0xFFFFFFFF).astype(np.uint64), found >> 32
    out, run = [crc], crc
    for n in range(2, min(ngrams, len(found)) + 1):
        spaced = composed(run[:-1], np.full(len(run) - 1, _SPACE, np.uint64), np.ones(len(run) - 1, np.int64))
        run = composed(spaced, crc[n - 1 :], length[n - 1 :])
        out.append(run)
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64)


def dictionary(texts: DataFrame, words: int = DICTIONARY_WORDS) -> list[bytes]:
    """The most frequent distinct words of texts(text), `words` of them at most.

    Words are taken by levels of their logarithmic frequency, as many whole levels as fit, so that nothing but the
    levels' sizes and the words themselves reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > _COUNTED:
                    yield told()
                    seen.clear()
        yield told()

    counts = texts.select("text").mapInArrow(count, "word binary, n long").where(F.length("word") <= WORD_BYTES)
    level = F.floor(F.log2("n") * 16).cast("int").alias("level")
    leveled = written(counts.groupBy("word").agg(F.sum("n").alias("n")).select("word", level))
    sizes, least, held = sorted(leveled.groupBy("level").count().collect(), reverse=True), None, 0  # some hundred levels
    for r in sizes:
        held += r["count"]
        if held > words:
            break
        least = r["level"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in leveled.where(F.col("level") >= least).select("word").collect())  # words * WORD_BYTES at most


def _known(shared) -> ahocorasick.Automaton:
    """The worker's automaton of a broadcast dictionary."""
    key = shared.value[0]
    if key not in _automata:
        _automata.clear()
        _automata[key] = automaton(shared.value[1])
    return _automata[key]


def bucket_counts(texts: DataFrame, shared, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in texts(text); a task hands on one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _known(shared), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(payloads(text.as_py(), known), ngrams, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares of target and source, rounded down."""
    more, less = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * more / ((s + 1.0) * less))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, ngrams: int = NGRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
    seed: int = SEED, dictionary_words: int = DICTIONARY_WORDS,
) -> DataFrame:
    """docs(doc_id, text), target(text) -> (doc_id, n_features, weight, score, rank), a row a document.

    weight: the mean gain of a document's features, rounded down (0 without any). score: weight and Gumbel noise
    from the id (a null id counts as an empty one). Of the documents with min_words words or more, percent in a
    hundred (rounded down) with the highest scores are drawn and have a rank from 1; ties go to the smaller id.
    Null and empty texts have no words. Repeated rows are documents of their own; those of one id and text tie
    and come in any order. An empty target makes every gain that of unseen buckets. Other columns are left out.
    """
    spark = docs.sparkSession
    words = dictionary(docs.select("text").unionByName(target.select("text")), dictionary_words)
    shared = spark.sparkContext.broadcast((hash(tuple(words)), words))
    gain = gains(bucket_counts(docs, shared, ngrams, buckets), bucket_counts(target, shared, ngrams, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared)
        for batch in batches:
            n_words, n, weight = [], [], []
            for text in batch.column(1):
                found = payloads(text.as_py(), known)
                at = features(found, ngrams, buckets)
                n_words.append(len(found))
                n.append(len(at))
                weight.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n, weight))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("score", (F.col("weight") + noise).cast("long")))
    long_enough = scored.where(F.col("n_words") >= min_words)
    drawn = percent * long_enough.count() // 100
    least = unused(scored, "_least")
    placed = with_position(long_enough.withColumn(least, -F.col("score")), [least, "doc_id"], start=1, name="rank").drop(least)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
with crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
docs as (select row_number() over () as r, doc_id, {_WORDS} as words from documents),
found as (select r, unnest(words) as w from docs),
aimed as (select unnest({_WORDS}) as w from benchmark),
each_word as (select w, hex(w) as x from (select w from found union select w from aimed)),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % {BUCKETS} as bucket from each_word, crc_table),
s as (select bucket, count(*) as n from found join hashed using (w) group by bucket),
t as (select bucket, count(*) as n from aimed join hashed using (w) group by bucket),
gain as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from s) + {BUCKETS})::double
    / ((coalesce(s.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from t) + {BUCKETS})::double)))::bigint as g from s full join t using (bucket)),
told as (select r, floor(sum(g)::double / count(*))::bigint as weight from found join hashed using (w) join gain using (bucket) group by r),
scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score from docs left join told using (r)),
placed as (select *, case when n_features >= {MIN_WORDS} then row_number() over (partition by n_features >= {MIN_WORDS} order by score desc, doc_id) end as place from scored)
select doc_id, n_features, weight, score, case when place <= (select count(*) * {PERCENT} // 100 from scored where n_features >= {MIN_WORDS}) then place end as rank from placed
"""
