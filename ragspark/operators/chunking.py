"""Cutting documents into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", " ", "")


def overlap_chars(chunk_size: int, overlap: float) -> int:
    """An integer counts characters; a value between 0 and 1 is a share of chunk_size."""
    found = round(chunk_size * overlap) if 0 < overlap < 1 else int(overlap)
    if not 0 <= found < chunk_size:
        raise ValueError("the overlap must be shorter than a chunk")
    return found


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separators that allow it.

    Pieces keep the separator behind them, so that with overlap 0 the chunks joined are the text.
    """
    pieces, todo = [], [(text, 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= size:
            pieces.append(part)
            continue
        while level < len(separators) and separators[level] and separators[level] not in part:
            level += 1
        sep = separators[level] if level < len(separators) else ""
        if sep:
            cut = part.split(sep)
            todo += [(x, level + 1) for x in reversed([c + sep for c in cut[:-1]] + [cut[-1]]) if x]
        else:
            pieces += [part[k : k + size] for k in range(0, len(part), size)]
    chunks, now = [], ""
    for piece in pieces:
        if now and len(now) + len(piece) > size:
            chunks.append(now)
            now = now[-overlap:] if overlap and len(piece) + overlap <= size else ""
        now += piece
    return [c for c in [*chunks, now] if c]


def chunk_recursive(
    df: DataFrame, chunk_size: int = 512, overlap: float = 0, separators: tuple[str, ...] = SEPARATORS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, chunk_no, text): paragraphs, else lines, words, characters, packed up to chunk_size."""
    carried = overlap_chars(chunk_size, overlap)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split_text(t or "", chunk_size, carried, separators))

    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(cut(text_col)).alias("chunk_no", "text"))


def chunk_fixed(df: DataFrame, chunk_size: int, overlap: float = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_no, text): windows of chunk_size characters, chunk_size - overlap apart; none of an empty text."""
    stride = chunk_size - overlap_chars(chunk_size, overlap)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(stride))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    rows = rows.select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "at"))
    return rows.select("doc_id", "chunk_no", F.substring("text", F.col("at") + 1, F.lit(chunk_size)).alias("text"))


def chunk_structural(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_no, text): one chunk for each line that isn't blank, in order."""
    lines = F.filter(F.split(text_col, "\r\n|\n|\r"), lambda x: F.trim(x) != "")
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("chunk_no", "text"))


def page_manifest(files: DataFrame, folder: str) -> DataFrame:
    """files(name, n_pages) -> (name, page_no, path): one row a page of each .pdf file, numbered from 1."""
    pdf = files.where(F.lower("name").endswith(".pdf") & (F.col("n_pages") > 0))
    base = F.regexp_extract("name", "([^/]*)\\.[pP][dD][fF]$", 1)
    pages = pdf.select("name", base.alias("base"), F.explode(F.sequence(F.lit(1), "n_pages")).alias("page_no"))
    return pages.select("name", "page_no", F.format_string(f"{folder}/pages/%s_page_%d.png", "base", "page_no").alias("path"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, and their lengths' minimum, mean and maximum."""
    n = F.length("text")
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min(n).alias("min_len"), F.avg(n).alias("avg_len"), F.max(n).alias("max_len")
    )
