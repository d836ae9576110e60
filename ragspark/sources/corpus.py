"""Corpora, question sets, file listings, collections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragspark.operators.position import with_position
from ragspark.operators.slices import prefix, ranked_slice


def load_corpus(spark: SparkSession, path: str, text_col: str, id_col: str) -> DataFrame:
    """(content, metadata) of a Parquet corpus; only these two columns are read."""
    return spark.read.parquet(path).select(F.col(text_col).alias("content"), F.col(id_col).alias("metadata"))


def dataset_slice(df: DataFrame, length: int, offset: int, order_by: str) -> DataFrame:
    """Rows [offset * length, (offset + 1) * length) in the order of order_by; the end is clipped.

    Raises ValueError where the slice begins beyond the rows.
    """
    if length < 1 or offset < 0:
        raise ValueError("length must be positive and offset not negative")
    start, total = offset * length, df.count()
    if start >= total:
        raise ValueError(f"slice starts at row {start} of {total}")
    return ranked_slice(df, start, min(start + length, total), order_by, total)


def dataset_ratio(df: DataFrame, ratio: float, order_by: str) -> DataFrame:
    """The first int(total * ratio) rows in the order of order_by: a prefix, not a sample."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio lies between 0 and 1")
    total = df.count()
    return prefix(df, int(total * ratio), order_by, total)


def list_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(content: path) of the files that match, by name; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.col("path").alias("content"), "length", "modificationTime").orderBy(F.element_at(F.split("content", "/"), -1))


def fetch_manifest(items: DataFrame, have: DataFrame, limit: int | None = None) -> DataFrame:
    """items(id, url) -> (id, url, filename) still to fetch: abstract addresses become PDF addresses, what
    `have`(filename) lists is dropped, and with a limit the first ones by id are kept."""
    url = F.replace(F.col("url"), F.lit("arxiv.org/abs/"), F.lit("arxiv.org/pdf/"))
    wanted = items.select("id", url.alias("url"), F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("filename"))
    missing = wanted.join(have.select("filename"), "filename", "left_anti").select("id", "url", "filename")
    return missing if limit is None else missing.orderBy("id").limit(limit)


def question_answers(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, turn, question, ground_truth): user turns and the assistant's next turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    told = turns.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return told.where("role = 'user' and next_role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("ground_truth")
    )


def question_batches(df: DataFrame, batch_size: int, count: int | None = None, order_by: str | list[str] = "qid") -> DataFrame:
    """(qid, batch_no, question, ground_truth): the first `count` questions in batches of batch_size."""
    placed = with_position(df, order_by, name="_pos")
    placed = placed if count is None else placed.where(F.col("_pos") < count)
    return placed.select(
        F.col("_pos").alias("qid"), F.floor(F.col("_pos") / batch_size).cast("long").alias("batch_no"), "question", "ground_truth"
    )


def save_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def load_embeddings(spark: SparkSession, path: str, vector_col: str = "vector") -> tuple[DataFrame, int]:
    """The stored vectors and their dimension, taken from the first (0 for an empty table)."""
    df = spark.read.parquet(path)
    first = df.select(F.size(vector_col).alias("dim")).first()
    return df, first["dim"] if first else 0


MODES = {"recreate": "overwrite", "append": "append", "create": "ignore"}


def write_collection(df: DataFrame, path: str, mode: str = "recreate") -> None:
    """Write a collection: recreate (replace what is there), append, or create (only if absent)."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}: {', '.join(MODES)} are known")
    df.write.mode(MODES[mode]).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs become JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
