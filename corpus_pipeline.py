"""A training-data pipeline over documents, stage by stage.

Each stage's rows are written as Parquet to the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragspark.llm import decontamination, secrets, sentencepiece_tokens, simhash, toxicity
from ragspark.llm.tables import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near duplicates the document with the smallest id stays."""
    return simhash.deduplicated(docs)


def without_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are replaced in the texts; no document goes. Who holds a secret is counted over all documents."""
    return secrets.redacted(docs, table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, whether both libraries agree on them, and whether they decode to it."""
    found = sentencepiece_tokens.encoded(docs, want=("input_ids", "n_tokens", "parity", "round_trip"))
    return found.select("doc_id", "lang", "source", "n_chars", "n_tokens", "input_ids", "parity", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark_leaks),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: no SQL: the classifier, XXH64 fingerprints and the tokenizer can't be expressed in it
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
