"""Metrics of answers and contexts; lexical ones stand in for judged ones."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions.text import overlap_share, tokens


def sentence_bleu(response: str | None, reference: str | None, n_max: int = 4) -> float:
    """BLEU of one response: geometric mean of clipped n-gram precisions to 4, brevity penalty; 0 if one is 0.

    For shorter responses the orders that they have count.
    """
    got, want = (response or "").split(), (reference or "").split()
    if not got or not want:
        return float(got == want)
    logs = []
    for n in range(1, min(n_max, len(got)) + 1):
        a, b = (Counter(zip(*(x[i:] for i in range(n)))) for x in (got, want))
        match = sum((a & b).values())
        if not match:
            return 0.0
        logs.append(math.log(match / sum(a.values())))
    return min(1.0, math.exp(1 - len(want) / len(got))) * math.exp(sum(logs) / len(logs))


def bleu(df: DataFrame, response: str = "response", reference: str = "reference") -> DataFrame:
    """df with `bleu` of each response against its reference."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([sentence_bleu(x, y) for x, y in zip(a, b)], dtype=float)

    return df.withColumn("bleu", score(response, reference))


def context_recall(df: DataFrame, contexts: str = "retrieved_contexts", reference: str = "reference") -> DataFrame:
    """df with `context_recall`: share of the reference's distinct tokens found in any context."""
    return df.withColumn("context_recall", overlap_share(tokens(reference), F.flatten(F.transform(contexts, tokens))))


def context_precision(df: DataFrame, threshold: float, contexts: str = "retrieved_contexts", reference: str = "reference") -> DataFrame:
    """df with `context_precision`: mean precision at the ranks of useful contexts (0 without any).

    A context is useful if it holds a share `threshold` or more of the reference's distinct tokens.
    """
    useful = F.transform(contexts, lambda c: (overlap_share(tokens(reference), tokens(c)) >= threshold).cast("int"))
    told = df.withColumn("_useful", useful)
    summed = F.aggregate(
        F.transform("_useful", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"))),
        F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("total")),
        lambda a, v: F.struct(
            (a["hits"] + v["x"]).alias("hits"), (a["total"] + F.when(v["x"] == 1, (a["hits"] + 1) / v["n"]).otherwise(F.lit(0.0))).alias("total")
        ),
    )
    told = told.withColumn("_sum", summed)
    mean = F.when(F.col("_sum.hits") > 0, F.col("_sum.total") / F.col("_sum.hits")).otherwise(F.lit(0.0))
    return told.withColumn("context_precision", mean).drop("_useful", "_sum")


def answer_f1(df: DataFrame, key: str = "qid", response: str = "response", reference: str = "reference") -> DataFrame:
    """(key, token_precision, token_recall, token_f1) over the multisets of tokens; 0 where nothing is shared."""
    counts = lambda c, name: (
        df.select(key, F.explode(tokens(c)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias(name))
    )
    both = counts(response, "a").join(counts(reference, "b"), [key, "token"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    sums = both.groupBy(key).agg(F.sum(F.least(a, b)).alias("s"), F.sum(a).alias("a"), F.sum(b).alias("b"))
    held = df.select(key).join(sums, key, "left").fillna(0, ["s", "a", "b"])
    p = F.when(F.col("a") > 0, F.col("s") / F.col("a")).otherwise(F.lit(0.0))
    r = F.when(F.col("b") > 0, F.col("s") / F.col("b")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("s") > 0, 2 * F.col("s") / (F.col("a") + F.col("b"))).otherwise(F.lit(0.0))
    return held.select(key, p.alias("token_precision"), r.alias("token_recall"), f1.alias("token_f1"))


def eval_summary(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean) over the dataset; nulls don't count."""
    means = scores.agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in metrics))
    return means.unpivot([], metrics, "metric", "mean")
