"""Exact nearest-neighbour search, contexts, search reports and recall."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ragspark.functions.vectors import best_first, dot, norm, similarity, squared_distance
from ragspark.operators.position import with_position
from ragspark.storage import written

#: bytes of a query matrix that goes to all executors; more queries are searched block by block
QUERY_BYTES = 64 << 20
#: scores that a task holds at once
SCORE_CELLS = 4 << 20
#: entries of a vector up to which a score of built-in functions is spelled out entry by entry
SPELLED = 128


def scores(metric: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """queries x vectors, in double precision; L2 is squared."""
    if metric == "L2":
        return np.maximum((queries**2).sum(1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(1), 0)
    found = queries @ vectors.T
    if metric == "COSINE":
        with np.errstate(divide="ignore", invalid="ignore"):
            found = found / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1))
    return found


def top_of(ids: np.ndarray, found: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best, ties by id; values that aren't numbers come last and are left out."""
    key = np.where(np.isnan(found), np.inf, found if metric == "L2" else -found)
    if key.shape[1] > k:
        worst = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((key <= worst) & np.isfinite(key))  # ties at the edge stay until they are ranked
    else:
        rows, cols = np.nonzero(np.isfinite(key))
    order = np.lexsort((ids[cols], key[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], cols[nth < k]


def ranked(hits: DataFrame, k: int, metric: str, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Hits (qid, id, score) with their rank from 0, the k best of each query; ties by id."""
    w = Window.partitionBy(*by).orderBy(best_first(metric, "score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _matrix(rows: list, dim: int) -> np.ndarray:
    return np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), dim)


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "L2") -> DataFrame:
    """queries(qid, vector), vectors(id, vector) -> (qid, rank, id, score): each query's k nearest, ties by id.

    The query matrix goes to every task, which keeps the k best of each batch; only these are shuffled. More
    queries than QUERY_BYTES hold are searched in blocks, one after the other. Vectors of another dimension
    than the first query's, null ones, and ones with values that aren't numbers are left out.
    """
    similarity(metric, F.lit(None), F.lit(None))
    asked, dim = _asked(queries)
    types = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    usable = vectors.where(F.col("vector").isNotNull() & (F.size("vector") == dim)).select("id", "vector")

    def search(rows: list[Row]) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["qid"] for r in rows]), _matrix(rows, dim)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, matrix = shared.value
            for batch in batches:
                if len(batch):
                    ids, rows = batch["id"].to_numpy(), np.stack(batch["vector"].to_numpy()).astype(np.float64)
                    for part in tiles(len(qids), len(ids)):
                        found = scores(metric, matrix[part], rows)
                        i, j = top_of(ids, found, k, metric)
                        yield pd.DataFrame({"qid": qids[part][i], "id": ids[j], "score": found[i, j]})

        return usable.mapInPandas(scan, types)

    return ranked(by_blocks(asked, 8 * dim, search), k, metric).select("qid", "rank", "id", "score")


def _asked(queries: DataFrame) -> tuple[DataFrame, int]:
    """Queries with a vector, and their dimension (that of the first; 0 without any)."""
    asked = queries.where("vector is not null").select("qid", "vector")
    first = asked.select(F.size("vector").alias("d")).first()
    dim = first["d"] if first else 0
    return asked.where(F.size("vector") == dim), dim


def tiles(n_queries: int, n_rows: int) -> Iterator[slice]:
    """Slices of the queries for which a matrix of scores over so many rows has SCORE_CELLS cells at most."""
    step = max(1, SCORE_CELLS // max(n_rows, 1))
    return (slice(a, a + step) for a in range(0, n_queries, step))


def by_blocks(asked: DataFrame, bytes_per_query: int, search: Callable[[list[Row]], DataFrame], few: bool = False) -> DataFrame:
    """Hits of search over blocks of the queries (qid, vector), rows at the driver, of QUERY_BYTES at most.

    Of several blocks each one's hits are written before the next is searched. few: something else bounds the
    queries (a micro-batch's trigger, say), so that they are collected at once and not counted first.
    """
    per_block, out = max(1, QUERY_BYTES // max(bytes_per_query, 1)), None
    if few or asked.count() <= per_block:
        rows = asked.collect()
        if len(rows) <= per_block:
            return search(rows)
        blocks = (rows[at : at + per_block] for at in range(0, len(rows), per_block))
    else:
        placed = with_position(asked, "qid", name="_pos")
        n = placed.count()
        blocks = (placed.where(F.floor(F.col("_pos") / per_block) == b).drop("_pos").collect() for b in range(-(-n // per_block)))
    for block in blocks:
        hits = written(search(block))
        out = hits if out is None else out.unionByName(hits)
    return out


def knn_exact_sql(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "L2") -> DataFrame:
    """knn_exact by built-in functions alone: each block of queries goes to all executors and meets every row there.

    Vectors of up to SPELLED entries become a column an entry, so that Spark compiles the score. Each query's k-th
    best score among some rows (about the root of k times all) bounds what can be among its k best of all rows, so that only
    scores as good as that one are ranked. A vector of norm zero has no cosine.
    """
    similarity(metric, F.lit(None), F.lit(None))
    asked, dim = _asked(queries)
    v = vectors.where(F.col("vector").isNotNull() & (F.size("vector") == dim)).select("id", "vector")
    n = v.count()
    some = math.isqrt(k * n) + k
    worst = float("inf") if metric == "L2" else float("-inf")
    # few bytes meet many queries, so they are dealt over as many tasks as shuffles have
    spread = _entries(v.repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"), "v", dim, metric)
    score = F.nanvl(_score(metric, dim), F.lit(None).cast("double"))

    def search(rows: list[Row]) -> DataFrame:
        block = _entries(v.sparkSession.createDataFrame(rows, asked.schema), "q", dim, metric)
        near = spread.where(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < some).join(F.broadcast(block), score.isNotNull())
        kth = ranked(near.select("qid", "id", score.alias("score")), k, metric).where(F.col("rank") == k - 1).select("qid", F.col("score").alias("kth"))
        bounded = block.join(written(kth), "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(worst)))
        return spread.join(F.broadcast(bounded), score <= F.col("kth") if metric == "L2" else score >= F.col("kth")).select("qid", "id", score.alias("score"))

    return ranked(by_blocks(asked, 8 * dim, search), k, metric).select("qid", "rank", "id", "score")


def _entries(df: DataFrame, name: str, dim: int, metric: str) -> DataFrame:
    """df with its column vector as double columns, or as one array where it is long, and with its norm where the metric asks for it.

    NaN stands for what isn't there, so that Spark needs no null checks between them.
    """
    nan, v = F.lit(float("nan")), F.col("vector").cast("array<double>")
    if dim <= SPELLED:
        columns = [F.coalesce(F.get(v, F.lit(i)), nan).alias(f"{name}{i}") for i in range(dim)]
    else:
        columns = [F.transform(v, lambda x: F.coalesce(x, nan)).alias(name)]
    if metric == "COSINE":
        length = norm("vector")
        columns.append(F.coalesce(F.when(length > 0, length), nan).alias(f"{name}_norm"))
    return df.select(*(c for c in df.columns if c != "vector"), *columns)


def _score(metric: str, dim: int) -> Column:
    """Score of a row's columns q and v as _entries names them."""
    if dim <= SPELLED:
        pairs = ((F.col(f"q{i}"), F.col(f"v{i}")) for i in range(dim))
        found = sum(((a - b) * (a - b) if metric == "L2" else a * b for a, b in pairs), F.lit(0.0))
    else:
        found = squared_distance("q", "v") if metric == "L2" else dot("q", "v")
    return found / (F.col("q_norm") * F.col("v_norm")) if metric == "COSINE" else found


def format_contexts(hits: DataFrame) -> DataFrame:
    """hits(qid, rank, text) -> (qid, contexts): the formatted contexts in rank order."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\n+", "\n")
    ctx = F.concat(F.lit("Source #"), F.col("rank").cast("string"), F.lit("\nDetail: "), text, F.lit("\n"))
    grouped = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", ctx.alias("ctx")))).alias("found"))
    return grouped.select("qid", F.col("found.ctx").alias("contexts"))


def search_report(hits: DataFrame) -> DataFrame:
    """hits(qid, rank, id, score, text) -> a row a hit with its query's number of hits and the text's length."""
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    return hits.select("qid", n.alias("n_hits"), "rank", "id", F.col("score").alias("distance"), F.length("text").alias("text_length"))


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): share of each query's exact neighbours that the approximate hits hold."""
    got = approx.select("qid", "id", F.lit(1).alias("hit")).distinct()
    return exact.select("qid", "id").join(got, ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
