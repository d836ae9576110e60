"""Reranking of hits, and late interaction over patch vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ragspark.functions.text import overlap_share, tokens
from ragspark.operators.search import SCORE_CELLS, by_blocks, knn_exact
from ragspark.storage import scratch, written

#: patches of one matrix
MATRIX_ROWS = 1024


def lexical_overlap_scorer(question: str | Column, text: str | Column) -> Column:
    """Share of the question's distinct tokens that the text holds."""
    return overlap_share(tokens(question), tokens(text))


def rerank(hits: DataFrame, scorer: Column | Callable[[], Callable[[pd.DataFrame], np.ndarray]], top_n: int = 5) -> DataFrame:
    """hits(qid, rank, ...) with `rerank_score` and `new_rank` from 0: the top_n of each query, ties in the old order.

    scorer: a column, or a function that a worker calls once to get a batch scorer (one score a row).
    """
    if isinstance(scorer, Column):
        told = hits.withColumn("rerank_score", scorer)
    else:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema), "rerank_score double"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score = scorer()
            for batch in batches:
                found = np.asarray(score(batch), float)
                if len(found) != len(batch):
                    raise ValueError(f"{len(found)} scores for {len(batch)} pairs")
                yield batch.assign(rerank_score=found)

        told = hits.mapInPandas(run, schema)
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    return told.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_n).withColumn("new_rank", F.col("new_rank") - 1)


def candidate_docs(query_tokens: DataFrame, patches: DataFrame, k: int = 50, metric: str = "IP") -> DataFrame:
    """query_tokens(qid, tok, vector), patches(doc_id, seq_id, vector) -> distinct (qid, doc_id) of each token's k best patches."""
    asked = query_tokens.select(F.struct("qid", "tok").alias("key"), "vector")
    asked = asked.select(F.to_json("key").alias("qid"), "vector")
    # a patch is named by both its numbers, the document's in the high bits, above as many as the other one takes
    ends = patches.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("seq_id").alias("first"), F.max("seq_id").alias("last")).first()
    bits = max(ends["last"] or 0, 0).bit_length()
    if (ends["first"] or 0) < 0 or max(ends["hi"] or 0, -(ends["lo"] or 0)) >= 1 << (63 - bits):
        raise ValueError(f"documents {ends['lo']} to {ends['hi']} and patches {ends['first']} to {ends['last']} don't fit one number")
    named = patches.select((F.shiftleft(F.col("doc_id").cast("long"), bits) + F.col("seq_id")).alias("id"), "vector")
    hits = knn_exact(asked, named, k, metric)
    qid = F.from_json("qid", f"qid {query_tokens.schema['qid'].dataType.simpleString()}")["qid"]
    return hits.select(qid.alias("qid"), F.shiftright("id", bits).alias("doc_id")).distinct()


def patch_matrices(patches: DataFrame, table: str | None = None, buckets: int = 64) -> DataFrame:
    """patches(doc_id, seq_id, vector) -> (doc_id, part, dim, matrix): a document's patches as one flat matrix.

    A document of more than MATRIX_ROWS patches has several parts. With a table name the matrices are stored as
    that table in the shared folder, bucketed by document, so that a search joins them without moving them;
    spark.table reads it again. Null vectors are left out; vectors of several dimensions are matrices of their own.
    """
    part = F.floor(F.coalesce("seq_id", F.lit(0)) / MATRIX_ROWS).cast("int").alias("part")
    held = patches.where("doc_id is not null and vector is not null").select("doc_id", part, F.size("vector").alias("dim"), "seq_id", "vector")
    rows = F.array_sort(F.collect_list(F.struct("seq_id", "vector")))["vector"]
    out = held.groupBy("doc_id", "part", "dim").agg(F.flatten(rows).alias("matrix"))
    if table is None:
        return out
    writer = out.write.mode("overwrite").option("path", scratch(patches.sparkSession)).bucketBy(buckets, "doc_id").sortBy("doc_id")
    writer.saveAsTable(table)
    return patches.sparkSession.table(table)


def _tiles(items: list[int], cells: list[int]) -> Iterator[list[int]]:
    """items in groups of SCORE_CELLS cells at most, and of one at least."""
    group, held = [], 0
    for item, n in zip(items, cells):
        if group and held + n > SCORE_CELLS:
            yield group
            group, held = [], 0
        group.append(item)
        held += n
    if group:
        yield group


def maxsim(query_tokens: DataFrame, patches: DataFrame, candidates: DataFrame, top_k: int | None = None) -> DataFrame:
    """(qid, rank, doc_id, score): the sum over a query's tokens of the best dot product with a patch of the document.

    patches: as rows (doc_id, seq_id, vector) or as patch_matrices. The queries' token matrices go to all tasks, in
    blocks of 64 MB at most; a document's matrix meets those of its candidates at once and leaves a maximum a
    token. Only candidates and maxima are shuffled. Ties by doc_id; all candidates without top_k. Null vectors, and
    those of another dimension than the largest token's, are left out, and candidates without any others.
    """
    matrices = patches if "matrix" in patches.columns else patch_matrices(patches)
    tokens_of = F.array_sort(F.collect_list(F.struct("tok", "vector")))["vector"]
    asked = query_tokens.where("qid is not null and vector is not null")
    dim = asked.agg(F.max(F.size("vector"))).first()[0] or 0
    asked = written(asked.where(F.size("vector") == dim).groupBy("qid").agg(F.flatten(tokens_of).alias("vector")))
    cells = asked.agg(F.max(F.size("vector"))).first()[0] or 0
    pairs = candidates.select("qid", "doc_id").distinct()
    kind = matrices.schema["doc_id"].dataType.simpleString()
    qid_kind = asked.schema["qid"].dataType.simpleString()

    def search(rows: list[Row]) -> DataFrame:
        tokens = [np.array(r["vector"], float).reshape(-1, max(dim, 1)) for r in rows]
        shared = asked.sparkSession.sparkContext.broadcast(([r["qid"] for r in rows], tokens))
        named = asked.sparkSession.createDataFrame([(r["qid"], n) for n, r in enumerate(rows)], f"qid {qid_kind}, n int")
        # as many entries a document as the block has queries, at most
        wanted = pairs.join(F.broadcast(named), "qid").groupBy("doc_id").agg(F.collect_set("n").alias("asking"))

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, of = shared.value
            for batch in batches:
                out: tuple[list, list, list] = ([], [], [])
                for doc, matrix, asking in zip(batch["doc_id"], batch["matrix"], batch["asking"]):
                    p, asks = np.asarray(matrix, float).reshape(-1, dim), np.asarray(asking).tolist()
                    for group in _tiles(asks, [len(of[n]) * len(p) for n in asks]):
                        tops = (np.concatenate([of[n] for n in group]) @ p.T).max(axis=1)
                        ends = np.cumsum([len(of[n]) for n in group])
                        out[0].extend(qids[n] for n in group)
                        out[1].extend([doc] * len(group))
                        out[2].extend(np.split(tops, ends[:-1]))
                yield pd.DataFrame({"qid": out[0], "doc_id": out[1], "best": out[2]})

        joined = matrices.where(F.col("dim") == dim).join(wanted, "doc_id").select("doc_id", "matrix", "asking")
        return joined.mapInPandas(meet, f"qid {qid_kind}, doc_id {kind}, best array<double>")

    found = by_blocks(asked, 8 * cells, search)
    # a row a part of a document
    each = found.groupBy("qid", "doc_id").agg(F.collect_list("best").alias("b"))
    tops = F.aggregate("b", F.col("b")[0], lambda a, x: F.zip_with(a, x, lambda u, v: F.greatest(u, v)))
    total = each.select("qid", "doc_id", F.aggregate(tops, F.lit(0.0), lambda a, x: a + x).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    out = total.withColumn("rank", F.row_number().over(w))
    out = out if top_k is None else out.where(F.col("rank") <= top_k)
    return out.select("qid", (F.col("rank") - 1).alias("rank"), "doc_id", "score")
