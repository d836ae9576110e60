"""Nearest neighbours through stable projections: kd-trees over few projected dimensions, a chi-square stopping test.

A vector's difference to a query, projected on a standard normal direction, is normal with the true distance as its
deviation. Over PROJECTIONS directions the squared projected distance over the squared true one is chi-square
distributed, so a candidate nearer than the k-th best d lies within d * sqrt(quantile) in the projection with the
probability asked for. Projected neighbours are visited in order and verified until they lie further out than that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.tables import first_by_hash, written

#: projected dimensions; even, so that the chi-square distribution has a closed form
PROJECTIONS = 8
#: probability that a true neighbour at the edge lies within the stopping radius; nearer ones do more surely
CONFIDENCE = 0.99
#: vectors of a block (one kd-tree), queries that meet a block at once, vectors of a leaf
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
LEAF_ROWS = 256
#: projected vectors that place the cells; every vector is indexed
SAMPLE_ROWS = 65_536
#: parts in which the rows of one vector are met before its smallest ids are known
SALTS = 32
_SEED = 20_24


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square of `dims` (even) <= x) = p."""

    def below(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    """(dim + 1) x projections standard normal numbers; the last row is for the coordinate that inner products add."""
    return np.random.default_rng(_SEED).standard_normal((dim + 1, projections))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): rows with an id and a vector that isn't null, empty or zero and holds numbers only; -0 becomes 0."""
    x = F.col(vector_col)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & x.isNotNull() & good & F.exists(x, lambda c: c != 0))
    kind = df.schema[vector_col].dataType
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: c + F.lit(0).cast("float")).cast(kind).alias("vector"))


def _keys(vector: str | Column = "vector") -> list[Column]:
    """128 bits that name a vector."""
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(_SEED), vector).alias("h2")]


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """usable rows -> (ids, vector): each distinct vector once, with its k smallest ids in order.

    No query can list more than k copies of one vector, and ties go to smaller ids, so no hit is lost. Ids are
    brought together by hashes of the vectors, first within SALTS parts of a vector's rows; a vector with a third
    of all rows leaves k ids a part. The vectors themselves move once.
    """
    keyed = rows.select("id", "vector", *_keys())
    few = keyed.select("id", "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    for by in (["h1", "h2", "salt"], ["h1", "h2"]):
        few = few.withColumn("n", F.dense_rank().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= k)
    named = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    named = named.withColumn("id", F.col("ids")[0])
    met = keyed.join(named, ["id", "h1", "h2"])
    return met.groupBy("id", "h1", "h2").agg(F.first("ids").alias("ids"), F.first("vector").alias("vector")).select("ids", "vector")


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate([np.zeros(0), *vectors.to_numpy()]).astype(np.float64).reshape(-1, dim)


@dataclass
class ProjectedIndex:
    """rows (ids, vector, p) with their cells in projected space.

    dims, splits: the tree over cells, a node's children at 2 i + 1 and 2 i + 2; low, high: each cell's box;
    buckets: parts in which a cell of many vectors is dealt out. top: the largest squared norm.
    """

    rows: DataFrame
    dim: int
    top: float
    dims: np.ndarray
    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    buckets: np.ndarray
    projections: int
    block_rows: int


def projected(x: np.ndarray, top: float | None, projections: int) -> np.ndarray:
    """Projections of vectors; with `top`, of vectors that get a further coordinate so that all have norm sqrt(top).

    For those the squared distance to a query without that coordinate is |q|^2 + top - 2 q.x: the nearest one is
    the one of largest inner product.
    """
    along = directions(x.shape[1], projections)
    if top is None:
        return x @ along[:-1]
    return x @ along[:-1] + np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None] * along[-1]


def cells_of(p: np.ndarray, dims: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The cell of each projected vector."""
    at = np.zeros(len(p), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        at = 2 * at + 1 + (p[np.arange(len(p)), dims[at]] > splits[at])
    return (at - len(dims)).astype(np.int32)


def _tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Median splits along the widest dimension, `depth` levels deep."""
    dims, splits, parts = [], [], [sample]
    for _ in range(depth):
        below = []
        for part in parts:
            wide = int(np.argmax(part.max(0) - part.min(0))) if len(part) else 0
            at = float(np.median(part[:, wide])) if len(part) else 0.0
            dims.append(wide)
            splits.append(at)
            below += [part[part[:, wide] <= at], part[part[:, wide] > at]]
        parts = below
    return np.array(dims, np.int64), np.array(splits, np.float64)


def build(rows: DataFrame, k: int, projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> ProjectedIndex | None:
    """Index of usable rows (id, vector) for searches of k neighbours; None where there are none.

    Vectors of another dimension than the most frequent one (of several: the largest) are left out. Cells are
    placed by sample_rows projected vectors (the first by a hash of their ids); every vector is in one. A cell
    of more than block_rows vectors is dealt out over several blocks.
    """
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    dim = size["d"]
    rows = rows.where(F.size("vector") == dim)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    top = float(rows.agg(F.max(norm)).first()[0])
    kind = rows.schema["vector"].dataType.simpleString()

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(p=list(projected(_matrix(batch["vector"], dim), top, projections)))

    # the index holds one id more than asked for, as a query's own may be among them
    held = written(distinct_vectors(rows, k + 1).mapInPandas(project, f"ids array<bigint>, vector {kind}, p array<double>"))
    n = held.count()
    sample = first_by_hash(held.select(F.col("ids")[0].alias("id"), "p"), sample_rows, "id").select("p").toPandas()
    depth = max(0, min(math.ceil(math.log2(n / block_rows)), int(math.log2(max(len(sample) / 8, 1)))))
    dims, splits = _tree(_matrix(sample["p"], projections), depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = _matrix(batch["p"], projections)
            cells = cells_of(p, dims, splits)
            for c in np.unique(cells):
                own = p[cells == c]
                yield pd.DataFrame({"cell": [c], "n": [len(own)], "lo": [own.min(0)], "hi": [own.max(0)]})

    ends = [f(F.col(c)[j]).alias(f"{c}{j}") for f, c in ((F.min, "lo"), (F.max, "hi")) for j in range(projections)]
    boxes = held.select("p").mapInPandas(place, "cell int, n long, lo array<double>, hi array<double>").groupBy("cell").agg(F.sum("n").alias("n"), *ends)
    low, high = np.full((len(dims) + 1, projections), np.inf), np.full((len(dims) + 1, projections), -np.inf)
    buckets = np.zeros(len(dims) + 1, np.int64)
    for r in boxes.collect():  # a row a cell, of which there are sample_rows / 8 at most
        low[r["cell"]], high[r["cell"]] = r[2 : 2 + projections], r[2 + projections :]
        buckets[r["cell"]] = -(-r["n"] // block_rows)
    return ProjectedIndex(held, dim, top, dims, splits, low, high, buckets, projections, block_rows)


def leaves_of(p: np.ndarray, rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kd-tree leaves of projected vectors: (order of the rows, where leaves start and end in it, low, high)."""
    todo, done = [np.arange(len(p))], []
    while todo:
        part = todo.pop()
        if len(part) <= rows:
            done.append(part)
            continue
        own = p[part]
        wide = int(np.argmax(own.max(0) - own.min(0)))
        order = np.argpartition(own[:, wide], len(part) // 2)
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    ends = np.concatenate(([0], np.cumsum([len(d) for d in done])))
    return np.concatenate(done), ends, np.stack([p[d].min(0) for d in done]), np.stack([p[d].max(0) for d in done])


def box_distances(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of projected queries to boxes; infinite for empty boxes."""
    out = np.zeros((len(p), len(low)))
    for j in range(p.shape[1]):
        out += np.maximum(np.maximum(low[:, j] - p[:, j : j + 1], p[:, j : j + 1] - high[:, j]), 0) ** 2
    return out


def search_block(q: np.ndarray, qp: np.ndarray, bound: np.ndarray, x: np.ndarray, p: np.ndarray, top: float, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, rows) of each query's k nearest verified vectors of one block, nearest first; row -1 for none.

    bound: the k-th squared distance that is known from elsewhere (infinite at first). All queries take their
    next nearest leaf at a time; its vectors within the stopping radius are verified; a query ends when the next
    leaf lies beyond the radius of its k-th best so far.
    """
    order, ends, low, high = leaves_of(p)
    x, p = x[order], p[order]
    away = box_distances(qp, low, high)
    turn = np.argsort(away, axis=1, kind="stable")
    away = np.take_along_axis(away, turn, axis=1)
    norms = (q**2).sum(1)
    best, rows = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
    radius = quantile * bound
    active = np.arange(len(q))
    for step in range(len(low)):
        active = active[away[active, step] < radius[active]]
        if not len(active):
            break
        leaf = turn[active, step]
        by = np.argsort(leaf, kind="stable")
        for group in np.split(active[by], np.flatnonzero(np.diff(leaf[by])) + 1):
            a, b = ends[turn[group[0], step]], ends[turn[group[0], step] + 1]
            near = ((qp[group][:, None, :] - p[a:b]) ** 2).sum(2) < radius[group][:, None]
            found = np.where(near, np.maximum(norms[group][:, None] + top - 2 * q[group] @ x[a:b].T, 0), np.inf)
            both = np.concatenate([best[group], found], axis=1)
            ids = np.concatenate([rows[group], np.broadcast_to(np.arange(a, b), found.shape)], axis=1)
            kept = np.argpartition(both, k - 1, axis=1)[:, :k]
            best[group], rows[group] = np.take_along_axis(both, kept, axis=1), np.take_along_axis(ids, kept, axis=1)
        radius[active] = quantile * np.minimum(best[active].max(1), bound[active])
    by = np.argsort(best, axis=1, kind="stable")
    best, rows = np.take_along_axis(best, by, axis=1), np.take_along_axis(rows, by, axis=1)
    return best, np.where(np.isfinite(best), order[rows], -1)


def _hits(qkeys: np.ndarray, q: np.ndarray, best: np.ndarray, rows: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int) -> pd.DataFrame:
    """Found rows as (qkey, id, score, kth): ids of equal vectors spelled out, the k best of each query."""
    at, col = np.nonzero(rows >= 0)
    row = rows[at, col]
    score = np.einsum("ij,ij->i", q[at], x[row])
    n = np.array([len(ids[r]) for r in row.tolist()], np.int64)
    at, score = np.repeat(at, n), np.repeat(score, n)
    own = np.concatenate([np.zeros(0, np.int64), *(ids[r] for r in row.tolist())]).astype(np.int64)
    order = np.lexsort((own, -score, at))
    at, score, own = at[order], score[order], own[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return pd.DataFrame({"qkey": qkeys[at], "id": own, "score": score, "kth": best[at, -1]})[kept]


def _met(asked: DataFrame, index: ProjectedIndex, k: int, confidence: float) -> DataFrame:
    """asked(qkey, vector, bound, cell, bucket) -> (qkey, id, score, kth): each query in the blocks named.

    The queries of a cell come in chunks of QUERY_ROWS, each of which meets every vector of the block.
    """
    asked = written(asked)
    spark, dim, top, projections = asked.sparkSession, index.dim, index.top, index.projections
    chunks = np.ones(len(index.buckets), np.int64)
    for r in asked.groupBy("cell", "bucket").count().groupBy("cell").agg(F.max("count").alias("n")).collect():  # a row a cell
        chunks[r["cell"]] = -(-r["n"] // QUERY_ROWS)
    quantile, dims, splits = chi_square_quantile(confidence, projections), index.dims, index.splits
    kind = index.rows.schema["vector"].dataType.simpleString()

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cell"] = cells_of(_matrix(batch["p"], projections), dims, splits)
            yield batch

    cells = [(int(c), int(b), int(m)) for c, (b, m) in enumerate(zip(index.buckets.tolist(), chunks.tolist())) if b]
    sizes = F.broadcast(spark.createDataFrame(cells, "cell int, buckets int, chunks int"))  # a row a cell
    rows = index.rows.mapInPandas(dealt, f"ids array<bigint>, vector {kind}, p array<double>, cell int").join(sizes, "cell")
    rows = rows.withColumn("bucket", F.expr("cast(pmod(xxhash64(ids[0]), buckets) as int)")).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    queries = asked.join(sizes, "cell").withColumn("chunk", F.expr("cast(pmod(xxhash64(qkey), chunks) as int)"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qkey": [], "id": [], "score": [], "kth": []})
        q, x, p = _matrix(left["vector"], dim), _matrix(right["vector"], dim), _matrix(right["p"], projections)
        best, found = search_block(q, projected(q, None, projections), left["bound"].to_numpy(), x, p, top, k, quantile)
        return _hits(left["qkey"].to_numpy(), q, best, found, x, list(right["ids"]), k)

    by = ["cell", "bucket", "chunk"]
    groups = queries.select("qkey", "vector", "bound", *by).groupBy(*by).cogroup(rows.select("ids", "vector", "p", *by).groupBy(*by))
    return written(groups.applyInPandas(search, "qkey long, id long, score double, kth double"))


def nearest(asked: DataFrame, index: ProjectedIndex, k: int, confidence: float = CONFIDENCE) -> DataFrame:
    """asked(qkey, vector) -> (qkey, id, score): the k best found by inner product of each, in two rounds.

    First each query is searched in the block it would lie in itself. The k-th distance found there tells which
    other cells may hold nearer vectors; the query is sent to these alone, with that distance.
    """
    dim, top, projections = index.dim, index.top, index.projections
    dims, splits, low, high, buckets = index.dims, index.splits, index.low, index.high, index.buckets
    quantile = chi_square_quantile(confidence, projections)
    kind = asked.schema["vector"].dataType.simpleString()
    asked = asked.where(F.size("vector") == dim)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cell"] = cells_of(projected(_matrix(batch["vector"], dim), None, projections), dims, splits)
            yield batch

    at_home = asked.select("qkey", "vector").mapInPandas(home, f"qkey long, vector {kind}, cell int")
    at_home = written(at_home)
    first = _met(at_home.selectExpr("qkey", "vector", "double('infinity') as bound", "cell", "0 as bucket"), index, k, confidence)
    known = written(first.groupBy("qkey").agg(F.min("kth").alias("bound")))
    bounded = at_home.join(known, "qkey", "left").select("qkey", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "cell")

    def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 128):
                part = batch.iloc[start : start + 128]
                away = box_distances(projected(_matrix(part["vector"], dim), None, projections), low, high)
                row, cell = np.nonzero(away < quantile * part["bound"].to_numpy()[:, None])
                n = buckets[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                bucket = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
                other = (cell != part["cell"].to_numpy()[row]) | (bucket != 0)
                yield pd.DataFrame({"at": [np.array(part["qkey"])[row[other]]], "cell": [cell[other]], "bucket": [bucket[other]]})

    # blocks are named beside the queries' keys, and the vectors fetched by key, so that no batch grows by the cells
    visits = bounded.mapInPandas(onward, "at array<bigint>, cell array<int>, bucket array<int>")
    visits = visits.select(F.explode(F.arrays_zip("at", "cell", "bucket")).alias("v")).select(F.col("v.at").alias("qkey"), "v.cell", "v.bucket")
    second = _met(visits.join(bounded.drop("cell"), "qkey").select("qkey", "vector", "bound", "cell", "bucket"), index, k, confidence)
    both = first.drop("kth").unionByName(second.drop("kth"))
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "id")
    # an id with several vectors is a hit once, with its best score
    both = both.groupBy("qkey", "id").agg(F.max("score").alias("score"))
    return both.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def neighbours(
    queries: DataFrame, vectors: DataFrame, k: int = 20, confidence: float = CONFIDENCE, projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """queries(id, vector), vectors(id, vector) -> (query_id, rank, vec_id, score): the k largest inner products found.

    Ranks count from 1; ties go to the smaller id; a row of the query's own id is no candidate; all candidates
    come back where there are fewer than k. Ids that are null, and vectors that are null, empty, zero, of another
    dimension than most, or hold null or non-finite entries, take no part. Repeated rows count once. Of an id with
    several vectors the least one (by its entries in order) asks; all are candidates, and the best counts. Equal
    query vectors are searched once.
    """
    pool, asked = usable(vectors, "id", "vector"), usable(queries, "id", "vector")
    index = build(pool, k, projections, block_rows)
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.where(F.size("vector") == index.dim).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = written(asked.select("id", "vector", *_keys()))
    one = written(asked.groupBy("h1", "h2").agg(F.min("id").alias("qkey")))
    chosen = asked.join(one.select(F.col("qkey").alias("id")), "id").select(F.col("id").alias("qkey"), "vector")
    found = nearest(chosen, index, k + 1, confidence)
    found = found.groupBy("qkey").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")).alias("hits"))  # k + 1 at most
    # written, so that Spark can split the queries of one vector
    members = written(asked.select(F.col("id").alias("query_id"), "h1", "h2").join(one, ["h1", "h2"]).select("query_id", "qkey"))
    met = members.join(written(found), "qkey")
    hits = F.slice(F.array_sort(F.filter("hits", lambda h: h["id"] != F.col("query_id"))), 1, k)
    out = met.select("query_id", F.posexplode(hits).alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), (-F.col("h.s")).alias("score"))
