"""Approximate search: inverted lists, 8-bit scalar quantisation, product quantisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ragspark.functions.vectors import similarity
from ragspark.operators.search import by_blocks, ranked, scores, tiles, top_of
from ragspark.storage import written


def _centroids(vectors: DataFrame, k: int, max_iter: int, rows: int, seed: int) -> np.ndarray:
    """k-means centres of a sample of about `rows` vectors, the first by a hash of their ids."""
    sample = vectors.where("vector is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows)
    data = sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")).persist()
    try:
        model = KMeans(k=k, maxIter=max_iter, seed=seed).fit(data)
    finally:
        data.unpersist()
    return np.stack(model.clusterCenters())


@dataclass
class IvfIndex:
    """Vectors with their list (id, vector, list_id, bucket) and the lists' centroids.

    With a coder the rows hold codes in place of vectors: 8 bits a dimension (Sq8), or product codes of what a
    vector differs from its list's centroid by (Pq). sizes: vectors of each list; a list of many is dealt over
    several buckets.
    """

    centroids: np.ndarray
    rows: DataFrame
    sizes: np.ndarray
    path: str | None = None
    coder: Sq8 | Pq | None = None


def ivf_build(
    vectors: DataFrame, n_lists: int = 256, max_iter: int = 50, sample_rate: int = 256, seed: int = 42, path: str | None = None,
    list_rows: int = 65_536, centroids: np.ndarray | None = None,
) -> IvfIndex:
    """Centroids from n_lists * sample_rate sampled vectors, or given ones; every vector goes to the list of its nearest centroid.

    Each list is dealt over as many buckets as its measured size asks for (list_rows vectors each), so that no
    list is one task's work. With a path the rows are written there, partitioned by list, so that a search reads
    only the lists it probes.
    """
    vectors = vectors.where("vector is not null").select("id", "vector")
    if vectors.isEmpty():  # no lists, and nothing to find
        rows = vectors.select("id", F.col("vector").cast("array<float>"), F.lit(0).alias("list_id"), F.lit(0).alias("bucket"))
        return IvfIndex(np.zeros((0, 0)), rows, np.zeros(0, int), path)
    if centroids is None:
        centroids = _centroids(vectors, n_lists, max_iter, n_lists * sample_rate, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    id_type = vectors.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = scores("L2", np.stack(batch["vector"].to_numpy()).astype(np.float64), shared.value)
                yield batch.assign(list_id=found.argmin(axis=1).astype(np.int32))

    rows = written(vectors.mapInPandas(assign, f"id {id_type}, vector array<float>, list_id int"))
    sizes = np.zeros(len(centroids), int)
    for r in rows.groupBy("list_id").count().collect():  # a row a list
        sizes[r["list_id"]] = r["count"]
    parts = [(n, -(-size // list_rows)) for n, size in enumerate(sizes.tolist()) if size]
    dealt = rows.join(F.broadcast(vectors.sparkSession.createDataFrame(parts, "list_id int, parts int")), "list_id")
    rows = dealt.select(*rows.columns, F.expr("cast(pmod(xxhash64(id), parts) as int)").alias("bucket"))
    return IvfIndex(centroids, _stored(rows, path), sizes, path)


def probe_curve(queries: DataFrame, index: IvfIndex, exact: DataFrame) -> list[tuple[int, float, float]]:
    """(nprobe, recall, scanned) for each number of lists probed: the recall of the exact hits, and the share of rows read.

    exact(qid, id): the true neighbours of queries(qid, vector), from knn_exact of a sample of queries, say. One
    pass finds for each of them how many lists are nearer to the query than its own; nothing is searched.
    """
    centroids, sizes = index.centroids, index.sizes
    dim = centroids.shape[1]
    asked = queries.where(F.col("vector").isNotNull() & (F.size("vector") == dim)).select("qid", "vector")
    where = exact.select("qid", "id").join(index.rows.select("id", "list_id"), "id").join(asked, "qid").select("list_id", "vector")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                away = scores("L2", np.stack(batch["vector"].to_numpy()).astype(float), centroids)
                own = away[np.arange(len(batch)), batch["list_id"].to_numpy()][:, None]
                before = (away < own) | ((away == own) & (np.arange(len(centroids)) < batch["list_id"].to_numpy()[:, None]))
                yield pd.DataFrame({"place": before.sum(axis=1), "n": 1})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                turn = np.argsort(scores("L2", np.stack(batch["vector"].to_numpy()).astype(float), centroids), axis=1, kind="stable")
                yield pd.DataFrame({"place": np.arange(len(centroids)), "n": sizes[turn].sum(axis=0)})

    def totals(df: DataFrame, f: Callable) -> np.ndarray:
        out = np.zeros(len(centroids))
        for r in df.mapInPandas(f, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row a list
            out[r["place"]] = r["n"]
        return np.cumsum(out)

    hits, rows, n = totals(where, place), totals(asked, read), exact.count()
    scanned = rows / max(rows[-1] if len(rows) else 0, 1)
    return [(p + 1, float(hits[p] / max(n, 1)), float(scanned[p])) for p in range(len(centroids))]


def choose_nprobe(curve: list[tuple[int, float, float]], recall: float = 0.9) -> int:
    """The least number of lists whose measured recall is enough; all of them where none is."""
    return next((p for p, found, _ in curve if found >= recall), len(curve))


def _stored(rows: DataFrame, path: str | None) -> DataFrame:
    """rows dealt by list and bucket, written to path by list, or to the shared folder."""
    dealt = rows.repartition("list_id", "bucket").sortWithinPartitions("list_id")
    if not path:
        return written(dealt)
    dealt.write.mode("overwrite").partitionBy("list_id").parquet(path)
    return rows.sparkSession.read.parquet(path)


def ivf_coded(index: IvfIndex, codes: str = "pq", m: int = 8, path: str | None = None) -> IvfIndex:
    """The index with codes in its lists: "sq8" (a byte a dimension), or "pq" (m bytes a vector)."""
    if codes not in ("pq", "sq8"):
        raise ValueError(f"codes {codes}: pq and sq8 are known")
    if codes == "sq8":
        sq = sq8_encode(index.rows)
        return IvfIndex(index.centroids, _stored(sq.codes, path), index.sizes, path, sq)
    shared = index.rows.sparkSession.sparkContext.broadcast(index.centroids)

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                off = np.stack(batch["vector"].to_numpy()) - shared.value[batch["list_id"].to_numpy()]
                yield batch.assign(vector=list(off.astype(np.float32)))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.rows.schema)
    pq = pq_build(index.rows.mapInPandas(residuals, types), m)
    return IvfIndex(index.centroids, _stored(pq.codes, path), index.sizes, path, pq)


def _probed(queries: np.ndarray, centroids: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists, queries): the nprobe lists nearest to each query, ordered by list."""
    lists, asking = [np.zeros(0, int)], [np.zeros(0, int)]
    for part in tiles(len(queries), len(centroids)):
        i, j = top_of(np.arange(len(centroids)), scores("L2", queries[part], centroids), nprobe, "L2")
        lists.append(j)
        asking.append(i + part.start)
    found, by = np.concatenate(lists), np.concatenate(asking)
    order = np.argsort(found, kind="stable")
    return found[order], by[order]


def ivf_search(
    queries: DataFrame, index: IvfIndex, k: int = 10, nprobe: int = 1, metric: str = "L2", rescore: DataFrame | None = None, widen: int = 4, few: bool = False
) -> DataFrame:
    """(qid, rank, id, score): the k best within the nprobe lists nearest to each query.

    Only probed lists are read; the rows of a list meet the queries that probe it as one matrix. Vectors are
    scored exactly, codes as what they stand for, without decoding them. With rescore(id, vector) the best
    widen * k are scored again by the true vectors. few: see by_blocks.
    """
    if rescore is not None:
        return rescored(queries, ivf_search(queries, index, widen * k, nprobe, metric, few=few), rescore, k, metric)
    coder, centroids = index.coder, index.centroids
    similarity(metric, F.lit(None), F.lit(None))
    books = coder.codebooks if isinstance(coder, Pq) else None
    ends = (coder.low, coder.step) if isinstance(coder, Sq8) else None
    dim, held = centroids.shape[1], "vector" if coder is None else "codes"
    types = f"qid {queries.schema['qid'].dataType.simpleString()}, id {index.rows.schema['id'].dataType.simpleString()}, score double"
    asked = queries.where(F.col("vector").isNotNull() & (F.size("vector") == dim)).select("qid", "vector")

    def search(rows: list[Row]) -> DataFrame:
        qids, matrix = np.array([r["qid"] for r in rows]), np.array([r["vector"] for r in rows], float).reshape(len(rows), dim)
        lists, asking = _probed(matrix, centroids, min(nprobe, len(centroids)))
        shared = queries.sparkSession.sparkContext.broadcast((qids, matrix, lists, asking, centroids))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, matrix, lists, asking, centroids = shared.value
            for batch in batches:
                of = batch["list_id"].to_numpy()
                for n in np.unique(of).tolist():
                    own = batch[of == n]
                    ids = own["id"].to_numpy()
                    by = asking[np.searchsorted(lists, n) : np.searchsorted(lists, n, "right")]
                    if held == "vector":
                        x = np.stack(own["vector"].to_numpy()).astype(np.float64)
                    else:
                        x = np.stack([np.frombuffer(b, np.uint8) for b in own["codes"]])
                    for part in tiles(len(by), max(len(ids), 0 if books is None else books.shape[0] * books.shape[1])):
                        if books is not None:
                            found = pq_scores(metric, matrix[by[part]], books, x, centroids[n])
                        else:
                            found = scores(metric, matrix[by[part]], x) if ends is None else sq8_scores(metric, matrix[by[part]], *ends, x)
                        i, j = top_of(ids, found, k, metric)
                        yield pd.DataFrame({"qid": qids[by[part]][i], "id": ids[j], "score": found[i, j]})

        probed = index.rows.where(F.col("list_id").isin(np.unique(lists).tolist()))
        return probed.select("id", held, "list_id").mapInPandas(scan, types)

    return ranked(by_blocks(asked, 8 * dim, search, few), k, metric).select("qid", "rank", "id", "score")


@dataclass
class Sq8:
    """Codes (id, codes: a byte a dimension) with each dimension's least value and step."""

    low: np.ndarray
    step: np.ndarray
    codes: DataFrame


def sq8_encode(vectors: DataFrame) -> Sq8:
    """8 bits a dimension between its minimum and maximum; the error is half a step at most. Other columns stay."""
    vectors = vectors.where("vector is not null")
    ends = vectors.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect()
    low = np.array([r["lo"] for r in ends], float)
    step = np.maximum((np.array([r["hi"] for r in ends], float) - low) / 255, 1e-12)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.rint((np.stack(batch["vector"].to_numpy()) - low) / step).clip(0, 255).astype(np.uint8)
                yield batch.drop(columns="vector").assign(codes=[r.tobytes() for r in x])

    return Sq8(low, step, vectors.mapInPandas(pack, _with_codes(vectors)))


def _with_codes(vectors: DataFrame) -> str:
    """The columns of vectors with `codes` in place of `vector`."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "vector"), "codes binary"])


def sq8_decoded(sq: Sq8) -> DataFrame:
    """(id, vector) as the codes say."""
    rows, low, step = sq.codes, sq.low, sq.step
    id_type = rows.schema["id"].dataType.simpleString()

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = low + np.stack([np.frombuffer(b, np.uint8) for b in batch["codes"]]) * step
                yield pd.DataFrame({"id": batch["id"], "vector": list(x)})

    return rows.mapInPandas(unpack, f"id {id_type}, vector array<double>")


def sq8_scores(metric: str, queries: np.ndarray, low: np.ndarray, step: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """queries x rows, from the bytes themselves: a product with the queries scaled by the steps, and terms a query and a row.

    A code c stands for low + step c, so that q.x = q.low + (q step).c and |x|^2 = |low|^2 + (2 low step).c + (step^2).c^2.
    """
    c = codes.astype(np.float64)
    inner = (queries @ low)[:, None] + (queries * step) @ c.T
    if metric == "IP":
        return inner
    norms = low @ low + c @ (2 * low * step) + (c * c) @ (step * step)
    if metric == "L2":
        return np.maximum((queries**2).sum(1)[:, None] - 2 * inner + norms, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return inner / (np.linalg.norm(queries, axis=1)[:, None] * np.sqrt(np.maximum(norms, 0)))


def _scanned(queries: DataFrame, codes: DataFrame, dim: int, k: int, metric: str, cost: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(qid, rank, id, score) of a scan over codes(id, codes); score: (query matrix, codes as bytes) -> queries x rows."""
    similarity(metric, F.lit(None), F.lit(None))
    types = f"qid {queries.schema['qid'].dataType.simpleString()}, id {codes.schema['id'].dataType.simpleString()}, score double"
    asked = queries.where(F.size("vector") == dim).select("qid", "vector")

    def search(rows: list[Row]) -> DataFrame:
        qids, matrix = np.array([r["qid"] for r in rows]), np.array([r["vector"] for r in rows], float).reshape(len(rows), dim)
        shared = queries.sparkSession.sparkContext.broadcast((qids, matrix))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, matrix = shared.value
            for batch in batches:
                if len(batch):
                    ids, x = batch["id"].to_numpy(), np.stack([np.frombuffer(b, np.uint8) for b in batch["codes"]])
                    for part in tiles(len(qids), max(len(ids), cost)):
                        found = score(matrix[part], x)
                        i, j = top_of(ids, found, k, metric)
                        yield pd.DataFrame({"qid": qids[part][i], "id": ids[j], "score": found[i, j]})

        return codes.select("id", "codes").mapInPandas(scan, types)

    return ranked(by_blocks(asked, 8 * dim, search), k, metric).select("qid", "rank", "id", "score")


def sq8_search(queries: DataFrame, sq: Sq8, k: int = 10, rescore: DataFrame | None = None, metric: str = "L2", widen: int = 4) -> DataFrame:
    """Search over the codes; with rescore(id, vector) the best widen * k are scored again by the true vectors."""
    low, step = sq.low, sq.step
    hits = _scanned(queries, sq.codes, len(low), k if rescore is None else widen * k, metric, 0, lambda q, c: sq8_scores(metric, q, low, step, c))
    return hits if rescore is None else rescored(queries, hits, rescore, k, metric)


def rescored(queries: DataFrame, hits: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    pairs = hits.select("qid", "id").join(vectors.select("id", "vector"), "id").join(queries.select("qid", F.col("vector").alias("q")), "qid")
    return ranked(pairs.select("qid", "id", similarity(metric, "q", "vector").alias("score")), k, metric).select("qid", "rank", "id", "score")


@dataclass
class Pq:
    """Product quantiser: codebooks (m x entries x dim / m) and codes (id, codes: a byte a sub-vector)."""

    codebooks: np.ndarray
    codes: DataFrame

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.codebooks)], axis=1)


def pq_build(
    vectors: DataFrame, m: int, bits: int = 8, sample_rows: int = 65_536, seed: int = 42, max_iter: int = 24, books: np.ndarray | None = None
) -> Pq:
    """m codebooks of 2^bits entries, trained on a sample's sub-vectors, or given ones; a code a vector.

    All codebooks are trained at once: each pass over the sample (sample_rows vectors, the first by a hash of
    their ids) adds up counts, sums and squared deviations of every entry on the executors; the driver holds
    codebooks only. An empty table gives an index without codes, which finds nothing. Other columns stay beside
    the codes.
    """
    vectors = vectors.where("vector is not null")
    first = vectors.select(F.size("vector").alias("d")).first()
    if first is None:
        return Pq(np.zeros((m, 2**bits, 0)), vectors.drop("vector").withColumn("codes", F.lit(b"")))
    if first["d"] % m or bits > 8:
        raise ValueError("m must divide the dimension, and codes have 8 bits at most")
    if books is None:
        sample = vectors.select("id", "vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
        books = _codebooks(written(sample.select("vector").repartition(_PARTS)), first["d"], m, 2**bits, max_iter)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                parts = np.split(np.stack(batch["vector"].to_numpy()).astype(float), m, axis=1)
                codes = np.stack([scores("L2", p, b).argmin(axis=1) for p, b in zip(parts, books)], axis=1).astype(np.uint8)
                yield batch.drop(columns="vector").assign(codes=[r.tobytes() for r in codes])

    return Pq(books, vectors.mapInPandas(pack, _with_codes(vectors)))


#: parts of a sample that codebooks are trained on
_PARTS = 16


def _entry_sums(sample: DataFrame, books: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums, squared deviations by dimension) of the sub-vectors nearest to each used entry of each codebook."""
    m, entries, width = books.shape
    shape = (m, entries, 1 + 2 * width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                for i, part in enumerate(np.split(np.stack(batch["vector"].to_numpy()).astype(float), m, axis=1)):
                    near = np.where(used[i], scores("L2", part, books[i]), np.inf).argmin(axis=1)
                    off = (part - books[i][near]) ** 2
                    total[i, :, 0] += np.bincount(near, minlength=entries)
                    for d in range(width):
                        total[i, :, 1 + d] += np.bincount(near, part[:, d], entries)
                        total[i, :, 1 + width + d] += np.bincount(near, off[:, d], entries)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = sample.mapInPandas(run, "sums binary").collect()  # a row a task, of which there are _PARTS at most
    total = np.sum([np.zeros(shape), *sorted((np.frombuffer(r["sums"]).reshape(shape) for r in parts), key=lambda x: x.tobytes())], axis=0)
    return total[:, :, 0], total[:, :, 1 : 1 + width], total[:, :, 1 + width :]


def _codebooks(sample: DataFrame, dim: int, m: int, entries: int, max_iter: int) -> np.ndarray:
    """m x entries x dim / m: k-means by splitting, as many passes as it takes to fill the books and max_iter at least.

    A book starts as one entry. Each pass moves the entries to their means; then those with the largest squared
    error are split along their widest dimension into entries that are free. Where a book has no more distinct
    sub-vectors than entries, each becomes one.
    """
    width = dim // m
    books, used = np.zeros((m, entries, width)), np.zeros((m, entries), bool)
    used[:, 0] = True
    for step in range(max_iter + 4 * entries.bit_length()):
        n, sums, squares = _entry_sums(sample, books, used)
        mean = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], books)
        error = np.maximum(squares - n[:, :, None] * (mean - books) ** 2, 0) * (n > 0)[:, :, None]
        moved = bool((np.abs(mean - books) > 1e-9 * np.abs(mean).max(initial=1e-300)).any())
        least = 1e-12 * (1e-300 + np.maximum(error, n[:, :, None] * mean**2).sum(axis=(1, 2)))
        books, used, split = mean, n > 0, False
        for i in range(m):
            free, able = np.flatnonzero(~used[i]), np.flatnonzero(error[i].sum(axis=1) > least[i])
            for e, to in zip(able[np.argsort(-error[i].sum(axis=1)[able], kind="stable")].tolist(), free.tolist()):
                wide = int(error[i, e].argmax())
                half = np.sqrt(error[i, e, wide] / n[i, e]) / 2
                books[i, to] = books[i, e]
                books[i, e, wide] -= half
                books[i, to, wide] += half
                used[i, to] = split = True
        if not split and (not moved or step + 1 >= max_iter):
            break
    # an entry that is still free repeats the first one, which comes before it in every search
    return np.where(used[:, :, None], books, books[:, :1])


def pq_scores(metric: str, queries: np.ndarray, books: np.ndarray, codes: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """queries x rows by table look-up: each sub-vector of a query meets all entries once; a row's codes pick the terms.

    base: what codes are residuals of (a list's centroid). Inner products then add the query's with it; norms add
    its own and twice its products with the entries.
    """
    width = books.shape[2]
    if metric == "L2":
        moved = queries if base is None else queries - base
        return _by_table([scores("L2", moved[:, i * width : (i + 1) * width], b) for i, b in enumerate(books)], codes)
    inner = _by_table([queries[:, i * width : (i + 1) * width] @ b.T for i, b in enumerate(books)], codes)
    inner = inner if base is None else inner + (queries @ base)[:, None]
    if metric == "IP":
        return inner
    own = (books**2).sum(axis=2) if base is None else (books**2).sum(axis=2) + 2 * np.einsum("iew,iw->ie", books, base.reshape(len(books), width))
    norms = sum(own[i, codes[:, i]] for i in range(len(books))) + (0.0 if base is None else base @ base)
    with np.errstate(divide="ignore", invalid="ignore"):
        return inner / (np.linalg.norm(queries, axis=1)[:, None] * np.sqrt(np.maximum(norms, 0)))


def _by_table(tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """queries x rows: the terms of the tables (queries x entries, one a sub-vector), summed by code."""
    return sum(table[:, codes[:, i]] for i, table in enumerate(tables))


def pq_search(queries: DataFrame, pq: Pq, k: int = 10, rescore: DataFrame | None = None, widen: int = 4, metric: str = "L2") -> DataFrame:
    """Search by table look-up over product codes; with rescore(id, vector) the best widen * k are scored again by the true vectors."""
    if rescore is not None:
        return rescored(queries, pq_search(queries, pq, widen * k, metric=metric), rescore, k, metric)
    books = pq.codebooks
    return _scanned(queries, pq.codes, books.shape[0] * books.shape[2], k, metric, books.shape[0] * books.shape[1], lambda q, c: pq_scores(metric, q, books, c))
