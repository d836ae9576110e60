"""Whitening of embeddings: eigenvectors of the covariance by Jacobi-Davidson over distributed products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import unused, written

#: an entry c counts as floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: steps of an inner solve; width of the search space, in wanted components, at which it is restarted
INNER_STEPS = 4
SEARCH_WIDTH = 8
#: a residual is at double precision below so many times the largest eigenvalue's rounding
PRECISION = 64 * np.finfo(float).eps
#: entries of this size or more have no exact place in the sums
LARGEST = 2.0**32
_BLOCK_BYTES = 4096
#: rows of sums of one task that are added to each other before the driver sees them
_GROUPS = 16
_SEED = 13


def integer_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """rows with `x`, the vector's entries as floor(1024 c) + 100000, for vectors that hold finite numbers only.

    Null and empty vectors, vectors with entries that are null, not finite, or LARGEST or more in size, and those
    of another dimension than most rows (of several: the largest) are left out.
    """
    name, v = unused(rows, "x"), F.col(vector_col)
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(LARGEST)))
    left = rows.where(v.isNotNull() & (F.size(v) > 0) & good)
    size = left.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    left = left.where(F.size(v) == (size["d"] if size else 0))
    return left.withColumn(name, F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def _entries(column: pa.Array) -> np.ndarray:
    """rows x dimensions of an array<long> column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


@dataclass
class Centred:
    """Vectors less `base`, the rounded mean, packed as whole numbers of one type; offset: mean less base."""

    rows: DataFrame
    kind: str
    n: int
    sums: list[int]
    base: np.ndarray
    offset: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)


def centred(vectors: DataFrame) -> Centred | None:
    """vectors(x) -> their exact sums, and their packed rows in the shared folder; None without rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch's sums fit a long: its rows are Arrow's, its entries below 2^43
            x = _entries(batch.column(0))
            if len(x):
                parts = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (x.sum(0), x.min(0), x.max(0))]
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), *parts], ["n", "s", "lo", "hi"])

    found = vectors.select("x").mapInArrow(sums, "n long, s array<bigint>, lo array<bigint>, hi array<bigint>")
    each = found.select("n", F.posexplode(F.arrays_zip("s", "lo", "hi")).alias("d", "v"))
    each = each.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("v.s").cast("decimal(38,0)")).alias("s"), F.min("v.lo").alias("lo"), F.max("v.hi").alias("hi"))
    ends = each.orderBy("d").collect()  # a row a dimension
    if not ends:
        return None
    n, total = ends[0]["n"], [int(r["s"]) for r in ends]
    mean = [(2 * s + n) // (2 * n) for s in total]
    base, offset = np.array(mean, np.int64), np.array([(s - n * m) / n for s, m in zip(total, mean)])
    most = max(max(r["hi"] - m, m - r["lo"]) for r, m in zip(ends, mean))
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 2**bits)
    per_block = max(1, _BLOCK_BYTES // (len(total) * int(kind[-1])))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_entries(batch.column(0)) - base).astype(kind) if batch.num_rows else np.zeros((0, len(base)), kind)
            blocks = [x[i : i + per_block].tobytes() for i in range(0, len(x), per_block)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])

    return Centred(written(vectors.select("x").mapInArrow(pack, "block binary")), kind, n, total, base, offset)


def summed(data: Centred, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of of(centred rows), a matrix of `shape`.

    A task adds up its rows, a second step some tasks' sums; the driver adds _GROUPS matrices, in order.
    """
    kind, dim, offset = data.kind, data.dim, data.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, part = np.zeros(shape), TaskContext.get().partitionId()
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(-1, dim)
            for at in range(0, len(whole), 8192):
                total += of(whole[at : at + 8192].astype(np.float64) - offset)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([part % _GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "g", "m"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        mats = [np.frombuffer(m).reshape(shape) for m in group.sort_values("part")["m"]]
        return pd.DataFrame({"g": [group["g"].iloc[0]], "m": [np.sum(mats, axis=0).tobytes()]})

    parts = data.rows.mapInArrow(run, "part int, g int, m binary").groupBy("g").applyInPandas(fold, "g int, m binary")
    return np.sum([np.zeros(shape), *(np.frombuffer(r["m"]).reshape(shape) for r in sorted(parts.collect(), key=lambda r: r["g"]))], axis=0)


def product(data: Centred) -> Callable[[np.ndarray], np.ndarray]:
    """w -> covariance times w, without the covariance: one pass over the rows for all columns of w."""
    return lambda w: summed(data, lambda y: y.T @ (y @ w), w.shape) / data.n


def _orthonormal(new: np.ndarray, *old: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to the orthonormal columns of old."""
    basis = np.concatenate([b for b in old], axis=1) if old else np.zeros((len(new), 0))
    kept = []
    for v in new.T:
        before = size = np.linalg.norm(v)
        for _ in range(3):
            for q in (basis, np.array(kept).T.reshape(len(v), -1)):
                v = v - q @ (q.T @ v)
        size = np.linalg.norm(v)
        if before > 0 and size > 1e-10 * before:
            kept.append(v / size)
    return np.array(kept).T.reshape(len(new), -1)


def minres(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, enough: float = 0.05) -> np.ndarray:
    """Approximate solutions of symmetric (maybe indefinite) systems, one a column of b, all a step at a time.

    times applies each column's own operator to all columns at once. Least residuals over Krylov spaces from a
    Lanczos three-term recurrence with Givens rotations; it ends early where all residuals fell to `enough`.
    """
    beta = np.linalg.norm(b, axis=0)
    safe = lambda x: np.where(np.abs(x) > 0, x, 1.0)
    first, x = beta.copy(), np.zeros_like(b)
    v_old, v = np.zeros_like(b), b / safe(beta)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    c, s, c_old, s_old, eta, below = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta), beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        y = times(v) - below * v_old
        alpha = (v * y).sum(0)
        y = y - alpha * v
        after = np.linalg.norm(y, axis=0)
        # two earlier rotations, then the one that clears the entry below
        r3, r2, r1 = s_old * below, c * c_old * below + s * alpha, c * alpha - s * c_old * below
        size = np.hypot(r1, after)
        c_old, s_old = c, s
        live = size > 1e-14 * safe(first)
        c, s = np.where(live, r1 / safe(size), 1.0), np.where(live, after / safe(size), 0.0)
        w_old, w = w, np.where(live, (v - r3 * w_old - r2 * w) / safe(size), 0.0)
        x = x + c * eta * w * live
        eta = -s * eta
        v_old, v, below = v, np.where(after > 1e-14 * safe(first), y / safe(after), 0.0), after
        if (np.abs(eta) <= enough * first).all():
            break
    return x


def leading_eigenpairs(
    times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, inner_steps: int = INNER_STEPS, precision: float = PRECISION, most_rounds: int = 200
) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric matrix that is known by its products alone.

    Jacobi-Davidson: Rayleigh-Ritz over a search space; for each wanted pair that isn't there yet, the correction
    equation (I - QQ')(A - theta I)(I - QQ') t = -r by a few MINRES steps, Q being what is locked and all current
    Ritz vectors; the solutions widen the space. Leading pairs whose residual is at double precision are locked
    and deflated. The space is cut back to the best Ritz vectors when it is SEARCH_WIDTH * wanted wide.
    """
    wanted = min(wanted, dim)
    if not wanted:
        return np.zeros(0), np.zeros((dim, 0))
    space = _orthonormal(np.random.default_rng(_SEED).standard_normal((dim, min(dim, wanted + 4))))
    image = times(space)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    for _ in range(most_rounds):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        left = min(wanted - len(values), space.shape[1])
        ritz, residual = space @ s[:, :left], image @ s[:, :left] - (space @ s[:, :left]) * theta[:left]
        residual -= locked @ (locked.T @ residual)
        scale = max(theta[0], values[0] if len(values) else 0.0, np.finfo(float).tiny)
        done = np.linalg.norm(residual, axis=0) <= precision * scale
        ready = left if done.all() else int(np.argmin(done))
        if ready:
            locked, values = np.concatenate([locked, ritz[:, :ready]], axis=1), np.concatenate([values, theta[:ready]])
            space, image = space @ s[:, ready:], image @ s[:, ready:]
            ritz, residual, theta = ritz[:, ready:], residual[:, ready:], theta[ready:]
            if len(values) == wanted:
                break
        if space.shape[1] + len(values) >= dim:  # the space is everything: only rounding is left in the residuals
            rest = wanted - len(values)
            locked, values = np.concatenate([locked, space[:, :rest] if ready else space @ s[:, :rest]], axis=1), np.concatenate([values, theta[:rest]])
            break
        if space.shape[1] > SEARCH_WIDTH * wanted:
            kept = space.T @ image
            turn = np.linalg.eigh((kept + kept.T) / 2)[1][:, ::-1][:, : 2 * wanted]
            space, image = space @ turn, image @ turn
        q = np.concatenate([locked, ritz], axis=1)
        across = lambda t: t - q @ (q.T @ t)  # noqa: E731, B023
        shift = theta[: ritz.shape[1]]
        t = minres(lambda v: across(times(across(v)) - across(v) * shift), -across(residual), inner_steps)  # noqa: B023
        wider = _orthonormal(np.concatenate([t, residual], axis=1)[:, : t.shape[1]], locked, space)
        if not wider.shape[1]:
            wider = _orthonormal(np.random.default_rng(_SEED + len(values)).standard_normal((dim, 2)), locked, space)
        space, image = np.concatenate([space, wider], axis=1), np.concatenate([image, times(wider)], axis=1)
    else:
        raise ArithmeticError(f"{len(values)} of {wanted} pairs reached double precision in {most_rounds} rounds")
    order = np.argsort(-values, kind="stable")
    vectors = locked[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * np.where(signs == 0, 1.0, signs)


@dataclass
class Whitener:
    """Mean (as exact sums over n), eigenvalues and unit eigenvectors (columns), and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """vectors(x) -> the whitening of their covariance (divisor n); None without rows.

    Components whose eigenvalue is zero up to rounding have no whitened value and are left out.
    """
    data = centred(vectors)
    if data is None:
        return None
    trace = float(summed(data, lambda y: np.array([[np.square(y).sum()]]), (1, 1))[0, 0] / data.n)
    if trace <= 0:
        return Whitener(data.n, data.sums, np.zeros(0), np.zeros((data.dim, 0)), 0.0, 0.0)
    values, basis = leading_eigenpairs(product(data), data.dim, components)
    real = values > data.dim * np.finfo(float).eps * trace
    values, basis = values[real], basis[:, real]
    k, scale = len(values), np.sqrt(values)

    def moments(y: np.ndarray) -> np.ndarray:
        z = np.concatenate([y @ basis / scale, np.ones((len(y), 1))], axis=1)
        return z.T @ z

    m = summed(data, moments, (k + 1, k + 1)) / data.n
    error = float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max()) if k else 0.0
    return Whitener(data.n, data.sums, values, basis, trace, error)


def whitened(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Usable rows are those of integer_vectors; null ids and repeated rows are kept and count each time. deviation:
    the exact sum over dimensions of (n x - S)^2, as decimal(38,0). Ids keep their type. Equal eigenvalues have
    any orthonormal basis of their space. An empty table, or one whose vectors are all equal, gives no rows.
    """
    usable = integer_vectors(rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), "v").select("vec_id", "x")
    fitted = fit(usable, components)
    kind = usable.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, k = fitted.n, fitted.sums, len(fitted.values)
    base = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    off = [s - n * int(b) for s, b in zip(sums, base)]  # n x - S = n (x - base) - off, |off| <= n / 2
    small, away = np.array(off, np.float64) / n, np.array(off, object)
    turn, explained, error = fitted.vectors / np.sqrt(fitted.values), fitted.values / fitted.trace, fitted.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _entries(batch.column(1)) - base
            most = n * (int(np.abs(y).max()) + 1)
            if len(base) * most**2 < 2**63:
                spread = np.square(n * y - away.astype(np.int64)).sum(1).astype(object)
            else:
                spread = np.square(n * y.astype(object) - away).sum(1)
            z = ((y - small) @ turn).ravel()
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array([int(s) for s in spread for _ in range(k)], pa.decimal128(38, 0)),
                pa.array(z), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names)

    return usable.mapInArrow(run, schema)
