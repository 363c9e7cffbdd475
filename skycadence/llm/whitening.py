"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Spark sums the vectors, then the products of the centred vectors, one row of partial sums per task. What reaches the driver
is one matrix of the size dimension x dimension, whatever the number of vectors; there it is factored as L L' and the columns
of L are rotated until they are orthogonal: their norms squared are the eigenvalues, the columns themselves the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm.shared import documents, written

SCALE, SHIFT, KEEP = 1024, 100_000, 8
LARGEST = float(1 << 40)  # of an entry, so that its whole number is exact
NEGLIGIBLE = 1e-13        # of the trace: components below it are rounding
GROUP = 1 << 22           # entries of vectors that are multiplied at once


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that count, as whole numbers; only vec_id and embedding are read."""
    doubles = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda e: F.coalesce(F.abs(e) <= LARGEST, F.lit(False)))  # NULL, NaN and infinities fail
    rows = rows.select("vec_id", doubles.alias("v")).where(F.col("v").isNotNull() & fine)
    return rows.select("vec_id", F.transform("v", lambda e: F.floor(e * SCALE).cast("long") + SHIFT).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        step = max(1, GROUP // max(dims, 1))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(x: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each entry."""
    def partial(batches):
        n, total = 0, [0] * dims
        for _, m in _matrices(batches, 0, dims):
            n += len(m)
            total = [a + b for a, b in zip(total, _exact_column_sums(m))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int64()), pa.array([str(v) for v in (n, *total)])], ["i", "s"])
    sums = x.select("x").mapInArrow(partial, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in sums.collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(dims)]


def _exact_column_sums(m: np.ndarray) -> list[int]:
    high, low = m >> 24, m & 0xFFFFFF  # neither half can pass 64 bits in one group
    return [(int(a) << 24) + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0))]


def _scatter(x: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sum of the products of the centred vectors; each task sends its lower triangle once."""
    dims = len(centre)
    rows, cols = np.tril_indices(dims)

    def partial(batches):
        total = np.zeros((dims, dims))
        for _, m in _matrices(batches, 0, dims):
            z = m - centre
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(total[rows, cols])], ["i", "s"])
    out = np.zeros((dims, dims))
    for r in x.select("x").mapInArrow(partial, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[rows[r["i"]], cols[r["i"]]] = out[cols[r["i"]], rows[r["i"]]] = r["s"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L @ L.T = a for a positive semidefinite matrix; columns by falling pivot, as many as the rank.

    Rows are not permuted back and forth: with pivot order p, L[p] is lower triangular."""
    d = len(a)
    left = np.diag(a).copy()
    factor = np.zeros((d, d))
    limit = NEGLIGIBLE * max(float(np.trace(a)), 0.0)
    free = np.ones(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(free, left, -np.inf)))
        if not left[p] > limit / d:
            return factor[:, :k]
        free[p] = False
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        column[~free] = 0.0
        column[p] = np.sqrt(left[p])
        factor[:, k] = column
        left -= column * column
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate the columns until every two are orthogonal to double precision.

    A sweep meets all pairs in rounds of disjoint ones (as in a tournament), so a round is a few array operations."""
    g = factor.copy()
    r = g.shape[1]
    seats = r + r % 2
    for _ in range(sweeps):
        order, worst = list(range(seats)), 0.0
        for _ in range(seats - 1):
            pairs = [(p, q) for p, q in zip(order[:seats // 2], reversed(order[seats // 2:])) if max(p, q) < r]
            order = [order[0], order[-1], *order[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            a, b = (g[:, p] ** 2).sum(axis=0), (g[:, q] ** 2).sum(axis=0)
            c = (g[:, p] * g[:, q]).sum(axis=0)
            turn = np.abs(c) > 1e-15 * np.sqrt(a * b)
            worst = max(worst, float(np.max(np.abs(c[turn]) / np.sqrt(a[turn] * b[turn]), initial=0.0)))
            zeta = (b - a) / np.where(turn, 2 * c, 1)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            left, right = g[:, p], g[:, q]
            g[:, p], g[:, q] = cos * left - cos * t * right, cos * t * left + cos * right
        if worst <= 1e-14:
            break
    return g


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter matrix, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    trace = float(np.trace(scatter))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(scatter), 0))
    g = one_sided_jacobi(pivoted_cholesky(scatter))
    e = (g * g).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > NEGLIGIBLE * trace]
    v = g[:, order] / np.sqrt(e[order])
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return e[order], v


def _projected(x: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): exact squared distance from the mean times n * n, and the whitened entries."""
    dims = len(sums)
    mean = np.array([s / n for s in sums])

    def project(batches):
        total = None
        for part, m in _matrices(batches, 1, dims):
            w = (m - mean) @ axes
            reach = np.abs(m - mean).max(axis=1, initial=0.0) * n
            total = [None] * len(m)
            fits = reach * reach * dims < 9e18
            if fits.any():
                gap = n * m[fits] - np.array([int(s) for s in sums], np.int64)
                for k, v in zip(np.flatnonzero(fits), (gap * gap).sum(axis=1).tolist()):
                    total[k] = v
            for k in np.flatnonzero(~fits & (reach * reach < 9.3e18)):  # beyond, one square alone passes 64 bits
                exact = sum((n * int(v) - s) ** 2 for v, s in zip(m[k], sums))
                total[k] = exact if exact < 1 << 63 else None
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * w.shape[1], pa.int32()), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), lists], ["vec_id", "deviation", "w"])
    kind = x.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>")


def whiten(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are NULL, empty or hold a NULL, NaN or infinite entry are left out, and so are those with an entry beyond
    2 ** 40, whose whole number would not be exact. All others must have one length: of several lengths the most frequent
    counts (of equally frequent ones the smallest) and the others are left out. Components whose variance is zero have no
    whitened value and are left out: copies of one vector, a single vector or an empty table give no rows. Repeated rows
    and ids stay separate rows, a NULL id is kept, other columns are not read. A deviation beyond 64 bits is NULL.

    The driver holds a matrix of dimension x dimension; each task sends one of that size. The whitened entries are written
    once, and their covariance is taken from what was written.
    """
    x = whole_vectors(rows)
    lengths = x.groupBy(F.size("x").alias("dims")).count().where("dims > 0")
    chosen = lengths.orderBy(F.desc("count"), "dims").first()
    schema = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if chosen is None:
        return rows.sparkSession.createDataFrame([], schema)
    x = x.where(F.size("x") == chosen["dims"])
    n, sums = _sums(x, chosen["dims"])
    scatter = _scatter(x, np.array([s / n for s in sums]))
    e, v = principal(scatter)
    e, v = e[:keep], v[:, :keep]
    if not len(e):
        return rows.sparkSession.createDataFrame([], schema)
    white = written(_projected(x, n, sums, v / np.sqrt(e / n)), "whitened")
    w = [F.col("w")[k] for k in range(len(e))]
    gaps = [F.abs(F.covar_pop(w[i], w[j]) - (1.0 if i == j else 0.0)) for i in range(len(e)) for j in range(i + 1)]
    error = white.agg(F.array_max(F.array(*gaps)).alias("identity_error")).first()["identity_error"]
    share = F.array(*[F.lit(float(s)) for s in e / np.trace(scatter)])
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(documents(spark, sf_dir, "embeddings"))
