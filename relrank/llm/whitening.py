"""Whitening of embeddings along the eigenvectors of their covariance, by spectral divide and conquer.

The covariance is added up where the vectors are; only numbers per pair of dimensions reach the driver. There the
symmetric matrix is split as Nakatsukasa and Higham (2013) do: the polar factor of the shifted matrix, by QDWH
iterations, is the matrix sign function, whose projectors span the eigenvectors on either side of the shift. Both sides
are compressed and split in turn, down to single components. The components then go out with the tasks, and every
vector is whitened where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.session import materialize

COMPONENTS = 16
SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 40)  # entries of this size or more are no fixed-point numbers here: treated as not finite
EPS = np.finfo(float).eps


# Eigenvectors of a symmetric matrix ---------------------------------------------------------------------------------


def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH: by QR where it is far from orthogonal, then by
    Cholesky. An eigenvalue next to zero comes out on some side or between; the caller checks."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low, eye = EPS / 4, np.eye(n)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2) if square < 1 else 0.0
        root = np.sqrt(1 + d)
        f = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        g = (f - 1) ** 2 / 4
        h = f + g - 1
        if h > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(h) * x, eye]))[0]
            new = g / h * x + (f - g / h) / np.sqrt(h) * (q[:n] @ q[n:].T)
        else:
            factor = np.linalg.cholesky(eye + h * (x.T @ x))
            half = np.linalg.solve(factor, x.T)
            new = g / h * x + (f - g / h) * np.linalg.solve(factor.T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (f + g * square) / (1 + h * square))
        moved, x = np.linalg.norm(new - x), new
        if moved <= np.cbrt(EPS) * 1e-1 and 1 - low < 1e-9:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Bases of the eigenvectors above and below the shift, and how much the two sides still mix."""
    n = len(a)
    projector = (polar_sign(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n:
        return None
    # Two steps of subspace iteration from the projector's largest columns.
    start = projector[:, np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")]
    basis = np.linalg.qr(start)[0][:, :rank]
    for _ in range(2):
        basis = np.linalg.qr(projector @ basis)[0]
    whole = np.linalg.qr(basis, mode="complete")[0]
    upper, lower = whole[:, :rank], whole[:, rank:]
    return upper, lower, float(np.linalg.norm(lower.T @ a @ upper))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit eigenvectors (columns) of a symmetric matrix.

    Shifts are taken in the middle of the diagonal; one that lies on an eigenvalue splits badly and is moved. A block
    that is a multiple of the identity up to rounding is not split: any of its bases will do.
    """
    size = max(float(np.linalg.norm(a)), np.finfo(float).tiny)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    todo = [((a + a.T) / 2, np.eye(len(a)))]
    while todo:
        block, basis = todo.pop()
        n = len(block)
        middle = float(np.trace(block)) / n if n else 0.0
        if n <= 1 or np.linalg.norm(block - middle * np.eye(n)) <= 4 * EPS * size:
            values += list(np.diagonal(block))
            vectors += list(basis.T)
            continue
        spread = np.linalg.norm(block - middle * np.eye(n)) / np.sqrt(n)
        best = None
        # The mean is always between the extremes. Others are tried while the two sides mix more than rounding does.
        for shift in (float(np.median(np.diagonal(block))), middle, *(middle + spread * x for x in (0.31, -0.27, 0.73, -0.61, 0.13, -0.09))):
            found = _split(block, shift)
            if found and (best is None or found[2] < best[2]):
                best = found
            if best and best[2] <= 8 * EPS * n * size:
                break
        if best is None:  # no shift parts it: equal but for rounding
            values += list(np.diagonal(block))
            vectors += list(basis.T)
            continue
        for side in best[:2]:
            part = side.T @ block @ side
            todo.append(((part + part.T) / 2, basis @ side))
    order = np.argsort(-np.array(values), kind="stable")
    columns = np.stack(vectors, 1)[:, order] if vectors else np.zeros((0, 0))
    # One joint clean-up: orthonormal again, and values as the vectors have them.
    columns = np.linalg.qr(columns)[0] if len(columns) else columns
    found = np.einsum("ij,ik,kj->j", columns, a, columns) if len(columns) else np.zeros(0)
    order = np.argsort(-found, kind="stable")
    return found[order], columns[:, order]


# Sums over tables ---------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _vector_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: rows and exact sums, one row per dimension. Sums of a batch fit 64 bits; the total is a Python int."""
    count, total = 0, None
    for batch in batches:
        x = _matrix(batch.column("x"))
        if len(x):
            count += len(x)
            low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
            sums = high.astype(object) * (1 << 32) + low.astype(object)
            total = sums if total is None else total + sums
    if total is not None:
        yield pa.record_batch({
            "i": pa.array(range(len(total)), pa.int32()), "n": pa.array([count] * len(total), pa.int64()),
            "total": pa.array([str(t) for t in total], pa.string()),
        })


def fit_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension: one row per dimension comes to the driver."""
    parts = fit.select("x").mapInArrow(_vector_sums, "i int, n long, total string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = sorted(rows.collect(), key=lambda r: r["i"])
    return (int(found[0]["n"]) if found else 0), [int(r["total"]) for r in found]


def covariance(rows: DataFrame, centred: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Of the vectors that `centred` makes of the x column: products summed per task, then per pair of dimensions."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                y = centred(x)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            for i, row in enumerate(total):
                yield pa.record_batch({
                    "i": pa.array(np.full(len(row), i, np.int32)), "j": pa.array(np.arange(len(row), dtype=np.int32)),
                    "v": pa.array(row),
                })

    parts = rows.select("x").mapInArrow(products, "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # dimensions squared
    size = max((r["i"] for r in found), default=-1) + 1
    out = np.zeros((size, size))
    for r in found:
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


# Whitening ----------------------------------------------------------------------------------------------------------


def fixed_point(vector: Column) -> Column:
    """Entries as long floor(64 * c) + 1000000; null where the vector is null or empty or has an entry that is null,
    not finite, or of 2 ** 40 or more."""
    c = vector.cast("array<double>")
    fine = F.forall(c, lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False)) & ~F.isnan(v)) & (F.size(c) > 0)
    return F.when(fine, F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + F.lit(SHIFT).cast("long")))


class Whitening:
    """Fitted on each distinct vector once: `n`, exact sums, and up to `components` axes with their eigenvalues.

    An axis whose eigenvalue is zero but for rounding has no whitened value; `identity_error` leaves it out.
    """

    def __init__(self, fit: DataFrame, components: int = COMPONENTS) -> None:
        self.n, self.sums = fit_sums(fit)
        self.axes, self.values, self.identity_error, trace = np.zeros((0, 0)), np.zeros(0), 0.0, 0.0
        if self.n:
            mean = self._mean()
            spread = covariance(fit, lambda x: x - mean, self.n)
            values, vectors = eigen(spread)
            trace = float(np.trace(spread))
            self.values, self.axes = values[:components], vectors[:, :components]
        self.explained = self.values / trace if trace > 0 else np.zeros(len(self.values))
        whole = self.values > (len(self.sums) * EPS * self.values[0] if self.n else 0.0)
        self.scaled = np.where(whole, self.axes / np.sqrt(np.where(whole, self.values, 1.0)), np.nan)
        if whole.any():
            mean, scaled = self._mean(), self.scaled[:, whole]
            # Whitened values are centred again before they are multiplied.
            off = self._whitened_mean(fit, mean, scaled)
            again = covariance(fit, lambda x: (x - mean) @ scaled - off, self.n)
            self.identity_error = float(np.abs(again - np.eye(len(again))).max())

    def _mean(self) -> np.ndarray:
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    def _whitened_mean(self, fit: DataFrame, mean: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(scaled.shape[1])
            for batch in batches:
                x = _matrix(batch.column("x"))
                if len(x):
                    total += ((x - mean) @ scaled).sum(0)
            yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})

        rows = fit.select("x").mapInArrow(added, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] / self.n for r in sorted(rows, key=lambda r: r["i"])])

    def apply(self, rows: DataFrame) -> DataFrame:
        """A row for each of `rows` (vec_id, x) and component."""
        if not self.n:
            return rows.select(
                "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"),
            ).where(F.lit(False))
        n, sums, mean, scaled, explained, error = self.n, self.sums, self._mean(), self.scaled, self.explained, self.identity_error
        exact, k = np.array(sums, object), len(self.values)
        named = np.arange(1, k + 1, dtype=np.int32)

        def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 4096):
                    part = batch.slice(start, 4096)
                    x = _matrix(part.column("x"))
                    away = np.abs(x - mean)
                    # Squares that add up below 2 ** 62 are exact in 64 bits; otherwise in Python's whole numbers.
                    if x.shape[1] * (n * (float(away.max()) + 1)) ** 2 < 2.0**62 and max(map(abs, sums)) + n * float(np.abs(x).max()) < 2.0**62:
                        deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
                    else:
                        deviation = [int(d) if d < 1 << 63 else None for d in ((x.astype(object) * n - exact) ** 2).sum(1)]
                    white = ((x - mean) @ scaled).reshape(-1)
                    yield pa.record_batch({
                        "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(len(part)), k))),
                        "component": pa.array(np.tile(named, len(part))), "n": pa.array(np.full(len(white), n, np.int64)),
                        "deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(part)), k))),
                        "whitened": pa.array(white, pa.float64(), mask=np.isnan(white)),
                        "explained": pa.array(np.tile(explained, len(part))), "identity_error": pa.array(np.full(len(white), error)),
                    })

        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.select("vec_id", "x").mapInArrow(whiten, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Rows with a null or empty vector, or with entries that are null, not finite or of 2 ** 40 or more, are left out. So
    are vectors of another length than most have (ties: the longer ones). Repeated rows count once in the fit and are
    all whitened. `whitened` is null along axes without spread (one vector, equal dimensions); `deviation` is null
    where it doesn't fit a long. An empty table gives an empty one. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), fixed_point(F.col("embedding")).alias("x"))
    rows = rows.where("x is not null")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (most["d"] if most else 0))
    fit = materialize(rows.select("x").distinct(), "distinct_vectors")
    return Whitening(fit, components).apply(rows)
