"""Embedding whitening: principal axes by mixed-precision refinement of single-precision eigenvectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored
from tabscout.llm.ship import ship

#: Components per unit of an embedding's entries: entries become floor(UNITS * c).
UNITS = 256
#: Rows of one matrix product in a task.
ROWS = 4096
#: Groups that the partial sums of all tasks are added up in, before they are added up to one.
GROUPS = 64
#: Refinement ends after so many rounds, or when corrections are below the precision of doubles.
ROUNDS = 12
_WIDE = np.longdouble


def _norm(a: np.ndarray) -> float:
    """The spectral norm of a symmetric or nearly symmetric matrix, from above."""
    return float(np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max())) if a.size else 0.0


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in extended precision."""
    return np.matmul(a.astype(_WIDE), b.astype(_WIDE))


def _solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """Turns the columns of every cluster of eigenvalues closer than ``gap`` onto the eigenvectors of its own small matrix.

    The cluster's mean is taken off first, so that what tells its eigenvalues
    apart is not lost beside their size. Columns come in ascending order of ``values``.
    """
    edges = np.flatnonzero(np.diff(values) > gap) + 1
    x = x.copy()
    for cluster in np.split(np.arange(len(values)), edges):
        if len(cluster) > 1:
            own, _ = np.linalg.qr(x[:, cluster].astype(np.float64))
            shifted = a - values[cluster].mean() * np.eye(len(a), dtype=_WIDE)
            small = _product(own.T, _product(shifted, own)).astype(np.float64)
            x[:, cluster] = _product(own, np.linalg.eigh((small + small.T) / 2)[1])
    return x


def refined_eigenvectors(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and unit eigenvectors as columns of a symmetric matrix, to the precision of doubles.

    Starts from eigenvectors in single precision. A round of Ogita and Aishima's
    method computes, in extended precision, how far the vectors X are from
    orthonormal (R = I - X'X) and X'AX from diagonal (S), and corrects X by X E with
    E_ij = (S_ij + l_j R_ij) / (l_j - l_i), which squares the error. Where two
    eigenvalues are closer than the present error, E_ij = R_ij / 2 only keeps them
    orthonormal, and their cluster is solved by itself. Equal eigenvalues have no
    axes of their own; any orthonormal ones are right. The sign makes a vector's
    entry of largest size positive.
    """
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0.0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = matrix.astype(_WIDE) / _WIDE(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_WIDE)
    identity, last = np.eye(len(a), dtype=_WIDE), np.inf
    for _ in range(rounds):
        r = identity - _product(x.T, x)
        s = _product(x.T, _product(a, x))
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        error = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > error
        step = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + _product(x, step)
        change = float(np.abs(step).max())
        if change <= 2.0**-53 or (change < 2.0**-45 and change > last / 2):
            break
        last = change
        if not far[~np.eye(len(a), dtype=bool)].all():
            x = _solve_clusters(a, x, values, float(error))
    for _ in range(3):  # within clusters, the last corrections may have left the vectors a little oblique
        x = x + _product(x, (identity - _product(x.T, x)) / 2)
    values = np.diag(_product(x.T, _product(a, x)))
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x *= np.where(x[np.abs(x).argmax(0), np.arange(len(a))] < 0, -1, 1)
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


@dataclass(frozen=True)
class Axes:
    """What the fit list says of vectors of one width.

    ``sums`` are exact; ``components`` has unit eigenvectors as rows by falling
    ``eigenvalues``, those alone that are more than rounding beside the largest.
    """

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision: the whole part of the mean is taken off exactly first."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        if max(map(abs, whole), default=0) < 2**62 and np.abs(x, dtype=np.float64).max(initial=0) < 2**62:
            return (x - np.array(whole, np.int64)) - rest
        return (x.astype(object) - np.array(whole, object)).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exact."""
        largest = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums), default=0)
        exact = np.int64 if largest**2 * max(1, x.shape[1]) < 2**63 else object
        away = x.astype(exact) * self.n - np.array(self.sums, exact)
        return [int(d) for d in (away * away).sum(1)] if x.size else [0] * len(x)


def whole_vectors(vectors: DataFrame, column: str) -> Column:
    """Condition: the vector is there and all its entries are finite and stay within 64 bits as whole numbers."""
    value = F.col(f"`{column}`").cast("array<double>")
    return F.coalesce(F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**62 / UNITS))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Matrices of at most ``ROWS`` vectors of one width."""
    for batch in batches:
        vectors = batch.column("x")
        lengths = pc.list_value_length(vectors)
        for width in pc.unique(lengths).to_pylist():
            own = vectors.filter(pc.equal(lengths, width))
            for start in range(0, len(own), ROWS):
                yield width, _matrix(own.slice(start, ROWS))


_SUMMED = "width int, row int, part int, hi array<double>, lo array<double>"


def _partials(held: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
    """One row per row of each matrix; extended precision travels as the sum of two doubles."""
    rows = [(w, i, part, line.astype(np.float64), (line - line.astype(np.float64)).astype(np.float64)) for w, m in held.items() for i, line in enumerate(m)]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["width", "row", "part", "hi", "lo"])


def _added_up(partials: DataFrame) -> DataFrame:
    """The sum of all partial matrices, row by row: first within groups of tasks, then over the groups."""

    def add(group: pa.Table) -> pa.Table:
        hi, lo = (_matrix(group.column(n).combine_chunks()).astype(_WIDE) for n in ("hi", "lo"))
        line = (hi + lo).sum(0)
        key = [group.column(n)[0].as_py() for n in ("width", "row", "part")]
        high = line.astype(np.float64)
        arrays = [[key[0]], [key[1]], [key[2]], [high], [(line - high).astype(np.float64)]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([pa.array(c, t) for c, t in zip(arrays, kinds, strict=True)], ["width", "row", "part", "hi", "lo"])

    grouped = partials.groupBy("width", "row", "part").applyInArrow(add, _SUMMED)
    return grouped.withColumn("part", F.lit(0)).groupBy("width", "row", "part").applyInArrow(add, _SUMMED)


def _summed(fit: DataFrame, measured: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The sum over all vectors of a small matrix per block of them, by width; the driver gets that matrix alone."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for width, x in _by_width(batches):
            more = measured(width, x).astype(_WIDE)
            held[width] = held[width] + more if width in held else more
        yield _partials(held, TaskContext.get().partitionId() % GROUPS)

    rows = _added_up(fit.select("x").mapInArrow(partial, _SUMMED)).orderBy("width", "row").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.width, []).append(np.array(r.hi, _WIDE) + np.array(r.lo, _WIDE))
    return {w: np.array(m) for w, m in out.items()}


def fit_axes(fit: DataFrame, k: int) -> dict[int, Axes]:
    """The ``k`` largest axes of the distinct vectors ``x``, for each width that there is.

    Sums are exact. The covariance is summed over centred vectors, block by
    block, and added up in extended precision; the driver gets one matrix of
    width x width numbers, whatever the number of vectors.
    """
    sums = (
        fit.select(F.size("x").alias("width"), F.posexplode_outer("x").alias("at", "c"))
        .groupBy("width", "at")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
        .orderBy("width", "at")
        .collect()
    )
    known: dict[int, tuple[int, list[int]]] = {}
    for r in sums:
        known.setdefault(r.width, (r.n, []))[1].append(int(r.s or 0))
    plain = {w: Axes(n, tuple(s[:w]), np.zeros((0, w)), np.zeros(0), 0.0) for w, (n, s) in known.items()}

    def spread(width: int, x: np.ndarray) -> np.ndarray:
        away = plain[width].centred(x)
        return away.T @ away

    covariances = _summed(fit.where(F.size("x") > 0), spread) if plain else {}
    fitted = {}
    for width, own in plain.items():
        if width not in covariances:
            fitted[width] = own
            continue
        values, vectors = refined_eigenvectors(covariances[width] / own.n)
        total = float(np.trace(covariances[width] / own.n))
        real = int((values[:k] > max(values[0], 0.0) * width * 2.0**-50).sum())
        fitted[width] = Axes(own.n, own.sums, vectors[:, :real].T.copy(), values[:real], total)
    return fitted


def identity_errors(fit: DataFrame, axes: dict[int, Axes]) -> dict[int, float]:
    """By width, the largest entry of the whitened fit list's covariance minus the identity; two passes, means first."""
    real = {w: a for w, a in axes.items() if len(a.eigenvalues)}
    if not real:
        return {}
    used = fit.where(F.size("x").isin(list(real)))
    means = {w: m[0] / real[w].n for w, m in _summed(used, lambda w, x: real[w].whitened(x).sum(0, keepdims=True)).items()}

    def spread(width: int, x: np.ndarray) -> np.ndarray:
        away = real[width].whitened(x) - means[width].astype(np.float64)
        return away.T @ away

    found = _summed(used, spread)
    return {w: float(np.abs(m / real[w].n - np.eye(len(m))).max()) for w, m in found.items()}


def whiten(vectors: DataFrame, k: int = 4, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``<key>, component, n, deviation, whitened, explained, identity_error`` for every row and component up to ``k``.

    Entries become whole numbers x = floor(256 c). Axes are the unit eigenvectors
    of the covariance of the distinct x, largest eigenvalue e first; ``whitened``
    is x minus the mean, projected on the axis, over sqrt(e); ``explained`` is e
    over the trace; ``deviation`` is the exact sum of (n x - S)^2, null if it exceeds 64 bits.

    Rows without a vector, or with null or non-finite entries, are left out; so
    are entries beyond 2^54, which are no whole numbers in 64 bits. A zero vector
    takes part. Vectors of each width are a space of their own, with its own
    fit. Where the vectors of a width span fewer than ``k`` dimensions, the
    components beyond have no variance: whitened is null there and explained 0.
    Without any variance (one distinct vector) identity_error is null. Vectors
    without entries have no components and give no rows, nor does an empty table.
    Repeated rows come back as often as they are there, null keys as they are.
    """
    spark = vectors.sparkSession
    ship(spark)
    value = F.col(f"`{column}`").cast("array<double>")
    rows = vectors.where(whole_vectors(vectors, column)).select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(value, lambda c: F.floor(c * F.lit(float(UNITS)))).alias("x")
    )
    fit = stored(rows.select("x").distinct())
    axes = fit_axes(fit, k)
    errors = identity_errors(fit, axes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            lengths = pc.list_value_length(batch.column("x"))
            for width in pc.unique(lengths).to_pylist():
                own, chosen = axes[width], batch.filter(pc.equal(lengths, width))
                for start in range(0, len(chosen) if width else 0, ROWS):
                    part = chosen.slice(start, ROWS)
                    x, shown, real = _matrix(part.column("x")), min(k, width), len(own.eigenvalues)
                    white = np.full((len(part), shown), np.nan)
                    white[:, :real] = own.whitened(x)
                    share = np.zeros(shown)
                    share[:real] = own.eigenvalues / own.total if own.total else 0.0
                    away = [d if d < 2**63 else None for d in own.deviations(x)]
                    arrays = [
                        part.column("id").take(pa.array(np.repeat(np.arange(len(part)), shown))),
                        pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(len(part) * shown, own.n, np.int64)),
                        pa.array([d for d in away for _ in range(shown)], pa.int64()),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(share, len(part))),
                        pa.array([errors.get(width)] * (len(part) * shown), pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(project, schema).withColumnRenamed("id", key)
