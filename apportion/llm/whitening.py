"""Whitening by an incremental eigendecomposition of the covariance.

A spectrum is a count, exact sums, and the eigenvalues and eigenvectors of the scatter
about the mean. Adding a vector is a rank-one update: in the old eigenvectors the scatter is
a diagonal plus rho z z', whose eigenvalues are the roots of a secular equation. Components
that z does not touch, and equal eigenvalues, are deflated first.

1. Every task folds its distinct vectors into a spectrum. A block of rows is first reduced to its
   triangular factor, whose rows have the same scatter, so that the number of updates is that of
   the dimensions and not of the rows.
2. Spectra are added in a tree of small groups: the eigenvectors of one, scaled by the roots of
   their eigenvalues, update the other, and the distance of the means once more.
3. In the basis found, the covariance is taken once more from all vectors (Rayleigh-Ritz), and its small
   eigenproblem turns the basis, which removes what rounding added up.

What the driver and a task hold is a few matrices with a side of the vectors' width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.session import written

BLOCK_ROWS = 4096
FAN_IN = 16
COMPONENTS = 4
SCALE = 256
_STEPS = 64
_EPS = np.finfo(float).eps
_MOST = (1 << 63) - 1


def deflated(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """Which components take part in an update; equal eigenvalues are turned into one, in place."""
    length = np.linalg.norm(z)
    scale = max(abs(values[-1]), abs(values[0]), rho * length**2)
    alone = rho * np.abs(z) * length <= _EPS * scale
    live = np.flatnonzero(~alone)
    for i, j in zip(live[:-1], live[1:], strict=True):
        if values[j] - values[i] <= 8 * _EPS * scale:
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            z[i], z[j] = 0.0, r
            vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
            alone[i] = True
    return ~alone


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum(z2 / (d - x)), each as the nearest pole and the distance to it.

    ``d`` ascends strictly, z2 > 0: there is one root after each pole, the last one at most
    rho sum(z2) after it. All roots are bisected at once, as distances from a pole, so
    that roots close to a pole keep their digits.
    """
    m = len(d)
    gap = np.append(np.diff(d), rho * z2.sum())
    delta = d[None, :] - d[:, None]
    middle = 1 + rho * np.sum(z2 / (delta - (gap / 2)[:, None]), axis=1)
    left = middle >= 0  # the root is in the left half of its gap
    left[-1] = True
    pole = np.where(left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    delta = d[None, :] - d[pole][:, None]
    for _ in range(_STEPS):
        at = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            f = 1 + rho * np.sum(z2 / (delta - at[:, None]), axis=1)
        # Between poles the function ascends; at a pole itself the sum is infinite or undefined.
        up = np.where(np.isfinite(f), f >= 0, at < 0)
        high, low = np.where(up, at, high), np.where(up, low, at)
    offset = np.where(left, high, low)
    offset[offset == 0] = np.finfo(float).tiny
    return pole, offset


def rank_one_update(
    values: np.ndarray, vectors: np.ndarray, vector: np.ndarray, rho: float = 1.0
) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of Q diag(values) Q' + rho * vector vector', rho > 0."""
    z = vectors.T @ vector
    if not np.any(z):
        return values, vectors
    vectors = vectors.copy()
    live = deflated(values, vectors, z, rho)
    if not live.any():
        return values, vectors
    d, part = values[live], z[live]
    pole, offset = secular_roots(d, part**2, rho)
    # Differences pole_i - root_k, by the root's nearest pole.
    apart = (d[:, None] - d[pole][None, :]) - offset[None, :]
    # The vector for which these roots are exact, so that eigenvectors are orthogonal.
    between = d[:, None] - d[None, :]
    np.fill_diagonal(between, 1.0)
    ratio = np.abs(apart) / np.abs(between)
    exact = np.sqrt(np.exp(np.sum(np.log(ratio), axis=1)) / rho)
    turned = np.copysign(exact, part)[:, None] / apart
    turned /= np.linalg.norm(turned, axis=0)
    values = values.copy()
    values[live] = d[pole] + offset
    vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, and eigenvalues and vectors of the scatter about the mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(width: int) -> Spectrum:
        return Spectrum(0, [0] * width, np.zeros(width), np.eye(width))

    def add(self, rows: np.ndarray) -> None:
        """Fold in a block of integer rows."""
        n = len(rows)
        if not n:
            return
        sums = column_sums(rows)
        centred = rows - np.array([s / n for s in sums])
        factor = np.linalg.qr(centred, mode="r") if n > rows.shape[1] else centred
        self._join(n, sums, factor)

    def merge(self, other: Spectrum) -> None:
        if other.n:
            self._join(other.n, other.sums, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def _join(self, n: int, sums: list[int], rows: np.ndarray) -> None:
        if self.n:
            # n m / (n + m) times the square of the distance of the means; integers until the end.
            apart = np.array([(a * n - b * self.n) / (n * self.n) for a, b in zip(self.sums, sums, strict=True)])
            rows = np.vstack([rows, apart * np.sqrt(self.n * n / (self.n + n))])
        for row in rows:
            self.values, self.vectors = rank_one_update(self.values, self.vectors, row)
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def row(self) -> dict:
        return {
            "n": self.n, "sums": [str(x) for x in self.sums],
            "eigenvalues": self.values.tolist(), "eigenvectors": self.vectors.ravel().tolist(),
        }

    @staticmethod
    def of(row) -> Spectrum:
        width = len(row["sums"])
        vectors = np.array(row["eigenvectors"], dtype=float).reshape(width, width)
        return Spectrum(int(row["n"]), [int(x) for x in row["sums"]], np.array(row["eigenvalues"], dtype=float), vectors)


def column_sums(rows: np.ndarray) -> list[int]:
    """Exact sums of columns of 64-bit integers."""
    most = int(np.abs(rows.astype(float)).max()) if rows.size else 0
    if most * len(rows) < 1 << 62:
        return [int(x) for x in rows.sum(axis=0)]
    return [sum(int(x) for x in column) for column in rows.T]


def matrices(batches: Iterator[pa.RecordBatch], width: int, rows: int = BLOCK_ROWS) -> Iterator[np.ndarray]:
    """Blocks of at most ``rows`` vectors from the last column of Arrow batches."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for i in range(0, len(flat), rows):
            yield flat[i : i + rows]


def integer_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and x, the vector's components as floor(256 * component).

    Rows whose vector is null or empty, holds null or non-finite components, or components whose x does not fit
    64 bits are left out, and so are those of another length than most vectors have
    (of lengths equally frequent the greatest counts).
    """
    c = F.col(vector_column).cast("array<double>")
    # A comparison with NaN or null is not true; infinities are out of range.
    sound = F.forall(c, lambda v: F.coalesce(F.abs(v * SCALE) < float(1 << 63), F.lit(False)) & ~F.isnan(v))
    kept = table.select(F.col(id_column).cast("bigint").alias("vec_id"), c.alias("c")).where((F.size("c") > 0) & sound)
    widths = kept.groupBy(F.size("c").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = widths[0]["w"] if widths else 0
    x = F.transform("c", lambda v: F.floor(v * SCALE).cast("bigint"))
    return kept.where(F.size("c") == width).select("vec_id", x.alias("x"))


SPECTRUM = "part int, n bigint, sums array<string>, eigenvalues array<double>, eigenvectors array<double>"


def spectrum_of(fit: DataFrame, width: int) -> Spectrum:
    """The spectrum of all vectors in column x, by tasks and then by a tree of groups."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.empty(width)
        for rows in matrices(batches, width):
            found.add(rows)
        if found.n:
            from pyspark import TaskContext

            yield pa.RecordBatch.from_pandas(pd.DataFrame([{"part": TaskContext.get().partitionId()} | found.row()]), schema=arrow)

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = Spectrum.empty(width)
        for _, row in parts.sort_values("part").iterrows():
            total.merge(Spectrum.of(row))
        return pd.DataFrame([{"part": int(key[0])} | total.row()])

    arrow = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())),
                       ("eigenvalues", pa.list_(pa.float64())), ("eigenvectors", pa.list_(pa.float64()))])
    level = written(fit.select("x").mapInArrow(fold, SPECTRUM), "whitening-spectra")
    left = level.agg(F.max("part").alias("p")).head()["p"]
    while left is not None and left > 0:
        # Task numbers are dense, so groups hold at most FAN_IN spectra.
        group = F.floor(F.col("part") / FAN_IN).cast("int").alias("group")
        level = written(level.groupBy(group).applyInPandas(merge, SPECTRUM), "whitening-spectra")
        left //= FAN_IN
    rows = level.collect()  # one spectrum
    return Spectrum.of(rows[0]) if rows else Spectrum.empty(width)


def summed_products(fit: DataFrame, width: int, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum over all vectors of y y', where y is (x - centre) in the basis."""
    side = basis.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side))
        for rows in matrices(batches, width):
            y = (rows - centre) @ basis
            total += y.T @ y
        i, j = np.triu_indices(side)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    sums = fit.select("x").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = np.zeros((side, side))
    for i, j, v in sums.collect():  # at most side * side values
        found[i, j] = found[j, i] = v
    return found


@dataclass
class Whitening:
    """A fitted transformation: row k of ``components`` belongs to eigenvalue k, falling."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """Factors of the components; not a number where there is no variance."""
        least = len(self.sums) * _EPS * self.trace
        return np.array([e**-0.5 if e > least else np.nan for e in self.eigenvalues])


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors in column ``x`` (of one length); None if there are none."""
    fit = written(vectors.select("x").distinct(), "whitening-fit")
    some = fit.head()
    if some is None:
        return None
    width = len(some["x"])
    spectrum = spectrum_of(fit, width)
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    found = Whitening(spectrum.n, spectrum.sums, np.zeros(0), np.zeros((0, width)), 0.0, None)
    ritz = summed_products(fit, width, found.centre, basis) / found.n
    e, turn = np.linalg.eigh(ritz)
    k = min(components, width)
    found.trace = float(np.trace(ritz))
    found.eigenvalues = e[::-1][:k]
    found.components = (basis @ turn[:, ::-1][:, :k]).T
    good = np.isfinite(found.scales)
    if good.any():
        scaled = found.components[good].T * found.scales[good]
        cov = summed_products(fit, width, found.centre, scaled) / found.n
        found.identity_error = float(np.abs(cov - np.eye(int(good.sum()))).max())
    return found


WHITENED = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each vector's first components, decorrelated and of unit variance.

    Vectors are taken as ``integer_vectors`` does; the fit list is each distinct one once. A row per vector and
    component: vec_id, component, n (length of the fit list), deviation (sum over dimensions of
    (n x - S)², exact; null above 64 bits), whitened (null where the component has no variance), explained (null
    if there is no variance at all) and identity_error (null likewise). Vectors with fewer dimensions than
    components have as many rows as dimensions. Rows with equal or null ids are kept each; an empty table gives no
    rows; further columns are left out. Vectors are read again for the last step, not kept.
    """
    vectors = integer_vectors(table)
    model = fit_whitening(vectors, components)
    if model is None:
        return table.sparkSession.createDataFrame([], WHITENED)
    n, sums, centre, width = model.n, model.sums, model.centre, len(model.sums)
    turn = model.components.T * model.scales
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.eigenvalues]
    error, k = model.identity_error, len(explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for start, rows in zip(range(0, len(ids), BLOCK_ROWS), matrices([batch], width), strict=True):
                m = len(rows)
                y = (rows - centre) @ turn
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(np.repeat(ids[start : start + m], k).tolist(), pa.int64()),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, n, dtype=np.int64)),
                    "deviation": pa.array(np.repeat(np.array(deviations(rows, n, sums), dtype=object), k).tolist(), pa.int64()),
                    "whitened": pa.array(y.ravel(), mask=~np.isfinite(y.ravel())),
                    "explained": pa.array(explained * m, pa.float64()),
                    "identity_error": pa.array([error] * (m * k), pa.float64()),
                })

    return vectors.mapInArrow(project, WHITENED)


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)² over the dimensions, exact; None above 64 bits."""
    most = n * int(np.abs(rows.astype(float)).max()) + max(abs(s) for s in sums) if rows.size else 0
    if most * most * len(sums) < 1 << 62:
        return ((rows * n - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in rows]
    return [x if x <= _MOST else None for x in exact]
