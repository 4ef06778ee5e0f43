"""Whitening of vectors by spectrum slicing of their covariance.

Entries become integers (``floor(scale * c) + offset``), so sums and centred products are exact and do not depend on how
rows are spread. The covariance is a small matrix of the vectors' dimensions. Its leading eigenvalues are found one by one:
the inertia of V - s I, read off an LDL' factorisation (of V in tridiagonal form, which has the same inertia), tells how many eigenvalues lie
above s; bisection on these counts isolates the i-th one, Rayleigh quotient iteration from there converges cubically, and counts on both sides of
the result certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plugload.session import materialized

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: The driver holds a few square matrices of so many dimensions at most.
MAX_DIMENSIONS = 4_096
#: Rows of a matrix that travel together.
TILE = 64
#: Eigenvalues below this share of the largest one are taken for zero and give no component.
ZERO = 1e-12
#: Entries beyond this count as not finite: doubles are no longer exact integers there.
LARGEST = 2.0**52
_EPS = np.finfo(float).eps


# -- spectrum slicing -------------------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of Q'VQ, by one reflection per column. All shifts of both have the same inertia."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += length if v[0] >= 0 else -length
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= (p @ v) * v
        rest -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
    return np.diag(a).copy(), np.diag(a, -1).copy()


def positives(diagonal: list[float], squares: list[float], shift: float, least: float) -> int:
    """Number of eigenvalues above the shift: positive pivots of the LDL' factorisation of the shifted matrix.

    ``squares`` are the squared off-diagonal entries, with 0 before the first one. A pivot below ``least`` counts as
    -least, as if the shift were higher by that much.
    """
    count, pivot = 0, 1.0
    for d, b in zip(diagonal, squares):
        pivot = d - shift - b / pivot
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
    return count


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues, falling, their unit eigenvectors as columns, and the certified bounds of each."""

    values: np.ndarray
    vectors: np.ndarray
    lower: np.ndarray
    upper: np.ndarray


class _Slicer:
    def __init__(self, matrix: np.ndarray):
        self.matrix, self.n = matrix, len(matrix)
        self.size = float(np.abs(matrix).sum(axis=1).max())
        self.tolerance = self.size * 16 * _EPS * self.n**0.5
        diagonal, off = tridiagonal(matrix)
        self.form = diagonal.tolist(), [0.0, *(off * off).tolist()]
        self.counts = {self.size * (1 + 1e-9): 0, -self.size * (1 + 1e-9): self.n}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positives(*self.form, shift, max(self.size * _EPS * _EPS, 1e-300))
        return self.counts[shift]

    def bracket(self, i: int) -> tuple[float, float]:
        """The narrowest known (low, high) with the i-th eigenvalue above low and not above high."""
        return max(s for s, c in self.counts.items() if c >= i), min(s for s, c in self.counts.items() if c < i)

    def isolate(self, i: int, width: float) -> tuple[float, float]:
        """Bisect until only the i-th eigenvalue is inside, or the interval is so narrow that others are as good as equal."""
        low, high = self.bracket(i)
        while high - low > width and not (self.above(low) == i and self.above(high) == i - 1):
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= i else (low, middle)
        return low, high

    def iterate(self, low: float, high: float, found: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, float]:
        """(value, unit vector, residual) for the eigenvalue between low and high, the vector orthogonal to those found.

        Inverse iteration with the middle as shift, until the residual is smaller than the distance to both ends: then
        there is an eigenvalue within, and the Rayleigh quotient becomes the shift. Ends when the residual is as small as
        rounding allows, or after some steps, where the caller narrows the interval.
        """
        def solve(shift: float) -> np.ndarray:
            try:
                y = np.linalg.solve(self.matrix - shift * np.eye(self.n), x)
            except np.linalg.LinAlgError:
                y = np.linalg.solve(self.matrix - (shift + self.size * _EPS) * np.eye(self.n), x)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= found @ (found.T @ y)
            return y / np.linalg.norm(y)

        x = x - found @ (found.T @ x)
        x, shift, before = x / np.linalg.norm(x), (low + high) / 2, np.inf
        for _ in range(16):
            x = solve(shift)
            product = self.matrix @ x
            quotient = float(x @ product)
            residual = float(np.linalg.norm(product - quotient * x))
            if residual <= self.tolerance and residual >= before / 2:
                break
            before = residual
            if residual < min(quotient - low, high - quotient):
                shift = quotient
        return quotient, x, residual


def leading(matrix: np.ndarray, components: int = COMPONENTS) -> Spectrum:
    """The largest ``components`` eigenvalues of a symmetric matrix that are above zero, with orthonormal vectors.

    Equal eigenvalues, which counts cannot part, get vectors that span their space. Each value is certified by
    counts: fewer than i eigenvalues lie above its upper bound, at least i above its lower one.
    """
    n = len(matrix)
    slicer, rng = _Slicer(matrix), np.random.default_rng(0)
    found, values, lower, upper = np.empty((n, 0)), [], [], []
    for i in range(1, min(components, n) + 1 if slicer.size > 0 else 1):
        low, high = slicer.isolate(i, slicer.size * 64 * _EPS)
        if high <= ZERO * (values[0] if values else slicer.size):
            break
        vector = rng.standard_normal(n)
        while True:
            value, vector, residual = slicer.iterate(low, high, found, vector)
            margin = max(4 * residual, 256 * slicer.size * _EPS)
            if residual <= slicer.tolerance and slicer.above(value - margin) >= i > slicer.above(value + margin):
                break
            if high - low <= slicer.size * 8 * _EPS:
                raise ArithmeticError(f"eigenvalue {i} of {n} is not certified")
            middle = (low + high) / 2  # narrower, where neighbours disturb
            low, high = (middle, high) if slicer.above(middle) >= i else (low, middle)
            vector = vector + 1e-3 * rng.standard_normal(n)
        if value <= ZERO * (values[0] if values else slicer.size):
            break
        found = np.column_stack([found, vector])
        values.append(value)
        lower.append(value - margin)
        upper.append(value + margin)
    return Spectrum(np.array(values), found, np.array(lower), np.array(upper))


# -- distributed sums -------------------------------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, k: int = 0) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    column = batch.column(k)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], kind=float) -> np.ndarray:
    """Sum over all rows of part(block of rows), a matrix of the given shape.

    A task sums its own blocks; tiles of the results are brought together by tile and summed there, so the driver gets
    one matrix, whatever the number of tasks.
    """
    height, width = shape

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_matrix(batch))
                total = one if total is None else total + one
        if total is not None:
            tiles = [np.ascontiguousarray(total[k : k + TILE], kind).tobytes() for k in range(0, height, TILE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(tiles)), pa.int32()), pa.array(tiles, pa.binary())], ["tile", "packed"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for tile, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(packed.as_buffer(), kind)
                totals[tile] = totals[tile] + values if tile in totals else values.copy()
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["tile", "packed"]
            )

    tiles = "tile int, packed binary"
    got = rows.mapInArrow(local, tiles).repartition("tile").mapInArrow(merged, tiles).toArrow()
    total = np.zeros(shape, kind)
    for tile, packed in zip(got.column("tile").to_pylist(), got.column("packed")):
        values = np.frombuffer(packed.as_buffer(), kind).reshape(-1, width)
        total[tile * TILE : tile * TILE + len(values)] = values
    return total


# -- whitening ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What is learnt from the distinct vectors: their number and sums, the spectrum and the check of the result."""

    n: int
    sums: tuple[int, ...]
    spectrum: Spectrum
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.spectrum.values / self.trace if self.trace else self.spectrum.values

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exact: in 64 bits where they suffice, else as Python integers."""
        sums = np.array(self.sums, object)
        middle = np.array([s // self.n for s in self.sums], object)
        rest = sums - middle * self.n
        near = x.astype(object) - middle if max(map(abs, middle), default=0) >= 2**62 else x - middle.astype(np.int64)
        if float(np.abs(near).max(initial=0)) * self.n < 2.0**61:
            return near.astype(np.int64) * self.n - rest.astype(np.int64)
        return near.astype(object) * self.n - rest

    def project(self, offsets: np.ndarray) -> np.ndarray:
        return offsets.astype(float) / self.n @ (self.spectrum.vectors / np.sqrt(self.spectrum.values))


def quantized(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, x) of the rows whose vector has no null, NaN, infinite or too large entry and the usual length."""
    wide = F.transform(F.col(vector), lambda c: c.cast("double") * SCALE)
    usable = F.coalesce(F.forall("w", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False))) & (F.size("w") > 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("id"), wide.alias("w")).where(usable)
    return rows.select("id", F.transform("w", lambda c: F.floor(c).cast("long") + F.lit(OFFSET).cast("long")).alias("x"))


def fit(distinct: DataFrame, dimensions: int, components: int) -> Whitening:
    """Learn from distinct vectors (x). Three passes: sums, centred products, check."""
    n = distinct.count()

    def halves(x: np.ndarray) -> np.ndarray:
        """Sums of the high and of the low bits, which stay exact in 64 bits."""
        z = x - OFFSET
        return np.vstack([(z >> 26).sum(axis=0), (z & (2**26 - 1)).sum(axis=0)])

    high, low = _summed(distinct, (2, dimensions), halves, np.int64).tolist()
    sums = [(h << 26) + v + n * OFFSET for h, v in zip(high, low)]
    middle = np.array([round_half(s, n) for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        z = (x - middle).astype(float)
        return z.T @ z

    # Centred at the integers next to the means, so the products are exact; the rest of the mean is below one half.
    rest = np.array([(s - int(m) * n) / n for s, m in zip(sums, middle)])
    covariance = _summed(distinct, (dimensions, dimensions), products) / n - np.outer(rest, rest)
    spectrum = leading(covariance, components)
    model = Whitening(n, tuple(sums), spectrum, float(np.trace(covariance)), 0.0)
    k = len(spectrum.values)
    if not k:
        return model

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.project(model.offsets(x))
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(distinct, (k + 1, k), moments) / n
    error = np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max()
    return Whitening(n, tuple(sums), spectrum, model.trace, float(error))


def round_half(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def whitened(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Rows whose vector is null, empty, or holds null, NaN, infinite or absurdly large entries (64 |c| > 2^52) are left
    out; so are rows of another length than most have (of equally frequent lengths the longer counts). Equal vectors
    are learnt from once, but every row has results; rows without id keep null. Components end where the
    eigenvalues do: one distinct vector, or none, gives an empty result. deviation is a decimal, exact to 38 digits. Other
    columns of the input are not read.
    """
    rows = quantized(vectors, vec_id, vector)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dimensions = lengths[0]["d"] if lengths else 0
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions are more than {MAX_DIMENSIONS}")
    kind = vectors.select(F.col(vec_id).alias("id")).schema["id"].dataType.simpleString()
    out = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = rows.where(F.size("x") == dimensions)
    model = fit(materialized(rows.select("x").distinct()), dimensions, components) if dimensions else None
    if model is None or not len(model.spectrum.values):
        return rows.sparkSession.createDataFrame([], out).withColumnRenamed("id", vec_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, explained = len(model.spectrum.values), model.explained
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                m = batch.num_rows
                y = model.offsets(_matrix(batch, 1))
                if y.dtype != object and float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0**62:
                    deviation = (y * y).sum(axis=1).tolist()
                else:
                    deviation = (y.astype(object) ** 2).sum(axis=1).tolist()
                columns = [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(model.project(y).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ]
                names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, out).withColumnRenamed("id", vec_id)
