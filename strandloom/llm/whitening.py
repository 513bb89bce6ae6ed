"""Whitening of embeddings by a Jacobi-Davidson eigensolver over matrix-free products.

The covariance is never formed. Its product with a few columns is one pass over the
vectors: each task centres its rows, multiplies them, and gives one partial sum a
dimension, which a grouped sum adds up. Around that run, on blocks of a few columns in
the driver: Rayleigh-Ritz in a growing subspace, correction equations projected off the
locked and the wanted Ritz vectors, MINRES for all of them at once (an inner step is one
pass, whatever the number of columns), and locking from the largest eigenvalue down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: An entry c becomes floor(SCALE * c) + SHIFT; entries are held within LARGEST, so that x is exact as a double.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**42
COMPONENTS, GUARDS = 8, 4
#: Steps of MINRES for one expansion, and the share of its residual at which it ends early.
INNER, INNER_SHARE = 6, 0.02
_HALF = 26


def integers(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, y_): floor(SCALE * c) of rows without null or non-finite entries, of the most frequent length (ties: the longest); settled."""
    c = F.col(column).cast("array<double>")
    sound = F.col(column).isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(c, lambda v: F.floor(F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE))
    rows = settle(vectors.select(F.col(key), column).filter(sound).select(F.col(key), held.alias("y_")))
    sizes = rows.groupBy(F.size("y_").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("y_") == (sizes["size"] if sizes else 0))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The rows of a batch as int64."""
    lists = batch.column(batch.schema.get_field_index("y_"))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Passes:
    """Passes over the integer vectors; every result has a row for each dimension."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        hi, lo, n = self._sums(_moments, 3, "long").T if not rows.isEmpty() else np.zeros((3, 0), np.int64)
        self.n, self.dimensions = int(n[0]) if len(n) else 0, len(n)
        sums = [(int(a) << _HALF) + int(b) for a, b in zip(hi, lo)]
        #: Means as an integer and a rest below one half, so that centring loses nothing.
        self.middle = np.array([(2 * s + self.n) // (2 * self.n) for s in sums], np.int64)
        self.left = [s - self.n * int(m) for s, m in zip(sums, self.middle)]
        self.rest = np.array([t / self.n for t in self.left])

    def _sums(self, task: Callable, columns: int, kind: str = "double") -> np.ndarray:
        names = [f"s{i}" for i in range(columns)]
        schema = "dim int, " + ", ".join(f"{c} {kind}" for c in names)
        summed = self.rows.select("y_").mapInArrow(task, schema).groupBy("dim").agg(*(F.sum(c).alias(c) for c in names)).collect()
        return np.array([r[1:] for r in sorted(summed)], np.int64 if kind == "long" else np.float64)

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        middle, rest = self.middle, self.rest
        return lambda y: (y - middle) - rest

    def covariance_times(self, columns: np.ndarray) -> np.ndarray:
        """V times some columns."""
        centre = self.centred()

        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _partial(batches, lambda y: (d := centre(y)).T @ (d @ columns))

        return self._sums(task, columns.shape[1]) / self.n

    def trace(self) -> float:
        centre = self.centred()
        return float(self._sums(lambda batches: _partial(batches, lambda y: np.square(centre(y)).sum(axis=0)[:, None]), 1).sum()) / self.n

    def projected_covariance(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the centred rows times w, from the projected rows themselves."""
        centre = self.centred()

        def of(y: np.ndarray) -> np.ndarray:
            z = centre(y) @ w
            return np.column_stack([z.T @ z, z.sum(axis=0)])

        got = self._sums(lambda batches: _partial(batches, of), w.shape[1] + 1) / self.n
        return got[:, :-1] - np.outer(got[:, -1], got[:, -1])


def _partial(batches: Iterable[pa.RecordBatch], of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sum of `of` over a task's batches, one row for each of its rows."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = of(matrix(batch))
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], names=["dim", *(f"s{i}" for i in range(total.shape[1]))])


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums in two halves, and the number of rows."""
    return _partial(batches, lambda y: np.column_stack([(y >> _HALF).sum(axis=0), (y & ((1 << _HALF) - 1)).sum(axis=0), np.full(y.shape[1], len(y), np.int64)]))


# The eigensolver ---------------------------------------------------------------


def off(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x without its part in an orthonormal basis; twice, for rounding."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def extension(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Orthonormal columns that x adds to an orthonormal basis."""
    new = np.zeros((len(x), 0))
    for column in x.T:
        size = np.linalg.norm(column)
        column = off(np.column_stack([basis, new]), (column / size if size else column)[:, None])[:, 0]
        size = np.linalg.norm(column)
        if size > 1e-10:
            column = off(np.column_stack([basis, new]), (column / size)[:, None])[:, 0]
            new = np.column_stack([new, column / np.linalg.norm(column)])
    return new


def corrections(product: Callable[[np.ndarray], np.ndarray], basis: np.ndarray, shifts: np.ndarray, residuals: np.ndarray, steps: int = INNER, share: float = INNER_SHARE) -> np.ndarray:
    """Approximate t with P(V - shift)P t = -residual, P the projection off the basis: MINRES, a column for each shift, all columns in one product a step."""
    b = -off(basis, residuals)
    first = np.linalg.norm(b, axis=0)
    x, w, w_old, v_old = (np.zeros_like(b) for _ in range(4))
    v = b / np.where(first > 0, first, 1)
    beta, eta = np.zeros_like(first), first.copy()
    c, c_old, s, s_old = np.ones_like(first), np.ones_like(first), np.zeros_like(first), np.zeros_like(first)
    open_ = first > 0
    for _ in range(steps):
        if not open_.any():
            break
        av = off(basis, product(v) - v * shifts)
        alpha = (v * av).sum(axis=0)
        new = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(new, axis=0)
        delta, up, far = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        size = np.hypot(delta, beta_new)
        open_ &= size > 0
        safe = np.where(size > 0, size, 1)
        c_old, s_old, c, s = c, s, delta / safe, beta_new / safe
        w_old, w = w, (v - far * w_old - up * w) / safe
        x += np.where(open_, c * eta, 0) * w
        eta = -s * eta
        open_ &= (np.abs(eta) > share * first) & (beta_new > 1e-14 * np.abs(shifts))
        v_old, v, beta = v, new / np.where(beta_new > 0, beta_new, 1), beta_new
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, guards: int = GUARDS, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the largest eigenvalues of a symmetric positive operator, falling.

    A pair is locked once all above it are and its residual is within rounding of the
    operator's norm; RuntimeError if that isn't reached.
    """
    wanted = min(wanted, dimensions)
    block = min(dimensions, wanted + guards)
    space = np.linalg.qr(np.random.default_rng(11).standard_normal((dimensions, block)))[0]
    images = product(space)
    locked = np.zeros((dimensions, 0))
    values: list[float] = []
    norm = 0.0
    for _ in range(rounds):
        small = space.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, moved = space @ turn, images @ turn
        residuals = moved - ritz * theta
        norm = max(norm, float(theta[0]))
        small_enough = np.linalg.norm(residuals, axis=0) <= np.finfo(float).eps * 4 * max(dimensions, 16) * norm
        done = int(np.argmin(small_enough)) if not small_enough.all() else len(theta)
        done = min(done, wanted - len(values))
        values += map(float, theta[:done])
        locked = np.column_stack([locked, ritz[:, :done]])
        space, images, theta, residuals = ritz[:, done:], moved[:, done:], theta[done:], residuals[:, done:]
        if len(values) == wanted:
            break
        keep = 3 * block + len(values)
        if space.shape[1] > keep + block and space.shape[1] + locked.shape[1] < dimensions:  # restart with the best
            space, images = space[:, :keep], images[:, :keep]
        left = wanted - len(values)
        step = corrections(product, np.column_stack([locked, space[:, : left + guards]]), theta[:left], residuals[:, :left])
        new = extension(np.column_stack([locked, space]), step)
        if new.shape[1]:
            space, images = np.column_stack([space, new]), np.column_stack([images, product(new)])
        else:  # the space holds all there is: rounding is left, so its images are made anew
            space = extension(locked, space)
            images = product(space)
    else:
        raise RuntimeError(f"only {len(values)} of {wanted} eigenpairs within rounding after {rounds} rounds")
    small = locked.T @ product(locked)
    values_, turn = np.linalg.eigh((small + small.T) / 2)
    return values_[::-1], locked @ turn[:, ::-1]


# The operator ------------------------------------------------------------------


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, eigenvalue, deviation_exact), a row for each sound vector and component.

    Dropped are vectors that are null, hold null or non-finite entries, or have not the
    most frequent length. Repeated rows and null keys stay. A vector of fewer dimensions
    has as many components. A component whose variance is rounding beside the first has
    null in whitened and doesn't count in identity_error; without any variance explained
    is null. A deviation beyond a long is null; deviation_exact has its digits. Entries
    beyond 2^42 are held there. Without sound vectors there are no rows.
    """
    rows = integers(vectors, key, column)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, deviation_exact string"
    over = Passes(rows)
    if not over.dimensions:
        return vectors.sparkSession.createDataFrame([], schema)
    trace = over.trace()
    e, basis = jacobi_davidson(over.covariance_times, over.dimensions, components) if trace > 0 else (np.zeros(k := min(components, over.dimensions)), np.eye(over.dimensions)[:, :k])
    whole = e > 64 * np.finfo(float).eps * over.dimensions * max(float(e[0]), 0)
    scaled = basis / np.sqrt(np.where(whole, e, 1))
    error = float(np.abs(over.projected_covariance(scaled[:, whole]) - np.eye(int(whole.sum()))).max()) if whole.any() else None
    explained = e / trace if trace > 0 else np.full(len(e), np.nan)
    n, middle, left, centre = over.n, over.middle, over.left, over.centred()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(e)
        own = sum(t * t for t in left)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(batch)
            d = y - middle
            if max(int(d.max()), -int(d.min())) * n >= 2**62 // (2 * d.shape[1]) or max(int(d.max()), -int(d.min())) ** 2 >= 2**62 // d.shape[1]:
                d = d.astype(object)
            squares, crossed = (d * d).sum(axis=1), (d * np.array(left, d.dtype)).sum(axis=1)
            deviation = [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, crossed)]
            z = centre(y) @ scaled
            z[:, ~whole] = np.nan
            again = np.repeat(np.arange(len(y)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(key)).take(pa.array(again)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(y))), pa.array(np.full(len(again), n)),
                    pa.array([v if v < 2**63 else None for v in deviation], pa.int64()).take(pa.array(again)), pa.array(z.reshape(-1), from_pandas=True), pa.array(np.tile(explained, len(y)), from_pandas=True),
                    pa.array([error] * len(again), pa.float64()), pa.array(np.tile(e, len(y))), pa.array(map(str, deviation), pa.string()).take(pa.array(again)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "deviation_exact"],
            )

    return rows.mapInArrow(task, schema)
