"""Whitening of embeddings with Jacobi-Davidson.

Entries become whole numbers first, so means and deviations are exact.  The covariance is never formed: Spark multiplies it with a block of
vectors, each task adding its rows' centred products, and only sums of the size (dimensions x vectors) reach the driver.

Jacobi-Davidson keeps a search space.  Rayleigh-Ritz gives its best vectors; for each that is not exact yet, a few steps of MINRES solve the
correction equation, projected against what is locked and the vector itself, and the corrections widen the space.  Vectors are locked in
falling order as their residuals reach double precision; a full space shrinks to its best vectors.  All corrections of a round share
their passes over the rows.

Rows whose vector is null or empty, or holds null or non-finite entries, take no part, nor do those with an entry whose whole number would exceed 2^52.  Shorter
vectors count as filled up with zeros.  Repeated rows and null ids count and are returned row by row.  Directions without variance
(an eigenvalue at most ``flat`` of the largest) cannot be whitened and have no rows; so one row, equal rows or an empty table
give none.  A deviation beyond a long is null.  Columns besides id and vector are left out.
"""
from __future__ import annotations

from typing import Callable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import written

Product = Callable[[np.ndarray], np.ndarray]


class Fit(NamedTuple):
    n: int
    sums: tuple[int, ...]
    values: np.ndarray       # falling
    vectors: np.ndarray      # (dimensions, components)
    trace: float
    passes: int


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x) with x = floor(scale * c) + shift of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(2 ** 52 // scale))
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, fits)
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c).cast("bigint") + shift)
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(ok, x).alias("x")).where("x IS NOT NULL")


def sums_of(rows: DataFrame, shift: int = 1_000_000) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension, vectors that end earlier counting ``shift`` (zero) there."""
    n = rows.count()
    got = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count("*").alias("k"))
    return n, [int(r["s"]) + shift * (n - r["k"]) for r in got.orderBy("i").collect()]          # one row a dimension


def _numerators(lists: pa.ChunkedArray, n: int, sums: np.ndarray, shift: int) -> np.ndarray:
    """n * x - S of a batch, exact: machine integers where they suffice, Python's beyond."""
    rows = lists.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    x = np.full((len(sizes), len(sums)), shift, np.int64)
    x[np.arange(len(sums))[None, :] < sizes[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    if n * max(int(np.abs(x).max(initial=0)), shift) < 2 ** 61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _by_batch(f: Callable[[pa.RecordBatch], np.ndarray], columns: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up what ``f`` gives for batches of at most ``step`` rows and returns one row for each row of the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = f(b.slice(at, step))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["i", *(f"w{j}" for j in range(columns))])
    return run


def _summed(rows: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], columns: int, step: int = 1024) -> np.ndarray:
    """The sum of ``f`` over all rows, added up by row of the result before it reaches the driver."""
    names = [f"w{j}" for j in range(columns)]
    parts = rows.mapInArrow(_by_batch(f, columns, step), ", ".join(["i int", *(f"{c} double" for c in names)]))
    got = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).orderBy("i").collect()
    return np.array([[r[c] for c in names] for r in got], float).reshape(len(got), columns)


def covariance_times(rows: DataFrame, n: int, sums: list[int], shift: int) -> Product:
    """W -> V W, one pass over the rows: each is centred, multiplied with W and added."""
    exact = np.array(sums, object)

    def times(w: np.ndarray) -> np.ndarray:
        def part(b: pa.RecordBatch) -> np.ndarray:
            y = _numerators(pa.chunked_array([b.column("x")]), n, exact, shift).astype(np.float64) / n
            return y.T @ (y @ w)
        return _summed(rows, part, w.shape[1]) / n
    return times


def minres(product: Product, b: np.ndarray, steps: int) -> np.ndarray:
    """``steps`` of MINRES from zero for each column of ``b`` by itself; all columns share one ``product`` a step.

    Lanczos vectors are orthogonalised by the three-term recurrence and the least-squares problem is updated by Givens rotations."""
    tiny = np.finfo(float).tiny
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    v, v_old = b / np.maximum(beta, tiny), np.zeros_like(b)
    d, d_old = np.zeros_like(b), np.zeros_like(b)
    c_old = c = np.ones(b.shape[1])
    s_old = s = np.zeros(b.shape[1])
    left, beta_k = beta.copy(), np.zeros(b.shape[1])
    start = np.maximum(beta, tiny)
    for _ in range(steps):
        z = product(v) - beta_k * v_old
        alpha = (v * z).sum(axis=0)
        z -= alpha * v
        beta_next = np.linalg.norm(z, axis=0)
        third = s_old * beta_k
        second = c * (c_old * beta_k) + s * alpha
        first = c * alpha - s * (c_old * beta_k)
        length = np.hypot(first, beta_next)
        live = (length > 1e-300) & (np.abs(left) > 1e-15 * start)
        length = np.where(live, length, 1.0)
        c_new, s_new = first / length, beta_next / length
        d_new = (v - second * d - third * d_old) / length
        x += np.where(live, c_new * left, 0.0) * np.where(live, d_new, 0.0)
        left = np.where(live, -s_new * left, 0.0)
        d_old, d, c_old, c, s_old, s = d, d_new, c, c_new, s, s_new
        live &= beta_next > 1e-14 * start
        left = np.where(live, left, 0.0)
        v_old, v, beta_k = v, np.where(live, z / np.maximum(beta_next, tiny), 0.0), np.where(live, beta_next, 0.0)
        if not live.any():
            break
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``new`` adds to ``against``; directions that are there already fall away."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
    for _ in range(3):                                         # orthogonal to rounding
        for a in against:
            new = new - a @ (a.T @ new)
        q, r = np.linalg.qr(new)
        keep = np.abs(np.diag(r)) > 1e-10
        new = q[:, keep]
    return new


def eigenpairs(product: Product, dimensions: int, wanted: int, block: int = 40, space: int = 160, steps: int = 6, rounds: int = 200, exact: float = 2e-14, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues, falling, their unit vectors, and the number of products taken.

    ``block`` vectors are refined at a time, a few more than are wanted where dimensions allow, so that a large eigenvalue that the
    start hardly holds is not passed over.  A pair is exact when |V u - e u| is at most ``exact`` times the largest eigenvalue."""
    wanted = min(wanted, dimensions)
    block, space = min(max(block, 1), dimensions), max(space, 3 * block)
    passes = 0

    def times(w: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(w)

    locked, values = np.zeros((dimensions, 0)), []
    base = _orthonormal(np.random.default_rng(seed).standard_normal((dimensions, block)))
    image = times(base)
    best = np.inf
    for _ in range(rounds):
        h = base.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, y = theta[order], y[:, order]
        base, image = base @ y, image @ y                      # Ritz vectors, falling, and their images
        residual = image - base * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        scale = max(values[0] if values else 0.0, theta[0] if len(theta) else 0.0, np.finfo(float).tiny)
        whole = base.shape[1] + locked.shape[1] >= dimensions  # nothing is left outside the space: Ritz pairs are eigenpairs
        n = 0
        while n < len(theta) and len(values) + n < wanted and (size[n] <= exact * scale or whole):
            n += 1
        locked, values = np.hstack([locked, base[:, :n]]), values + list(theta[:n])
        base, image, theta, residual, size = base[:, n:], image[:, n:], theta[n:], residual[:, n:], size[n:]
        if len(values) >= wanted:
            break
        # shrink a full space to its best vectors; their images follow without a pass
        if base.shape[1] + block > space:
            base, image = base[:, :2 * block], image[:, :2 * block]
        at = np.flatnonzero(size[:block] > exact * scale)[:block]
        u, shift, r = base[:, at], theta[at], residual[:, at]

        def outside(w: np.ndarray) -> np.ndarray:
            w = w - locked @ (locked.T @ w)
            return w - u * (u * w).sum(axis=0)

        t = minres(lambda w: outside(times(outside(w)) - shift * outside(w)), -outside(r), steps)
        new = _orthonormal(np.hstack([t, r]) if base.shape[1] + 2 * len(at) <= dimensions - locked.shape[1] else t, locked, base)
        if not new.shape[1]:                                   # nothing to add: start anew from what the space does not hold
            new = _orthonormal(np.random.default_rng(seed + passes).standard_normal((dimensions, block)), locked, base)
        base, image = np.hstack([base, new]), np.hstack([image, times(new)])
    else:
        raise ArithmeticError(f"{len(values)} of {wanted} eigenpairs after {rounds} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], passes


def fit(rows: DataFrame, components: int = 32, shift: int = 1_000_000, flat: float = 1e-12, **options: float) -> Fit:
    """Exact sums, and the leading eigenpairs of the covariance of rows (vec_id, x)."""
    n, sums = sums_of(rows, shift)
    if not n:
        return Fit(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0)
    d, exact = len(sums), np.array(sums, object)

    def squares(b: pa.RecordBatch) -> np.ndarray:
        y = _numerators(pa.chunked_array([b.column("x")]), n, exact, shift).astype(np.float64) / n
        return np.array([[(y * y).sum()]])

    trace = float(_summed(rows, squares, 1)[0, 0]) / n
    if trace == 0.0:
        return Fit(n, tuple(sums), np.zeros(0), np.zeros((d, 0)), 0.0, 0)
    values, vectors, passes = eigenpairs(covariance_times(rows, n, sums, shift), d, components, **options)
    live = values > flat * values[0]
    return Fit(n, tuple(sums), values[live], vectors[:, live], trace, passes)


def transform(rows: DataFrame, model: Fit, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, deviation, whitened array) of rows (vec_id, x)."""
    n, exact, to = model.n, np.array(model.sums, object), model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                top = _numerators(pa.chunked_array([b.column("x")]), n, exact, shift)
                if float(np.abs(top).max(initial=0)) ** 2 * len(exact) < 2.0 ** 62:
                    deviation = (top.astype(np.int64) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [s if s < 2 ** 63 else None for s in (top.astype(object) ** 2).sum(axis=1).tolist()]
                z = (top.astype(np.float64) / n) @ to
                z = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(deviation, pa.int64()), z], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, in two passes."""
    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return b.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, components)

    total = _summed(white, lambda b: np.hstack([[[b.num_rows]], matrix(b).sum(axis=0, keepdims=True)]), components + 1)[0]
    n, mean = total[0], total[1:] / total[0]

    def centred(b: pa.RecordBatch) -> np.ndarray:
        z = matrix(b) - mean
        return z.T @ z

    return float(np.abs(_summed(white, centred, components) / n - np.eye(components)).max())


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, **options: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    rows = written(integers(vectors, id_col, vector_col, scale, shift))
    model = fit(rows, components, shift, **options)
    k = len(model.values)
    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], out)
    white = written(transform(rows, model, shift))
    error = identity_error(white, k)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    return (white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
