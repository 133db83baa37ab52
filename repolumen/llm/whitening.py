"""Whitening of embeddings: leading principal components by block Jacobi-Davidson.

The covariance is never formed. Each product of it with a block of directions is one
pass over the distinct vectors: a task centres its rows, multiplies them and adds up;
the sums of tasks meet in a few, and what reaches the driver has the size of the
directions. There, in the small space of the directions asked for so far,
Rayleigh-Ritz gives the estimates. For each that is not exact yet, MINRES solves the
projected correction equation, all of them sharing one pass a step, and the solutions
extend the space. Exact ones are locked: the space goes on without them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.session import cut_lineage

#: Entries become floor(SCALE * entry); a constant added to all of them would change no result.
SCALE = 64
#: Whole numbers are taken as at most so large: differences from a mean are exact as doubles.
LARGEST = 1 << 52
#: Sums are taken over parts of so many bits, so that they stay far from the bounds of a long.
PART_BITS = 18
#: Steps of an inner solution; a later one begins from a better estimate.
INNER_STEPS = 3
#: Directions beyond the wanted ones, and of how many wanted ones the space may hold before it is cut back.
SPARE, SPACE = 4, 5
#: A residual of this part of the largest eigenvalue is double precision; sums of rounded products reach no less.
EXACT = 1e-14
ROUNDS = 60
#: Tasks that add up the sums of all others, where there are more.
FOLD = 32
#: A component with less than this part of the trace holds rounding errors only.
LEAST_SHARE = 1e-13


# --- vectors --------------------------------------------------------------------


def integer_points(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``point``: floor(64 * entry) of every entry as little-endian longs.

    Rows whose vector is null or empty or holds a null, infinite or undefined entry go.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    chosen = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], F.col(f"`{column}`").alias("v"))
    types = [df.schema[k].dataType.simpleString() for k in keep]
    fields = ", ".join([f"{n} {t}" for n, t in zip(names, types)] + ["point binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(len(names))
            offsets = vectors.offsets.to_numpy()
            entries = vectors.values.cast(pa.float64())
            values = entries.fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
            whole &= vectors.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.clip(np.nan_to_num(np.floor(values * SCALE)), -LARGEST, LARGEST).astype("<i8")
            rows = np.flatnonzero(whole)
            points = [scaled[offsets[i] : offsets[i + 1]].tobytes() for i in rows]
            kept = [batch.column(i).take(pa.array(rows)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(points, pa.binary())], [*names, "point"])

    made = chosen.mapInArrow(run, fields)
    return made.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], "point")


def _rows(points: pa.Array, dims: int) -> np.ndarray:
    """The longs of equally long binary values."""
    if not len(points):
        return np.empty((0, dims), np.int64)
    whole = pa.concat_arrays([points])  # without an offset into a larger buffer
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], "<i8", len(whole) * dims, int(offsets[0])).reshape(-1, dims)


class Points:
    """Equally long integer vectors, spread over tasks, and sums over them."""

    def __init__(self, points: DataFrame, dims: int):
        self.points, self.dims = points.select("point"), dims
        self.many = points.rdd.getNumPartitions() > FOLD

    def folded(self, of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over tasks of ``of_rows`` (a float or long array of fixed shape) on all rows.

        Each task adds up its own batches; where there are many tasks, a few add up their sums.
        """
        dims, zero = self.dims, of_rows(np.empty((0, self.dims), np.int64))
        kind, shape = zero.dtype, zero.shape

        def sent(total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = zero
            for batch in batches:
                total = total + of_rows(_rows(batch.column(0), dims))
            yield sent(total)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = zero
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    total = total + np.frombuffer(part, kind).reshape(shape)
            yield sent(total)

        parts = self.points.mapInArrow(add, "part binary")
        if self.many:
            parts = parts.repartition(FOLD).mapInArrow(fold, "part binary")
        return sum((np.frombuffer(row.part, kind).reshape(shape) for row in parts.collect()), zero)

    def moments(self) -> tuple[int, list[int]]:
        """How many rows, and their exact sums by dimension."""

        def sums(rows: np.ndarray) -> np.ndarray:
            low, middle = rows & (1 << PART_BITS) - 1, rows >> PART_BITS & (1 << PART_BITS) - 1
            parts = [x.sum(0) for x in (low, middle, rows >> 2 * PART_BITS)]
            return np.concatenate([[len(rows)], *parts]).astype(np.int64)

        n, *parts = self.folded(sums).tolist()
        d = self.dims
        low, middle, high = parts[:d], parts[d : 2 * d], parts[2 * d :]
        return n, [a + (b << PART_BITS) + (c << 2 * PART_BITS) for a, b, c in zip(low, middle, high)]


# --- Jacobi-Davidson ------------------------------------------------------------

Product = Callable[[np.ndarray], np.ndarray]


def _outside(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """``block`` without what lies in the orthonormal ``bases``; twice, against rounding."""
    for _ in range(2):
        for base in bases:
            block = block - base @ (base.T @ block)
    return block


def _new_directions(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``block`` outside ``bases``; near-zero ones go."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    left, size, _ = np.linalg.svd(_outside(block, *bases), full_matrices=False)
    left = _outside(left[:, size > 1e-8], *bases)
    return np.linalg.qr(left)[0] if left.shape[1] else left


def minres(product: Product, project: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate ``x`` with ``P (A - shift) P x = right`` for each column of ``right``, in as many steps.

    Column by column this is MINRES (Lanczos vectors, plane rotations, smallest
    residual); the columns share each product. ``project`` keeps the search outside the
    estimates, where the shifted operator is not singular.
    """
    tiny = np.finfo(float).tiny
    beta = np.linalg.norm(right, axis=0)
    v, before = right / np.maximum(beta, tiny), np.zeros_like(right)
    x, w, w_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    left, cos, sin = beta.copy(), np.ones((2, right.shape[1])), np.zeros((2, right.shape[1]))
    off = np.zeros_like(beta)
    for _ in range(steps):
        y = project(product(v) - v * shifts) - before * off
        alpha = (v * y).sum(0)
        y = y - v * alpha
        ahead = np.linalg.norm(y, axis=0)
        # The two last rotations act on the new column of the tridiagonal matrix.
        third, mid = sin[0] * off, cos[0] * off
        second, low = cos[1] * mid + sin[1] * alpha, cos[1] * alpha - sin[1] * mid
        size = np.maximum(np.hypot(low, ahead), tiny)
        cos, sin = np.stack([cos[1], low / size]), np.stack([sin[1], ahead / size])
        w, w_before = (v - w * second - w_before * third) / size, w
        x = x + w * (cos[1] * left)
        left = -sin[1] * left
        before, v, off = v, y / np.maximum(ahead, tiny), ahead
    return x


def leading_components(product: Product, dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors (columns).

    ``product`` applies a symmetric operator without negative eigenvalues to the columns
    of a block. Ends when every residual is within ``EXACT`` of the largest eigenvalue,
    or no longer falls because the rounding of the products is reached.
    """
    wanted = min(wanted, dims)
    start = np.random.default_rng(seed).standard_normal((dims, min(dims, wanted + SPARE)))
    space = np.linalg.qr(start)[0]
    image = product(space)
    locked, values = np.empty((dims, 0)), np.empty(0)
    best, stalled = np.inf, 0
    for _ in range(ROUNDS):
        inner = space.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        open_ones = wanted - locked.shape[1]
        residual = _outside(ritz_image[:, :open_ones] - ritz[:, :open_ones] * theta[:open_ones], locked)
        size = np.linalg.norm(residual, axis=0)
        scale = max(theta[0], *values, np.finfo(float).tiny)
        spanned = locked.shape[1] + space.shape[1] == dims
        worst = size.max() / scale
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        floor = EXACT if not (stalled >= 3 and worst < 1e3 * EXACT) else np.inf
        done = size <= floor * scale
        if spanned and stalled >= 2:
            done[:] = True
        # Lock from the largest down, so that nothing larger can appear behind a locked one.
        exact = open_ones if done.all() else int(np.argmin(done))
        locked, values = np.hstack([locked, ritz[:, :exact]]), np.append(values, theta[:exact])
        space, image = ritz[:, exact:], ritz_image[:, exact:]
        if locked.shape[1] == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        residual, shifts, targets = residual[:, exact:], theta[exact:open_ones], ritz[:, exact:open_ones]
        asked = size[exact:] > EXACT * scale
        residual, shifts = residual[:, asked], shifts[asked]
        if space.shape[1] > SPACE * wanted:
            keep = open_ones - exact + wanted
            space, image = space[:, :keep], image[:, :keep]

        def project(block: np.ndarray) -> np.ndarray:
            return _outside(block, locked, targets)

        steps = 0 if space.shape[1] + residual.shape[1] + locked.shape[1] >= dims else INNER_STEPS
        # Without steps the residuals themselves extend the space: all of it is in reach.
        correction = minres(product, project, shifts, -project(residual), steps) if steps else residual
        fresh = _new_directions(correction, locked, space)
        if not fresh.shape[1]:
            # Nothing new from the corrections: refine the images of what is there.
            image = product(space)
            continue
        space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
    raise ArithmeticError(f"residuals of {worst:.1e} after {ROUNDS} rounds")


# --- whitening ------------------------------------------------------------------


def _dims(points: DataFrame) -> int:
    """The length of most points, the larger of equally frequent ones; 0 without points."""
    sizes = points.groupBy(F.length("point").alias("size")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return row["size"] // 8 if row else 0


def whiten(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 16) -> DataFrame:
    """Whitened coordinates of every vector along the leading components of its table.

    Returns the id, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``. Statistics are over each distinct
    vector once, so copies weigh nothing; all rows come back, repeated ones and those
    without an id too. Rows whose vector is null, empty, not finite or not of the usual
    length are dropped. ``deviation`` is null where it does not fit a long. Directions
    without variance are no components: fewer than asked for may come back, none for
    equal vectors. An empty table gives no rows.
    """
    points = integer_points(df.select(id_column, column), column, [id_column])
    distinct = cut_lineage(points.select("point").distinct(), "distinct-points")
    id_type = df.schema[id_column].dataType.simpleString()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = df.sparkSession.createDataFrame([], f"`{id_column}` {id_type}, {schema}")
    dims = _dims(distinct)
    if not dims:
        return nothing
    fit = Points(distinct.where(F.length("point") == 8 * dims), dims)
    n, sums = fit.moments()
    # The mean as a whole number and a fraction: x less the first is exact.
    mean, spare = (np.array(x, np.int64) for x in zip(*(divmod(s, n) for s in sums)))
    rest = spare / n

    def centred(rows: np.ndarray) -> np.ndarray:
        return (rows - mean).astype(float) - rest

    def product(block: np.ndarray) -> np.ndarray:
        block = np.ascontiguousarray(block)

        def of_rows(rows: np.ndarray) -> np.ndarray:
            c = centred(rows)
            return c.T @ (c @ block)

        return fit.folded(of_rows) / n

    trace = float(fit.folded(lambda rows: np.square(centred(rows)).sum(0)).sum() / n)
    values, vectors = leading_components(product, dims, components) if trace > 0 else (np.empty(0), np.empty((dims, 0)))
    real = values > LEAST_SHARE * max(trace, np.finfo(float).tiny)
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    if not k:
        return nothing
    turn = vectors / np.sqrt(values)

    def whitened_products(rows: np.ndarray) -> np.ndarray:
        w = centred(rows) @ turn
        return w.T @ w

    error = float(np.abs(fit.folded(whitened_products) / n - np.eye(k)).max())
    explained = values / trace

    def deviations(rows: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S: in longs where they fit for sure, else in Python's integers."""
        off = rows - mean
        largest = int(np.abs(off).max(initial=0)) * n + n
        if largest * largest * dims < 1 << 63:
            return np.square(off * n - spare).sum(1).tolist()
        whole = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, spare)) for row in off]
        return [d if d < 1 << 63 else None for d in whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1), dims)
            coordinates = centred(rows) @ turn
            made = len(rows) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(made, n)),
                    pa.array(deviations(rows), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(coordinates.ravel()),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(made, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    usual = points.where(F.length("point") == 8 * dims).select(F.col(id_column).alias("id"), "point")
    made = usual.mapInArrow(run, f"id {id_type}, {schema}")
    return made.withColumnRenamed("id", id_column)
