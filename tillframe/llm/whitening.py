"""Whitening of embeddings; the leading components come from FEAST contour integration.

Rows are cut to integers, so counts, sums and products are exact whatever the
number of partitions. The covariance is a matrix of the dimension of the
vectors, whatever their number: Spark sums it, and its eigenvectors are found
beside it. A contour around an interval of eigenvalues is a quadrature of
shifted complex solves; it projects a block of vectors onto the eigenvectors
inside, a Rayleigh-Ritz step takes them apart, and counts of positive pivots at
both ends (inertia) say how many there must be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.llm.common import prepare
from tillframe.sources.storage import materialize

SCALE, OFFSET = 64, 1_000_000  # fixed values: an entry c becomes floor(SCALE * c) + OFFSET
COMPONENTS = 16
LIMIT = 1 << 55  # entries from here on have no 64-bit integer: their rows are not used
NODES = 8  # quadrature points on the upper half of a contour; the lower half is its mirror image
SLICE = 8  # eigenvalues inside one contour, unless they are equal
HALVINGS = 6  # steps towards either end of the gap around a cut
ROUNDS = 12  # projections of one block before it is widened
RANK = 1e-10  # components below this share of the trace have no variance that doubles can tell from none
SAFE = 1 << 53  # whole numbers below this are exact as doubles
HALF = 10**18


def inertia(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of a symmetric matrix above ``shift``.

    Elimination with symmetric pivots of size one and two (the larger of the
    diagonal and the off-diagonal decides); the signs of the pivots are those
    of the eigenvalues.
    """
    a = matrix - shift * np.eye(len(matrix))
    above, ratio = 0, (1 + 17**0.5) / 8
    while len(a):
        diagonal = int(np.argmax(np.abs(np.diag(a))))
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = np.unravel_index(int(np.argmax(off)), off.shape)
        if not off[i, j] and not a[diagonal, diagonal]:
            return above
        if abs(a[diagonal, diagonal]) >= ratio * off[i, j]:
            keep = np.delete(np.arange(len(a)), diagonal)
            pivot, column = a[diagonal, diagonal], a[keep, diagonal]
            above += int(pivot > 0)
            a = a[np.ix_(keep, keep)] - np.outer(column, column) / pivot
        else:  # a pivot of two rows has one eigenvalue on each side
            keep = np.delete(np.arange(len(a)), [i, j])
            pivot, columns = a[np.ix_([i, j], [i, j])], a[np.ix_(keep, [i, j])]
            above += 1
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(pivot, columns.T)
        a = (a + a.T) / 2
    return above


def contour(matrix: np.ndarray, low: float, high: float, block: np.ndarray, nodes: int = NODES) -> np.ndarray:
    """``block`` projected onto the eigenvectors with eigenvalues in (low, high), by Gauss points on a circle."""
    points, weights = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for x, w in zip(points, weights):
        angle = np.pi / 2 * (1 - x)
        turn = np.exp(1j * angle)
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, block.astype(complex))
        out += w / 2 * np.real(radius * turn * solved)
    return out


def inside(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> np.ndarray:
    """The ``count`` eigenvectors (columns) of the eigenvalues in (low, high).

    The block is half as wide again as it must be. It is projected until the
    residuals of exactly ``count`` Ritz pairs inside stand still near rounding;
    a block that does not get there is widened.
    """
    size, scale = len(matrix), np.abs(matrix).sum(axis=1).max()
    width = min(size, count + count // 2 + 2)
    while True:
        block = np.random.default_rng([seed, size, width]).standard_normal((size, width))
        last = np.inf
        for _ in range(ROUNDS):
            basis, weight, _ = np.linalg.svd(contour(matrix, low, high, block), full_matrices=False)
            basis = basis[:, weight > weight[0] * 1e-14]
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)  # Rayleigh-Ritz: a matrix of the width of the block
            block = basis @ turn
            found = np.flatnonzero((values > low) & (values < high))
            gap = np.linalg.norm(matrix @ block[:, found] - block[:, found] * values[found], axis=0)
            # Pairs that only look as if they were inside have residuals of the size of the interval.
            true = found[gap <= 1e-11 * scale]
            worst = gap[gap <= 1e-11 * scale].max(initial=0.0)
            if len(true) == count and (worst <= 1e-15 * scale or worst >= last / 2):
                return block[:, true]
            last = worst if len(true) == count else np.inf
        if width == size:
            raise ArithmeticError("eigenvalues too close to the end of an interval")
        width = min(size, 2 * width)


def intervals(matrix: np.ndarray, count: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) of contours, falling, that hold the ``count`` largest eigenvalues above ``floor``.

    Ends are found by halving with inertia counts and put in the middle of a
    gap. An interval holds up to ``SLICE`` eigenvalues, or more where these
    cannot be told apart.
    """
    bound = np.abs(matrix).sum(axis=1).max() * (1 + 1e-12)
    all_ = inertia(matrix, floor)
    count = min(count, all_)

    def cut(least: int, most: int) -> tuple[float, int] | None:
        """A place with ``least`` to ``most`` eigenvalues above it, if halving meets one."""
        low, high = floor, bound
        while high - low > 1e-12 * bound:
            middle = (low + high) / 2
            n = inertia(matrix, middle)
            if least <= n <= most:
                left = right = middle
                for _ in range(HALVINGS):
                    step = (low + left) / 2
                    low, left = (low, step) if inertia(matrix, step) == n else (step, left)
                    step = (high + right) / 2
                    high, right = (high, step) if inertia(matrix, step) == n else (step, right)
                return (left + right) / 2, n
            low, high = (middle, high) if n > most else (low, middle)
        return None

    out, high, done = [], bound, 0
    while done < count:
        most = done + SLICE
        least = count if count <= most else done + 1
        place = None
        while place is None and most < all_:
            place, most = cut(least, most), most + SLICE
        low, n = place or (floor, all_)
        out.append((low, high, n - done))
        high, done = low, n
    return out


def leading(matrix: np.ndarray, count: int = COMPONENTS, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues above ``floor`` (all, if fewer), falling, and their unit eigenvectors (columns).

    Equal eigenvalues stay in one interval; any basis of theirs is right.
    """
    vectors = [inside(matrix, low, high, n, k) for k, (low, high, n) in enumerate(intervals(matrix, count, floor))]
    if not vectors:
        return np.zeros(0), np.zeros((len(matrix), 0))
    # One more Rayleigh-Ritz step over all intervals makes vectors of neighbouring ones orthogonal to rounding.
    basis, _ = np.linalg.qr(np.hstack(vectors))
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], basis @ turn[:, order]


def usable(vector: Column, limit: int = LIMIT) -> Column:
    """Whether a vector is not null or empty, and all entries are finite and have a 64-bit integer."""
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(limit)))  # NaN is above all
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound, F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _products(rows: np.ndarray) -> np.ndarray:
    """Exact sums of products of integer rows, as Python integers where doubles cannot hold them."""
    high = int(np.abs(rows).max(initial=0))
    if high * high * len(rows) < SAFE:
        return (rows.astype(float).T @ rows.astype(float)).astype(np.int64).astype(object)
    return rows.astype(object).T @ rows.astype(object)


def _totals(rows: np.ndarray) -> np.ndarray:
    if int(np.abs(rows).max(initial=0)) * max(1, len(rows)) < 1 << 62:
        return rows.sum(axis=0).astype(object)
    return rows.astype(object).sum(axis=0)


def exact_sums(fit: DataFrame, dim: int, shape: tuple[int, ...], of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows ``x`` of what ``of_rows`` gives for a batch: whole numbers of any size.

    Every task hands on one row per number, in two parts that decimals can add
    up; only the sums reach the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, object)
        for batch in batches:
            if len(batch):
                total = total + of_rows(_matrix(batch.column(0), dim))
        parts = [divmod(int(v), HALF) for v in total.ravel()]
        columns = [pa.array([str(p[i]) for p in parts], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), *columns], ["k", "high", "low"])

    parts = fit.select("x").mapInArrow(partial, "k int, high string, low string").groupBy("k")
    sums = parts.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    out = np.zeros(int(np.prod(shape)), object)
    for r in sums:
        out[r.k] = int(r.high) * HALF + int(r.low)
    return out.reshape(shape)


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * n * covariance) of the rows ``x`` (arrays of ``dim`` longs), all exact integers.

    Rows are centred at the rounded mean before they are multiplied; what the
    rounding leaves is taken off at the end, in whole numbers.
    """
    first = exact_sums(fit, dim, (dim + 1,), lambda x: np.append(_totals(x), len(x)))
    n, sums = int(first[dim]), [int(s) for s in first[:dim]]
    if not n:
        return 0, sums, [[0] * dim for _ in range(dim)]
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    square = exact_sums(fit, dim, (dim, dim), lambda x: _products(x - centre))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    return n, sums, [[n * square[i][j] - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2; null where a long cannot hold one."""
    high = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if high < 1 << 62:
        gap = x * n - sums.astype(np.int64)
        top = int(np.abs(gap).max(initial=0))
        if top * top * max(1, x.shape[1]) < 1 << 63:
            return (gap * gap).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    ``vectors`` has vec_id and embedding (array of numbers). Rows are not used
    whose vector is null or empty or holds null or non-finite entries or entries of
    ``LIMIT`` and more, nor those of another length than most of the table's
    distinct vectors (the longer on ties). The fit list is each distinct integer
    vector once, so repeated rows and rows that differ by less than the cut do
    not weigh more; all rows are returned, also without or with equal ids. A
    component whose variance is below ``RANK`` of the trace is not returned: with
    one distinct vector there is none, and no row. A deviation that no long holds
    is null. An empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    lengths = fit.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths[0]
    fit = fit.where(F.size("x") == dim)
    n, sums, square = moments(fit, dim)
    matrix = np.array([[float(Fraction(v, n * n)) for v in row] for row in square])
    trace = Fraction(sum(square[i][i] for i in range(dim)), n * n)
    values, axes = leading(matrix, components, RANK * float(trace)) if trace else (np.zeros(0), None)
    if not len(values):
        return spark.createDataFrame([], schema)
    mean_whole = np.array([s // n for s in sums], np.int64)  # the mean in two parts: no digit of it is lost
    mean_rest = np.array([float(Fraction(s % n, n)) for s in sums])
    scale = axes / np.sqrt(values)
    exact = np.array(sums, object)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - mean_whole).astype(float) - mean_rest) @ scale

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(values), len(values)))
        for batch in batches:
            if len(batch):
                y = projected(_matrix(batch.column(0), dim))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel()), pa.array(range(total.size), pa.int32())], ["v", "k"])

    found = fit.select("x").mapInArrow(spread, "v double, k int").groupBy("k").agg((F.sum("v") / n).alias("v"))
    cells = {r.k: r.v for r in found.collect()}  # a matrix of the components
    width = len(values)
    error = max(abs(cells[k] - float(k // width == k % width)) for k in range(width * width))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), dim)
            y = projected(x)
            times = np.repeat(np.arange(len(x)), width)
            number = np.tile(np.arange(width), len(x))
            deviation = pa.array(_deviation(x, n, exact), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()).take(pa.array(times)),
                    pa.array((number + 1).astype(np.int32)),
                    pa.array(np.full(len(times), n, np.int64)),
                    deviation.take(pa.array(times)),
                    pa.array(y.ravel()),
                    pa.array((values / float(trace))[number]),
                    pa.array(np.full(len(times), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == dim).mapInArrow(out, schema)
