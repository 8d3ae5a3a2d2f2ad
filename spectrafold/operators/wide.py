"""Sums of outer products, factors and components of vectors, summed in tasks and met in trees.

Vectors are arrays of one length; rows whose vector is null, of another length, or holds a null or NaN, are left out. A task
adds up its rows and hands on rows of a matrix as arrays, which are summed by place; only what a result needs comes to the
driver. principal() never forms a matrix of the dimension squared, so it is the one for wide vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of the matrices that a task holds; beyond, it hands them on.
HELD = 1 << 23
#: Rows of a batch that are multiplied at a time, by the dimension.
AT_ONCE = 1 << 20


def whole(vector: str, dimension: int) -> Column:
    v = F.col(vector).cast("array<double>")
    return (F.size(v) == dimension) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e))


def parts(batch: pa.RecordBatch, column: int, dimension: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of a batch and their vectors as a matrix."""
    step = max(1, AT_ONCE // max(1, dimension))
    for lo in range(0, batch.num_rows, step):
        some = batch.column(column).slice(lo, step)
        yield slice(lo, lo + len(some)), some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), dimension)


def summed(rows: DataFrame, group: Column, vector: str, dimension: int, product: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> DataFrame:
    """g, i, sums: row i of the sum over a group's vectors of product(matrix of vectors), a height x width matrix."""
    names = ["g", "i", "sums"]

    def hand(held: dict) -> Iterator[pa.RecordBatch]:
        for g, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * height, pa.int64()), pa.array(range(height), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(height + 1) * width, pa.int32()), pa.array(m.ravel()))], names)
        held.clear()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, v in parts(batch, 1, dimension):
                for g in np.unique(ids[at]):
                    own = product(v[ids[at] == g])
                    held[g] = held[g] + own if g in held else own
                if len(held) * height * width > HELD:
                    yield from hand(held)
        yield from hand(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().reshape(-1, width)
            for g, i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values):
                held[g, i] = held[g, i] + own if (g, i) in held else own.copy()
        if held:
            ends = pa.array(np.arange(len(held) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(list(held.values()))))], names)

    schema = "g long, i int, sums array<double>"
    picked = rows.where(whole(vector, dimension)).select(group.cast("long").alias("g"), F.col(vector).cast("array<double>").alias("v")).where("g IS NOT NULL")
    return picked.mapInArrow(add, schema).repartition("g", "i").mapInArrow(meet, schema)


def gathered(sums: DataFrame, height: int, width: int) -> dict[int, np.ndarray]:
    """The matrices by group, on the driver; a row of it is one row."""
    found: dict[int, np.ndarray] = {}
    for g, i, own in sums.collect():
        found.setdefault(g, np.zeros((height, width)))[i] = own
    return found


def outer_sums(rows: DataFrame, group: Column, vector: str, dimension: int) -> DataFrame:
    return summed(rows, group, vector, dimension, lambda v: v.T @ v, dimension, dimension)


def mapped(rows: DataFrame, vector: str, dimension: int, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows with the vector changed, in Arrow batches; a vector that is left out elsewhere becomes null."""
    names, at = rows.columns, rows.columns.index(vector)
    picked = rows.withColumn(vector, F.when(whole(vector, dimension), F.col(vector).cast("array<double>")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.array(batch.column(at).is_valid())
            full = batch.filter(pa.array(good))
            done = [change(v) for _, v in parts(full, at, dimension)]
            values = np.concatenate(done) if done else np.empty((0, 0))
            ends = np.concatenate(([0], np.cumsum(good * values.shape[1])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([lists if k == at else batch.column(k) for k in range(len(names))], names)

    return picked.mapInArrow(run, kinds)


def projected(rows: DataFrame, vector: str, weights: np.ndarray, offset: np.ndarray | None = None) -> DataFrame:
    """The vector, less an offset, times each column of a matrix."""
    shift = np.zeros(len(weights)) if offset is None else offset
    return mapped(rows, vector, len(weights), lambda v: (v - shift) @ weights)


def triangle(rows: DataFrame, vector: str, dimension: int, fan: int = 16) -> np.ndarray:
    """R of the rows' QR, signs so that its diagonal isn't negative: each task factors its rows, then `fan` factors at a time meet.

    As accurate as the vectors themselves, where the sums of products would lose half the digits.
    """

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = np.zeros((0, dimension))
        for batch in batches:
            for _, v in parts(batch, batch.num_columns - 1, dimension):
                held = np.linalg.qr(np.vstack([held, v]), "r")
        if len(held):
            ends = pa.array(np.arange(len(held) + 1) * dimension, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(held), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(held.ravel()))], ["part", "v"])

    schema = "part long, v array<double>"
    found = rows.where(whole(vector, dimension)).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(factor, schema)
    n = found.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan)
        found = found.repartition(n, F.floor(F.col("part") / fan)).mapInArrow(factor, schema)
    r = np.array([row["v"] for row in found.collect()]).reshape(-1, dimension)
    r = np.linalg.qr(r, "r") if len(r) > dimension else r
    r = np.vstack([r, np.zeros((dimension - len(r), dimension))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def mean(rows: DataFrame, vector: str, dimension: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and their mean."""
    sums = summed(rows, F.lit(0), vector, dimension, lambda v: np.append(v.sum(0), len(v))[None], 1, dimension + 1)
    own = gathered(sums, 1, dimension + 1).get(0, np.zeros((1, dimension + 1)))[0]
    return int(own[-1]), own[:-1] / max(own[-1], 1)


def principal(rows: DataFrame, vector: str, dimension: int, count: int, more: int = 10, rounds: int = 30, tolerance: float = 1e-9, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (columns, by falling variance; the largest entry of each is positive) and their variances.

    A randomised range finder: count + more directions are carried through the data until the variances stand still. A round is
    one pass that adds up dimension x directions; nothing of the dimension squared is made. With as many directions as
    dimensions the result is exact. No vector gives no component.
    """
    n, middle = mean(rows, vector, dimension)
    width = min(dimension, count + more)
    if not n:
        return middle, np.zeros((dimension, 0)), np.zeros(0)
    basis, last = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, width)))[0], None

    def through(directions: np.ndarray) -> np.ndarray:
        sums = summed(rows, F.lit(0), vector, dimension, lambda v: (v - middle).T @ ((v - middle) @ directions), dimension, width)
        return gathered(sums, dimension, width)[0]

    for _ in range(rounds if width < dimension else 0):
        basis, r = np.linalg.qr(through(basis))
        now = np.sort(np.abs(np.diag(r)))[::-1][:count]
        if last is not None and np.all(np.abs(now - last) <= tolerance * now.max()):
            break
        last = now
    r = triangle(projected(rows.select(vector), vector, basis, middle), vector, width)
    _, s, turn = np.linalg.svd(r)
    found = (basis @ turn.T)[:, :count]
    return middle, found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])]), s[:count] ** 2 / n


def canonical(rows: DataFrame, x: str, y: str, dx: int, dy: int, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of x and of y (columns) and their correlations, falling: pairs of directions that vary together most.

    From QR of the two sides beside each other, centred; ridge is added to either side's variances. Directions that a side does
    not have (rank) get the correlation 0.
    """
    both = rows.where(whole(x, dx) & whole(y, dy)).select(F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("v"))
    n, middle = mean(both, "v", dx + dy)
    r = triangle(projected(both, "v", np.eye(dx + dy), middle), "v", dx + dy) / max(n, 1) ** 0.5
    left, right = r[:, :dx], r[:, dx:]

    def root(side: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(side.T @ side + ridge * np.eye(side.shape[1]))
        good = values > 1e-12 * max(values.max(), 1e-300)
        return np.where(good, vectors / np.sqrt(np.where(good, values, 1)), 0)

    wx, wy = root(left), root(right)
    u, s, vt = np.linalg.svd((left @ wx).T @ (right @ wy))
    k = min(dx, dy)
    return wx @ u[:, :k], wy @ vt.T[:, :k], np.minimum(s[:k], 1)


#: Weights of samples from their distance to the matrix (x' C^-1 x), the number of samples and the dimension.
WEIGHTS: dict[str, Callable[[np.ndarray, np.ndarray, float, int, int], np.ndarray]] = {
    "sign": lambda distance, square, parameter, n, d: 1 / np.where(square > 0, square, 1),
    "power": lambda distance, square, parameter, n, d: np.maximum(distance, 2.0**-52) ** (parameter - 2) / 2,
    "bounded": lambda distance, square, parameter, n, d: np.minimum(1, parameter**2 * d / n / np.maximum(distance, 1e-300)),
    "cut": lambda distance, square, parameter, n, d: (distance <= parameter**2 * d / n).astype(float),
}


def robust_covariance(rows: DataFrame, group: Column, vector: str, dimension: int, how: str, parameter: float, rounds: int = 10, tolerance: float = 1e-5) -> dict[int, tuple[np.ndarray, int]]:
    """Of each group (integer) the sum of outer products, weighted again and again by WEIGHTS, and the rounds taken.

    The sums are scaled to as many samples as there are. sign puts all samples on a sphere; power is an M-estimator of a norm;
    bounded and cut take samples beyond so many standard deviations down to the bound, or out. A weight is a function of the
    matrix of the round before, so no weights are stored: a round is one pass, which also adds up the change of the weights,
    and a group whose weights change by less than the tolerance, as a share of them, stands still.
    """
    first = gathered(summed(rows, group, vector, dimension, lambda v: np.vstack([v.T @ v, np.full((1, dimension), len(v))]), dimension + 1, dimension), dimension + 1, dimension)
    n_of = {g: int(m[-1, 0]) for g, m in first.items()}
    now = {g: m[:-1] for g, m in first.items()}
    before: dict[int, np.ndarray] = {}
    done: dict[int, tuple[np.ndarray, int]] = {}
    weigh = WEIGHTS[how]

    for k in range(1, rounds + 1):
        inverse = {g: np.linalg.pinv(m) for g, m in now.items()}

        def add(v: np.ndarray, inverse=inverse, before=before) -> np.ndarray:
            g, v = int(v[0, 0]), v[:, 1:]
            square, n = (v * v).sum(1), n_of[g]
            w = weigh(((v @ inverse[g]) * v).sum(1), square, parameter, n, dimension)
            old = weigh(((v @ before[g]) * v).sum(1), square, parameter, n, dimension) if g in before else np.ones(len(v))
            # Below the matrix a row of the weights' sum and one of their change.
            return np.vstack([(v * w[:, None]).T @ v, np.full((1, dimension), w.sum()), np.full((1, dimension), np.abs(w - old).sum())])

        if not now:
            break
        marked = rows.where(group.cast("long").isin(list(now))).select(group.cast("long").alias("_g"), F.concat(F.array(group.cast("double")), F.col(vector).cast("array<double>")).alias("_v"))
        sums = gathered(summed(marked, F.col("_g"), "_v", dimension + 1, add, dimension + 2, dimension), dimension + 2, dimension)
        for g, m in sums.items():
            total, change = m[-2, 0], m[-1, 0]
            before[g] = inverse[g]
            now[g] = m[:-2] * n_of[g] / (total or 1.0)
            done[g] = (now[g], k)
            if change <= tolerance * abs(total):
                del now[g]
        before = dict(before)
    return done


def market_shrunk(rows: DataFrame, vector: str, dimension: int) -> tuple[np.ndarray, float]:
    """The covariance shrunk towards a model of one factor, the mean of a vector's entries, and how far (0 to 1).

    As far as the noise of the covariances and of the model says (Ledoit and Wolf, 2003): one pass for the means, one for
    products of centred entries, of their squares and of the factor. No vector: no covariance (zeros). Entries or a
    factor without variance leave the covariance as it is.
    """
    n, middle = mean(rows, vector, dimension)
    if not n:
        return np.zeros((dimension, dimension)), 0.0

    def products(v: np.ndarray) -> np.ndarray:
        x = v - middle
        market = x.mean(1)[:, None]
        squares, turned = x * x, x * market
        single = [x.T @ market, market.T @ market, (squares.sum(1) ** 2).sum(keepdims=True)[None], (squares * squares).sum(keepdims=True)]
        tail = np.zeros((4, dimension))
        tail[0], tail[1:, 0] = single[0].ravel(), [float(np.sum(one)) for one in single[1:]]
        return np.vstack([x.T @ x, squares.T @ turned, turned.T @ turned, tail])

    sums = gathered(summed(rows, F.lit(0), vector, dimension, products, 3 * dimension + 4, dimension), 3 * dimension + 4, dimension)[0] / n
    sample, third, fourth = (sums[k * dimension : (k + 1) * dimension] for k in range(3))
    shared, (variance, whole, single) = sums[-4], sums[-3:, 0]
    if variance <= 0:
        return sample, 0.0
    model = np.outer(shared, shared) / variance
    np.fill_diagonal(model, np.diag(sample))
    off = ~np.eye(dimension, dtype=bool)
    distance = ((sample - model) ** 2).sum()
    noise = whole - (sample**2).sum()
    # How the model's noise goes with that of the covariances: on the diagonal they are one.
    with_diagonal = single - (np.diag(sample) ** 2).sum()
    first = (third - shared[:, None] * sample) * shared[None, :]
    second = (fourth - variance * sample) * np.outer(shared, shared)
    together = with_diagonal + 2 * first[off].sum() / variance - second[off].sum() / variance**2
    amount = min(1.0, max(0.0, (noise - together) / distance / n)) if distance > 0 else 0.0
    return amount * model + (1 - amount) * sample, float(amount)
