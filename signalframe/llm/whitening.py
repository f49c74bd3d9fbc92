"""Whitening of embeddings: distributed centred covariance, eigenvectors of the tridiagonal form, projection of every row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import discard, materialize

COMPONENTS = 16
#: Vectors become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this are no whole numbers of 64 bits with room for the shift.
LARGEST = 2.0**62


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite and of a size that can be scaled to whole numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# --- eigenvectors of a symmetric matrix, whose size is the dimension of the vectors -------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of a Householder reduction of the symmetric v."""
    a, reflectors = v.copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        u = np.zeros_like(x)
        if size > 0 and np.abs(x[1:]).max() > 0:
            u = x / size
            u[0] += np.copysign(np.sqrt(u @ u), u[0])
            u /= np.sqrt(u @ u)
            rest = a[k + 1 :, k + 1 :]
            w = rest @ u
            w -= (u @ w) * u
            rest -= 2 * (np.outer(u, w) + np.outer(w, u))
            x -= 2 * (u @ x) * u
            a[k + 1 :, k] = a[k, k + 1 :] = x
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number of `at`, by the signs of a Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = np.append(0.0, off**2)
    pivot, count = np.ones_like(at), np.zeros(len(at), np.int64)
    for d, e in zip(diagonal, squares, strict=True):
        pivot = d - at - e / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    reach = np.append(0, np.abs(off)) + np.append(np.abs(off), 0)
    wanted = len(diagonal) - 1 - np.arange(k)  # so many lie below the eigenvalue
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    high += np.spacing(np.maximum(np.abs(high), np.abs(low))) * 4
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        under = below(diagonal, off, middle) > wanted
        low, high = np.where(under, low, middle), np.where(under, middle, high)
    return low + (high - low) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, value: float, b: np.ndarray, floor: float) -> np.ndarray:
    """x with (T - value) x = b, by elimination with row exchanges; pivots are at least `floor`."""
    n = len(diagonal)
    d, up, upper, x = diagonal - value, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(d[i]) >= abs(low):
            d[i] = d[i] if abs(d[i]) > floor else np.copysign(floor, d[i])
            m = low / d[i]
            d[i + 1] -= m * up[i]
            x[i + 1] -= m * x[i]
        else:
            m = d[i] / low
            d[i], d[i + 1], up[i], next_up = low, up[i] - m * d[i + 1], d[i + 1], up[i + 1]
            upper[i], up[i + 1] = next_up, -m * next_up
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
    d[-1] = d[-1] if abs(d[-1]) > floor else np.copysign(floor, d[-1])
    for i in range(n - 1, -1, -1):
        rest = (up[i] * x[i + 1] if i + 1 < n else 0.0) + (upper[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - rest) / d[i]
        most = np.abs(x[i:]).max()
        if most > 1e200:
            x /= most
    return x


def components(v: np.ndarray, k: int, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of the symmetric v: at most k, those above `least` times the largest.

    Householder's reduction, Sturm counts with bisection, and inverse iteration, whose vectors are made orthogonal to those of close
    eigenvalues after every step. The largest entry of a vector (the first of equal ones) is positive.
    """
    n = len(v)
    size = np.abs(v).max() if n else 0.0
    if not size > 0:
        return np.empty(0), np.empty((0, n))
    diagonal, off, reflectors = tridiagonal(v / size)
    values = leading(diagonal, off, min(k, n))
    values = values[values > least * values[0]]
    norm = (np.abs(diagonal) + np.append(0, np.abs(off)) + np.append(np.abs(off), 0)).max()
    eps = np.finfo(float).eps
    rng, vectors = np.random.default_rng(7), np.empty((len(values), n))
    start, shift = 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            start = i
        shift = min(value, shift - 10 * eps * norm) if i > start else value  # equal values get shifts of their own
        x = rng.standard_normal(n)
        for _ in range(5):
            x = solved(diagonal, off, shift, x / np.sqrt(x @ x), eps * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                for y in vectors[start:i]:
                    x -= (x @ y) * y
        vectors[i] = x / np.sqrt(x @ x)
    for k_, u in reversed(list(enumerate(reflectors))):
        vectors[:, k_ + 1 :] -= 2 * np.outer(vectors[:, k_ + 1 :] @ u, u)
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    sign = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
    return values * size, vectors * np.where(sign < 0, -1.0, 1.0)[:, None]


# --- sums over all rows ------------------------------------------------------------------------------------------


def summed(parts: DataFrame, salts: int = 64) -> dict[int, np.ndarray]:
    """Sums of the arrays of doubles `v` by the row number `i` of parts (i, salt, v): first by salt, then over salts."""

    def add(table: pa.Table) -> pa.Table:
        total = matrix(table.column("v").combine_chunks()).sum(0)
        return pa.table({"i": table.column("i")[:1], "salt": pa.array([0], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    schema = "i int, salt int, v array<double>"
    first = parts.withColumn("salt", F.pmod("salt", F.lit(salts))).groupBy("i", "salt").applyInArrow(add, schema)
    return {r.i: np.array(r.v) for r in first.groupBy("i").applyInArrow(add, schema).collect()}


def products(rows: DataFrame, project, part: str = "x") -> dict[int, np.ndarray]:
    """Rows of the matrix sum of z z' over the vectors z = project(block of vectors); a partition emits its own sum once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                z = project(matrix(batch.column(0)))
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(len(total)), pa.int32()),
                "salt": pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()),
                "v": pa.array(list(total), pa.list_(pa.float64())),
            })

    return summed(rows.select(part).mapInArrow(run, "i int, salt int, v array<double>"))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, max_dims: int = 4096) -> DataFrame:
    """One row per remaining row of `rows` and component up to k: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows take part whose vector usable() accepts and whose length is the commonest (of ties the greater). Entries become
    whole numbers x; the fit is over the distinct vectors x, so copies weigh nothing. Count, sums and deviations are exact.

    The fit list is grouped before it is shuffled and written once; sums, covariance (centred on exact sums before multiplying) and the check
    of the result are one partial matrix per partition, added up by row in two steps. The driver holds matrices of the
    vectors' dimension only, at most max_dims (an error beyond), and broadcasts k components. Each row is projected where it lies.

    Null and repeated ids are rows like others. Components whose eigenvalue is not above 1e-10 of the largest are rounding, not directions, and are
    left out: fewer distinct vectors or constant dimensions give fewer than k components, and a table with fewer than two
    distinct vectors, or an empty one, gives no rows. A deviation beyond 64 bits is null. No other column is looked at.
    """
    spark = rows.sparkSession
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("c")).where(usable(F.col("c")))
    lengths = good.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], SCHEMA)
    dims = lengths.d
    if dims > max_dims:
        raise ValueError(f"vectors of {dims} entries: the covariance is solved on the driver for at most {max_dims}")
    x = F.transform("c", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    whole = good.where(F.size("c") == dims).select("vec_id", x.alias("x"))
    fit = materialize(whole.select("x").distinct())

    sums = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()
    n, totals = sums[0].n, [int(r.s) for r in sorted(sums, key=lambda r: r.i)]

    def centred(block: np.ndarray) -> tuple[np.ndarray, np.ndarray | list]:
        """x - S / n as doubles, and the exact squared length of n * x - S."""
        bits = max(int(np.abs(block).max()), 1).bit_length() + n.bit_length() + 1
        if max(bits, *(abs(t).bit_length() for t in totals)) < 62:
            far = n * block - np.array(totals, np.int64)
            if int(np.abs(far).max()) ** 2 * dims < 2**63:
                return far / n, (far * far).sum(1)
        far = n * block.astype(object) - np.array(totals, object)
        squares = [int(s) if s < 2**63 else None for s in (far * far).sum(1)]
        return (far / n).astype(float), squares

    summed_squares = products(fit, lambda block: centred(block)[0])
    covariance = np.stack([summed_squares[i] for i in range(dims)]) / n
    values, vectors = components((covariance + covariance.T) / 2, k)
    if not len(values):
        discard(fit)
        return spark.createDataFrame([], SCHEMA)
    projection = spark.sparkContext.broadcast((vectors / np.sqrt(values)[:, None]).T.copy())
    again = products(fit, lambda block: centred(block)[0] @ projection.value)
    discard(fit)
    error = float(np.abs(np.stack([again[i] for i in range(len(values))]) / n - np.eye(len(values))).max())
    explained = values / np.trace(covariance)
    found = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                ids, block = batch.column(0).slice(at, 8192), matrix(batch.column(1).slice(at, 8192))
                z, squares = centred(block)
                m = len(block)
                each = np.repeat(np.arange(m), found)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * found, n, np.int64)),
                    "deviation": pa.array(squares, pa.int64()).take(pa.array(each)),
                    "whitened": pa.array((z @ projection.value).ravel()),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * found, error)),
                })

    return whole.mapInArrow(project, SCHEMA)
