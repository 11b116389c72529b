"""Whitening of embeddings: covariance by distributed sums, eigenvectors by tridiagonal methods, projection by blocks.

Each component c of a vector becomes x = floor(scale * c) + shift, a whole number. The fit list is each distinct vector
x once. Its sums S are exact; with them a second pass adds up (x - S / n)(x - S / n)' (centred before multiplying)
task by task. The covariance, whose size depends on the vectors' length alone, is reduced to a tridiagonal matrix by
Householder reflections; its leading eigenvalues are found by bisection over Sturm counts, all at once, their vectors by
inverse iteration, made orthogonal within clusters, and carried back by the reflections. The components are joined to
blocks of rows, broadcast where they are proven small, and each block is projected by one product.

Defined cases: vectors that are null or empty, or hold a null or a non-finite component, take no part. Vectors of
different lengths are fitted each on those of their length. Components whose eigenvalue is at most 1e-11 of the largest (fewer
distinct vectors than components, constant columns) have no direction and are left out, so that a single distinct vector
gives no rows. Numbers beyond +-2^40 after scaling stand at that bound. Rows that repeat are rows each; a null id is
kept as it is. ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdrift.operators.sums import array_sums, blocks_of

from .common import Steps

BOUND = 1 << 40
#: Components of at most so many bytes are broadcast; others are joined to blocks by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Eigenvalues nearer than this share of the largest form a cluster.
CLUSTER = 1e-3
#: Smallest eigenvalue that counts, by the largest.
LEAST = 1e-11


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflection vectors of a symmetric matrix by Householder's method."""
    a, d = np.array(a, float), len(a)
    reflections = []
    for i in range(d - 2):
        column = a[i + 1 :, i]
        v = column.copy()
        v[0] += np.copysign(np.linalg.norm(column), column[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        reflections.append(v)
        rest = a[i + 1 :, i + 1 :]
        p = rest @ v
        q = p - (v @ p) * v
        a[i + 1 :, i + 1 :] = rest - 2 * np.outer(v, q) - 2 * np.outer(q, v)
        column -= 2 * v * (v @ column)  # a view: what is left of it is one entry
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def carried_back(y: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (columns) of the tridiagonal matrix as those of the matrix it came from."""
    y = y.copy()
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        y[i + 1 :] -= 2 * np.outer(v, v @ y[i + 1 :])
    return y


def _below(diagonal: np.ndarray, squares: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues are below each of ``x``: the negative terms of the Sturm sequence."""
    count, q = np.zeros(len(x), int), np.ones_like(x)
    for d, e in zip(diagonal, np.r_[0.0, squares], strict=True):
        q = d - x - e / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected between Gershgorin's bounds until its ends are neighbours."""
    d = len(diagonal)
    reach = np.r_[np.abs(off), 0.0] + np.r_[0.0, np.abs(off)]
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    scale = max(abs(low), abs(high), np.finfo(float).tiny)
    tiny, squares = np.finfo(float).eps ** 2 * scale, off * off
    wanted = d - 1 - np.arange(k)  # eigenvalue number, from 0 upwards
    a, b = np.full(k, low - 1e-15 * scale), np.full(k, high + 1e-15 * scale)
    while True:
        middle = 0.5 * (a + b)
        if ((middle <= a) | (middle >= b) | (b - a <= 1e-16 * scale)).all():
            return middle
        over = _below(diagonal, squares, middle, tiny) > wanted
        a, b = np.where(over, a, middle), np.where(over, middle, b)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = b by elimination with row exchanges; pivots of nothing become ``tiny``."""
    n = len(diagonal)
    main, upper, second, y = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        low = float(off[i])
        if abs(low) > abs(main[i]):  # the next row has the larger pivot
            main[i], low, upper[i], main[i + 1] = low, main[i], main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        pivot = main[i] if abs(main[i]) > tiny else tiny
        main[i], part = pivot, low / pivot
        main[i + 1] -= part * upper[i]
        upper[i + 1] -= part * second[i]
        y[i + 1] -= part * y[i]
    for i in range(n - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > tiny else tiny
        y[i] = (y[i] - (upper[i] * y[i + 1] if i + 1 < n else 0.0) - (second[i] * y[i + 2] if i + 2 < n else 0.0)) / pivot
    return np.array(y)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) for falling ``values``; those of a cluster are made orthogonal to each other as they grow."""
    rng, n = np.random.default_rng(7), len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    tiny = np.finfo(float).eps * scale
    out, first = np.zeros((n, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * scale:
            first = k
        shift = value - (k - first) * 4 * np.finfo(float).eps * scale  # equal values are told apart
        y = rng.standard_normal(n)
        for _ in range(4):
            y = _solved(diagonal, off, shift, y / np.linalg.norm(y), tiny)
            y /= np.linalg.norm(y)
            for _ in range(2):
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
                y /= np.linalg.norm(y)
        out[:, k] = y
    return out


def eigenpairs(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` largest eigenvalues of a covariance, falling, and unit eigenvectors as rows; those without variance go."""
    k = min(k, len(cov))
    if not np.trace(cov) > 0:
        return np.zeros(0), np.zeros((0, len(cov)))
    diagonal, off, reflections = tridiagonal(cov)
    values = leading_values(diagonal, off, k)
    values = values[values > LEAST * values[0]]
    vectors = carried_back(inverse_iteration(diagonal, off, values), reflections).T
    return values, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def whole_numbers(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * component) + shift as longs; null where the vector takes no part."""
    double = F.transform(vector, lambda x: x.cast("double"))
    good = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(BOUND)), F.lit(-BOUND))
    return F.when(good, F.transform(double, lambda x: held(x).cast("long") + F.lit(shift).cast("long")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x) for x in column])


def _block(rows: np.ndarray) -> np.ndarray:
    return np.array([r["x"] for r in rows])


def fitted(rows: DataFrame, components: int) -> tuple[DataFrame, Steps]:
    """dim, n, s (the sums S), w (components by rows, over the roots of their eigenvalues), explained, identity_error:
    one written row for each length of vectors, and the steps to drop once it is no longer read."""
    steps = Steps(rows.sparkSession)
    listed = steps(rows.select("dim", "x").distinct(), "whitening-fit")
    blocks = blocks_of(listed, "dim")
    sums = array_sums(listed, "dim", lambda own: np.r_[len(own), _matrix(own["x"]).sum(axis=0)], "bigint")
    sums = steps(sums.select("dim", F.col("s")[0].alias("n"), F.slice("s", 2, F.size("s")).alias("sums")), "whitening-sums")

    def centred(own: pd.DataFrame) -> Iterator[np.ndarray]:
        for block, n, s in zip(own["rows"], own["n"], own["sums"], strict=True):
            yield _block(block) - np.asarray(s, float) / n

    def products(own: pd.DataFrame) -> np.ndarray:
        return np.sum([d.T @ d for d in centred(own)], axis=0)

    def whitened(own: pd.DataFrame) -> Iterator[np.ndarray]:
        for d, w in zip(centred(own), own["w"], strict=True):
            yield d @ np.asarray(w).reshape(-1, d.shape[1]).T

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                cov = np.asarray(r.s).reshape(r.dim, r.dim) / r.n
                values, vectors = eigenpairs((cov + cov.T) / 2, components)
                yield pd.DataFrame({"dim": [r.dim], "n": [r.n], "sums": [r.sums], "w": [(vectors / np.sqrt(values)[:, None]).ravel()], "explained": [values / np.trace(cov)]})

    kind = "dim int, n bigint, sums array<bigint>, w array<double>, explained array<double>"
    covariances = array_sums(blocks.join(sums, "dim"), "dim", products)
    found = steps(covariances.join(sums, "dim").select("dim", "n", "sums", "s").mapInPandas(solve, kind).where(F.size("explained") > 0), "whitening-components")
    known = blocks.join(found, "dim")
    means = steps(array_sums(known, "dim", lambda own: np.sum([w.sum(axis=0) for w in whitened(own)], axis=0)).withColumnRenamed("s", "mean"), "whitening-means")

    def identity(own: pd.DataFrame) -> np.ndarray:
        parts = [w - np.asarray(m) / n for w, m, n in zip(whitened(own), own["mean"], own["n"], strict=True)]
        return np.sum([w.T @ w for w in parts], axis=0)

    def error(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            square = [np.asarray(s).reshape(len(e), -1) / n - np.eye(len(e)) for s, e, n in zip(batch["s"], batch["explained"], batch["n"], strict=True)]
            yield batch.drop(columns="s").assign(identity_error=[float(np.abs(x).max()) for x in square])

    checked = array_sums(known.join(means, "dim"), "dim", identity).join(found, "dim").select("s", *found.columns)
    return steps(checked.mapInPandas(error, f"{kind}, identity_error double"), "whitening-model"), steps


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of (n x - S)^2, exact: in longs where they fit, else in Python's numbers; None beyond a long."""
    rough = n * x.astype(float) - sums
    if len(x) and np.abs(rough).max() < 2**29 and (rough**2).sum(axis=1).max() < 2**62 and n * np.abs(x).max() < 2**62:
        d = n * x - sums
        return (d * d).sum(axis=1).tolist()
    found = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in found]


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = vectors.select(F.col(id_column).alias("id"), whole_numbers(F.col(vector_column), scale, shift).alias("x")).where(F.col("x").isNotNull())
    rows = rows.withColumn("dim", F.size("x").cast("int"))
    model, steps = fitted(rows, components)
    model = steps.keep(model)
    size = model.agg(F.sum(8 * (F.size("w") + F.size("sums"))).alias("b")).first()["b"] or 0
    table = F.broadcast(model) if size <= BROADCAST_BYTES else model
    known = blocks_of(rows, "dim").join(table, "dim").drop("dim")
    kind = vectors.select(F.col(id_column)).dtypes[0][1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at] for c in batch.schema.names}
                block, n, sums = r["rows"].values, r["n"].as_py(), r["sums"].values.to_numpy()
                x = block.field("x").flatten().to_numpy().reshape(len(block), -1)
                w, explained = r["w"].values.to_numpy().reshape(-1, x.shape[1]), r["explained"].values.to_numpy()
                k = len(explained)
                each = np.repeat(np.arange(len(x)), k)
                made = {
                    "id": block.field("id").take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(each), n)), "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(((x - sums / n) @ w.T).ravel()), "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(each), r["identity_error"].as_py())),
                }
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    out = known.mapInArrow(project, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_column)


def whiten_brute(x: np.ndarray, components: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """n, deviations, whitened (signs are free) and explained of whole numbers x by a dense decomposition, for tests."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    d = fit - sums / n
    values, vectors = np.linalg.eigh(d.T @ d / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > LEAST * values[0]
    values, vectors = values[keep], vectors[:, keep]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (x - sums / n) @ vectors / np.sqrt(values), values / (d * d).sum() * n
