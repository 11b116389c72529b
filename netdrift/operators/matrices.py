"""Batched matrix jobs over tables of row-major matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netdrift.functions import kernels
from netdrift.session import stored

from .sums import array_sums, on_blocks


def square(column: pd.Series) -> np.ndarray:
    flat = np.stack([np.asarray(x, float) for x in column]) if len(column) else np.empty((0, 1))
    n = int(round(flat.shape[1] ** 0.5))
    return flat.reshape(len(flat), n, n)


def second_moments(rows: DataFrame, by: str, column: str = "u") -> DataFrame:
    """``by``, m: the mean outer product (row-major) of the vectors of each group."""

    def sums(own: pd.DataFrame) -> np.ndarray:
        x = np.stack([np.asarray(v, float) for v in own[column]])
        return np.r_[float(len(x)), (x.T @ x).ravel()]

    return array_sums(rows.select(by, column), by, sums).select(by, F.transform(F.slice("s", 2, F.size("s")), lambda v: v / F.col("s")[0]).alias("m"))


def positive_definite(matrices: DataFrame, column: str = "m", tol_symmetry: float = 1e-8, tol_eigen: float = 1e-10) -> DataFrame:
    """``matrices`` with ok, least_eigenvalue and reason; all matrices of a partition have one size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                ok, least, reason = kernels.is_positive(square(rows[column]), tol_symmetry, tol_eigen)
                yield rows.assign(ok=ok, least_eigenvalue=least, reason=reason)

    kinds = ", ".join(f"`{n}` {k}" for n, k in matrices.dtypes)
    return matrices.mapInPandas(run, f"{kinds}, ok boolean, least_eigenvalue double, reason string")


def whiten(rows: DataFrame, u: str = "u", sigma: str = "sigma", method: str = "zca", jitter: float = 1e-10, scaled: bool = False, center: bool = True, keys: str = "panel_id", sigmas: DataFrame | None = None, on: str = "panel_id") -> DataFrame:
    """``rows`` with w = sigma^(-1/2) u, by eigenvalues; with ``center`` minus its mean over the panel.

    A row's matrix is its column ``sigma`` (a fit has one for every date), or, with ``sigmas``, the column ``sigma`` of
    the row of ``sigmas`` with the same ``on``: such shared matrices are decomposed once each and travel once a block of rows.
    ``scaled`` sets the jitter relative to the mean variance (the bootstrap's variant).
    """
    found = _multiplied(rows, u, sigma, "w", -0.5, jitter, scaled, method, sigmas, on)
    if not center:
        return found
    long = found.select(keys, F.posexplode("w").alias("_i", "_v")).groupBy(keys, "_i").agg(F.avg("_v").alias("_m"))
    means = long.groupBy(keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("_means"))
    return found.join(means, keys).withColumn("w", F.zip_with("w", "_means", lambda a, b: a - b)).drop("_means")


def colour(rows: DataFrame, w: str = "w", sigma: str = "sigma", jitter: float = 1e-10, sigmas: DataFrame | None = None, on: str = "panel_id") -> DataFrame:
    """``rows`` with v = sigma^(1/2) w; ``sigmas`` and ``on`` as in whiten()."""
    return _multiplied(rows, w, sigma, "v", 0.5, jitter, True, "zca", sigmas, on)


def powers(sigmas: DataFrame, on: str, sigma: str, exponent: float, jitter: float, scaled: bool, method: str) -> DataFrame:
    """``on``, power: each matrix of ``sigmas`` decomposed once. Written, so that it is made once and Spark knows its size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({on: part[on], "power": [x.ravel() for x in kernels.power(square(part[sigma]), exponent, jitter, scaled, method=method)]})

    return stored(sigmas.select(on, sigma).mapInPandas(run, f"`{on}` {dict(sigmas.dtypes)[on]}, power array<double>"), "powers")


def _multiplied(rows: DataFrame, vector: str, matrix: str, name: str, exponent: float, jitter: float, scaled: bool, method: str, sigmas: DataFrame | None, on: str) -> DataFrame:
    if sigmas is not None:
        return on_blocks(rows, on, powers(sigmas, on, matrix, exponent, jitter, scaled, method), "power", vector, name, lambda x, p: x @ p.reshape(x.shape[1], -1).T)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                power = kernels.power(square(part[matrix]), exponent, jitter, scaled, method=method)
                yield part.assign(**{name: list(np.einsum("tij,tj->ti", power, np.stack([np.asarray(x, float) for x in part[vector]])))})

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, `{name}` array<double>")
