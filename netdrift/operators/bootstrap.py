"""Moving-block bootstrap bands of connectedness: replicas are the parallel axis.

Each task takes one panel's packed fit and a chunk of replicas: resample the whitened innovations in blocks, colour
them, simulate, filter again with a diffuse start, decompose. A replica's random stream is keyed by (seed, panel,
replica), so draws do not depend on the partitioning. Bands are exact percentiles over the draws, by Spark; a group has as
many values as replicas. A long run can be drawn in batches that are kept, so that a lost job draws only what is missing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdrift.functions import kernels
from netdrift.session import finished

from . import model
from . import panel as panels

DRAWS = "panel_id string, rep int, t bigint, tci double, net array<double>, pdc array<double>, tci_sub double, net_sub array<double>"


def generator(seed: int, panel_id: str, rep: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(panel_id.encode()) << 32 | rep]))


def draws(panel: DataFrame, replicas: int = 1000, block: int = 20, p: int = 1, kappa1: float = 0.99, kappa2: float = 0.96, horizon: int = 20, sub_nodes: Sequence[str] = (), add_const: bool = True, seed: int = 7, chunk: int = 16, first: int = 0) -> DataFrame:
    """One row per panel, replica (from ``first`` to ``replicas`` - 1) and date. pdc holds the pairs i < j, row by row."""
    wanted = list(sub_nodes)

    def measured(row, reps, ys, xs, sigma0):
        n = ys.shape[2]
        a, big, first = kernels.diffuse_start(ys[:, 0], sigma0, kappa2, n * xs.shape[2])
        g = kernels.kalman(ys, xs, first, a, big, kappa1, kappa2, ("beta", "sigma"), jitter=False)
        mask, (i, j) = np.isin(np.array(row.names), wanted), np.triu_indices(n, 1)
        for b, rep in enumerate(reps):
            share, _, numer = kernels.gfevd(g.beta[b], g.sigma[b], p, horizon)
            found = kernels.indices(share, mask, numer)
            yield pd.DataFrame({"panel_id": row.panel_id, "rep": int(rep), "t": np.arange(ys.shape[1]) + 1, "tci": found["tci"], "net": list(found["net"]), "pdc": list(found["pdc"][:, i, j]), "tci_sub": found["tci_sub"], "net_sub": list(found["net_sub"])})

    return _replicated(panel, measured, DRAWS, replicas, block, p, kappa1, kappa2, add_const, seed, chunk, first)


def resumed_draws(panel: DataFrame, folder: str, replicas: int = 1000, batch: int = 128, **settings: object) -> DataFrame:
    """draws() kept below ``folder`` by batches of replicas: those that a former run has finished are read, the others drawn.

    A batch is finished when its success marker is there; what a broken job left of one is drawn again. Batches are kept apart by
    the settings and by a digest of the panel's rows, so that other data or settings share none, while more replicas
    of the same draw on those that are there. The panel is read for each batch: store what is dear. The caller removes the folder.
    """
    spark = panel.sparkSession
    known = panel.agg(F.count("*"), F.sum(F.xxhash64("panel_id", "series", "ts", "pos", "value").cast("decimal(38,0)"))).first()
    name = hashlib.sha256(repr((tuple(known), sorted(settings.items()))).encode()).hexdigest()[:32]
    paths = []
    for low in range(0, replicas, batch):
        high = min(low + batch, replicas)
        paths.append(f"{folder.rstrip('/')}/{name}/replicas-{low}-{high}")
        if not finished(spark, paths[-1]):
            draws(panel, high, first=low, **settings).write.mode("overwrite").parquet(paths[-1])
    return spark.read.schema(DRAWS).parquet(*paths)


def paths(panel: DataFrame, replicas: int = 1000, block: int = 20, p: int = 1, kappa1: float = 0.99, kappa2: float = 0.96, add_const: bool = True, seed: int = 7, chunk: int = 16) -> DataFrame:
    """The simulated paths alone: panel_id, rep, t, y."""

    def told(row, reps, ys, xs, sigma0):
        for b, rep in enumerate(reps):
            yield pd.DataFrame({"panel_id": row.panel_id, "rep": int(rep), "t": np.arange(ys.shape[1]) + 1, "y": list(ys[b])})

    return _replicated(panel, told, "panel_id string, rep int, t bigint, y array<double>", replicas, block, p, kappa1, kappa2, add_const, seed, chunk)


def _replicated(panel: DataFrame, tell, kind: str, replicas: int, block: int, p: int, kappa1: float, kappa2: float, add_const: bool, seed: int, chunk: int, start: int = 0) -> DataFrame:
    """``tell``'s rows of each panel and chunk of replicas, from paths with resampled innovations.

    A task's chunks come by panel, and the panel's fit is made once for them.
    """
    designs = model.packed_design(panel, p, add_const).join(model.nodes(panel), "panel_id")
    chunks = panel.sparkSession.range(-(-(replicas - start) // chunk)).select((F.col("id") * chunk + start).alias("first"))
    tasks = model.spread(designs.crossJoin(F.broadcast(chunks)), "panel_id", "first").sortWithinPartitions("panel_id", "first")  # panels x chunks of replicas

    def observed(row):
        """The first lags, the prior's covariance, coefficients, roots of the covariances and white innovations."""
        y, x = model.matrix(row.y), model.matrix(row.x)
        _, sigma0, a0, p0 = kernels.ols_prior(y[: model.PRIOR_ROWS], x[: model.PRIOR_ROWS])
        f = kernels.kalman(y, x, sigma0, a0, p0, kappa1, kappa2, ("beta", "s", "innovation"))
        white = np.einsum("tij,tj->ti", kernels.power(f.s[0], -0.5, scaled=True), f.innovation[0])
        return x[0, : y.shape[1] * p].reshape(p, -1), sigma0, f.beta[0], kernels.power(f.s[0], 0.5, scaled=True), white - white.mean(axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        panel_id = None
        for part in batches:
            for row in part.itertuples():
                if row.panel_id != panel_id:
                    panel_id, (lags, sigma0, beta, root, white) = row.panel_id, observed(row)
                reps = np.arange(row.first, min(row.first + chunk, replicas))
                rows = np.stack([kernels.block_rows(generator(seed, panel_id, int(r)), len(white), block) for r in reps])
                shocks = np.einsum("tij,btj->bti", root, white[rows])
                yield from tell(row, reps, *kernels.simulate(beta, shocks, lags, p, add_const), sigma0)

    return tasks.mapInPandas(run, kind)


def bands(drawn: DataFrame, alpha: float = 0.05) -> DataFrame:
    """panel_id, t, metric, key, lo, hi: percentiles, interpolated between order statistics.

    Scalars have key 0; net and pdc count their entries from 0. The band of the reversed pair is (-hi, -lo). All
    metrics of a draw leave its row together, so draws are made once.
    """
    def told(metric: str, values: Column) -> Column:
        return F.transform(values, lambda x, i: F.struct(F.lit(metric).alias("metric"), i.alias("key"), x.alias("value")))

    scalars = [told(m, F.array(m)) for m in ("tci", "tci_sub")]
    long = drawn.select("panel_id", "t", F.explode(F.concat(*scalars, *[told(m, F.col(m)) for m in ("net", "net_sub", "pdc")])).alias("x"))
    return percentile_bands(long.select("panel_id", "t", "x.*"), ["panel_id", "t", "metric", "key"], alpha)


def percentile_bands(rows: DataFrame, by: Sequence[str], alpha: float = 0.05, value: str = "value") -> DataFrame:
    """lo and hi of ``value`` in each group: exact percentiles, interpolated between order statistics."""
    found = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return found.select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def named_bands(found: DataFrame, panel: DataFrame, p: int = 1) -> DataFrame:
    """``bands`` with dates and names: panel_id, ts, metric, node, node2, lo, hi.

    t counts the design's rows, which begin ``p`` dates after the panel's. node and node2 are null for scalars, and
    node2 for net; a pair stands once, with the node that comes first in the panel as node.
    """
    dates = panels.pack(panel).select("panel_id", (F.col("t") - p).alias("t"), "ts").where("t > 0")
    names = model.nodes(panel)
    n = F.size("names")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = found.join(names.withColumn("_pairs", pairs), "panel_id").join(dates, ["panel_id", "t"])
    single, pair = F.col("metric").isin("net", "net_sub"), F.col("metric") == "pdc"
    at = F.col("_pairs")[F.col("key")]
    node = F.when(single, F.col("names")[F.col("key")]).when(pair, F.col("names")[at["i"]])
    return rows.select("panel_id", "ts", "metric", node.alias("node"), F.when(pair, F.col("names")[at["j"]]).alias("node2"), "lo", "hi")


def resampled_rows(packed: DataFrame, replicas: int, block: int, seed: int = 7) -> DataFrame:
    """panel_id, rep, t, source: which row each resampled row is, for checks and for joins to wide tables."""
    sizes = packed.groupBy("panel_id").agg(F.max("t").cast("int").alias("steps"))
    tasks = sizes.crossJoin(F.broadcast(packed.sparkSession.range(replicas).select(F.col("id").cast("int").alias("rep"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples():
                yield pd.DataFrame({"panel_id": r.panel_id, "rep": r.rep, "t": np.arange(r.steps) + 1, "source": kernels.block_rows(generator(seed, r.panel_id, int(r.rep)), r.steps, block) + 1})

    return tasks.mapInPandas(run, "panel_id string, rep int, t bigint, source bigint")
