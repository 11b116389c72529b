"""Time-varying VARs: prior, filter, likelihood grids, search and choice of hyper-parameters, connectedness.

The filter is sequential in time, so a task holds one panel (packed into one row of arrays) and a chunk of
configurations; panels and chunks are the parallel axes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netdrift.functions import kernels, stats

from . import panel as panels

PRIOR_ROWS = 250


def packed_design(panel: DataFrame, p: int = 1, add_const: bool = True, skip: int | None = None) -> DataFrame:
    """One row per panel: panel_id, p, ts, y, x (arrays over the rows of the design, with t > ``skip``)."""
    rows = panels.lagged_design(panels.pack(panel), p, add_const)
    rows = rows if skip is None else panels.common_sample(rows, skip)
    one = rows.groupBy("panel_id").agg(F.array_sort(F.collect_list(F.struct("t", "ts", "y", "x"))).alias("r"))
    return one.select("panel_id", F.lit(p).alias("p"), F.transform("r", lambda r: r["ts"]).alias("ts"), F.transform("r", lambda r: r["y"]).alias("y"), F.transform("r", lambda r: r["x"]).alias("x"))


def spread(tasks: DataFrame, *columns: str) -> DataFrame:
    """Dealt to a fixed number of partitions: rows are few and small but dear, and should not be gathered by their bytes."""
    return tasks.repartition(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def matrix(cell) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in cell])


def ols_prior(designs: DataFrame, rows: int | None = PRIOR_ROWS) -> DataFrame:
    """b, sigma0, a0, p0 of each panel from its first ``rows`` design rows (all: None)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [kernels.ols_prior(matrix(y)[:rows], matrix(x)[:rows]) for y, x in zip(part["y"], part["x"], strict=True)]
            yield pd.DataFrame({"panel_id": part["panel_id"], **{n: [f[i].ravel() for f in found] for i, n in enumerate(("b", "sigma0", "a0", "p0"))}})

    return designs.select("panel_id", "y", "x").mapInPandas(run, "panel_id string, b array<double>, sigma0 array<double>, a0 array<double>, p0 array<double>")


FIT = "panel_id string, ts date, t bigint, beta array<double>, sigma array<double>, sigma_before array<double>, y_pred array<double>, loglik double, s array<double>, innovation array<double>"


def fit(designs: DataFrame, kappa1: float = 0.99, kappa2: float = 0.96, keep: Sequence[str] = (), slice_rows: int = 512) -> DataFrame:
    """The filter's history, one row per panel and date; ``keep`` may add gain, p_filt, p_pred.

    The prior is from the first rows of the design. sigma_before is the covariance one step back (the prior's
    first). History leaves in slices of dates. Designs with columns kappa1 and kappa2 (chosen_designs) take their own.
    """
    extra = [c for c in ("gain", "p_filt", "p_pred") if c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                y, x = matrix(row.y), matrix(row.x)
                _, sigma0, a0, p0 = kernels.ols_prior(y[:PRIOR_ROWS], x[:PRIOR_ROWS])
                f = kernels.kalman(y, x, sigma0, a0, p0, getattr(row, "kappa1", kappa1), getattr(row, "kappa2", kappa2), ("beta", "sigma", "y_pred", "s", "innovation", *extra))
                before = np.concatenate([sigma0[None], f.sigma[0, :-1]])
                for a in range(0, len(y), slice_rows):
                    cut = slice(a, a + slice_rows)
                    columns = {"beta": f.beta[0], "sigma": f.sigma[0], "sigma_before": before, "y_pred": f.y_pred[0], "loglik": f.loglik[0], "s": f.s[0], "innovation": f.innovation[0], **{c: getattr(f, c)[0] for c in extra}}
                    flat = {n: v[cut] if n == "loglik" else list(v[cut].reshape(len(v[cut]), -1)) for n, v in columns.items()}
                    yield pd.DataFrame({"panel_id": row.panel_id, "ts": row.ts[cut], "t": np.arange(a, min(a + slice_rows, len(y))) + 1, **flat})

    return spread(designs, "panel_id").mapInPandas(run, ", ".join([FIT, *[f"{c} array<double>" for c in extra]]))


def predictions(fitted: DataFrame, design: DataFrame) -> DataFrame:
    """Residuals with the filtered coefficients: e = y - B_t x, from the fit joined to the design rows, beside the one-step innovation."""
    n, k = F.size("y"), F.size("x")
    rows = fitted.join(design.select("panel_id", "ts", "y", "x"), ["panel_id", "ts"])
    row = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.zip_with(F.slice("beta", i * k + 1, k), "x", lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v))
    return rows.select("panel_id", "ts", "t", "innovation", "s", F.zip_with("y", row, lambda a, b: a - b).alias("residual"))


def likelihoods(designs: DataFrame, configurations: DataFrame, chunk: int = 32) -> DataFrame:
    """loglik, aic, t_eff of each (panel, p, kappa1, kappa2), with the prior from the whole sample; no history is kept.

    Points go in chunks, joined to the packed panels by p.
    """
    at = Window.partitionBy("p").orderBy("kappa2", "kappa1")
    chunks = configurations.withColumn("_c", F.floor((F.row_number().over(at) - 1) / chunk)).groupBy("p", "_c").agg(F.collect_list(F.struct("kappa1", "kappa2")).alias("points"))
    tasks = spread(designs.join(F.broadcast(chunks), "p"), "panel_id", "p", "_c")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                y, x = matrix(row.y), matrix(row.x)
                _, sigma0, a0, p0 = kernels.ols_prior(y, x)
                k1, k2 = (np.array([q[c] for q in row.points]) for c in ("kappa1", "kappa2"))
                total = kernels.kalman(y, x, sigma0, a0, p0, k1, k2).loglik.sum(axis=1)
                yield pd.DataFrame({"panel_id": row.panel_id, "p": row.p, "kappa1": k1, "kappa2": k2, "loglik": total, "aic": aic(total, y.shape[1], x.shape[1]), "t_eff": len(y)})

    return tasks.mapInPandas(run, "panel_id string, p int, kappa1 double, kappa2 double, loglik double, aic double, t_eff int")


def aic(loglik, n: int, k: int):
    return -2 * loglik + 2 * (n * k + n * (n + 1) / 2)


def all_designs(panel: DataFrame, orders: Sequence[int], add_const: bool = True) -> DataFrame:
    """Packed designs of every lag order, on the rows that the largest has."""
    found = [packed_design(panel, p, add_const, max(orders)) for p in orders]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def grid_search(designs: DataFrame, orders: Sequence[int], kappa1: Sequence[float], kappa2: Sequence[float]) -> DataFrame:
    """The likelihoods of all p x kappa1 x kappa2, kappa1 fastest, on the designs of ``all_designs``."""
    points = designs.sparkSession.createDataFrame([(p, a, b) for p in orders for b in kappa2 for a in kappa1], "p int, kappa1 double, kappa2 double")
    return likelihoods(designs, points)


def starts(n: int, low: float, high: float, seed: int, corners: bool = True) -> list[tuple[float, float]]:
    """The box's corners and centre, and ``n`` uniform points from ``seed``."""
    fixed = [(a, b) for a in (low, high) for b in (low, high)] + [((low + high) / 2,) * 2] if corners else []
    return fixed + [tuple(x) for x in np.random.default_rng(seed).uniform(low, high, (n, 2))]


def descend(value, points: np.ndarray, low: float, high: float, steps: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compass search in a box from many points at once: best points, values, success, iterations.

    Each round values four neighbours of every open point in one call; a point moves to its best one, or halves
    its step, and is done when the step is under ``tol``.
    """
    points, step = points.copy(), np.full(len(points), (high - low) / 4)
    best = value(points)
    open_, rounds = np.isfinite(best), np.zeros(len(points), int)
    moves = np.array([[1, 0], [-1, 0], [0, 1], [0, -1]], float)
    for _ in range(steps):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        rounds[at] += 1
        tried = np.clip(points[at, None] + step[at, None, None] * moves, low, high)
        found = np.where(np.isfinite(v := value(tried.reshape(-1, 2)).reshape(-1, 4)), v, np.inf)
        way = found.argmin(axis=1)
        better = found[np.arange(len(at)), way] < best[at] - 1e-12
        points[at[better]] = tried[better, way[better]]
        best[at[better]] = found[better, way[better]]
        step[at[~better]] /= 2
        open_[at] = step[at] > tol
    return points, best, np.isfinite(best) & ~open_, rounds


def continuous_search(designs: DataFrame, low: float = 0.94, high: float = 0.99, n_starts: int = 20, seed: int = 123, maxiter: int = 200, tol: float = 1e-4, corners: bool = True) -> DataFrame:
    """The least AIC over (kappa1, kappa2) in the box, one row per panel and p of ``all_designs``; a start that fails is
    left out, and where all fail the centre stands with a null aic. One task holds a panel and an order, its starts batched."""
    designs = spread(designs, "panel_id", "p")
    first = np.array(starts(n_starts, low, high, seed, corners))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                y, x = matrix(row.y), matrix(row.x)
                _, sigma0, a0, p0 = kernels.ols_prior(y, x)

                def value(points, y=y, x=x, sigma0=sigma0, a0=a0, p0=p0):
                    return aic(kernels.kalman(y, x, sigma0, a0, p0, points[:, 0], points[:, 1]).loglik.sum(axis=1), y.shape[1], x.shape[1])

                at, best, done, rounds = descend(value, first, low, high, maxiter, tol)
                i = int(np.where(np.isfinite(best), best, np.inf).argmin())
                good = bool(np.isfinite(best[i]))
                centre = (low + high) / 2
                yield pd.DataFrame([[row.panel_id, row.p, *(at[i] if good else (centre, centre)), best[i] if good else None, len(y), bool(done[i]), int(rounds[i])]],
                                   columns=["panel_id", "p", "kappa1", "kappa2", "aic", "t_eff", "opt_success", "opt_nit"])

    return designs.mapInPandas(run, "panel_id string, p int, kappa1 double, kappa2 double, aic double, t_eff int, opt_success boolean, opt_nit int")


P_VALUES = ["p_hmean", "p_harch", "p_norm", "p_mskew", "p_mkurt", "p_lm"]


def diagnose(grid: DataFrame, designs: DataFrame, top: int = 20) -> DataFrame:
    """``grid`` with six p-values of the whitened innovations of each panel's ``top`` candidates by AIC.

    ``grid`` is from grid_search or continuous_search on the same ``designs``, and both are read twice: store what
    is dear. Ties go by p, kappa1, kappa2. A candidate that fails stays untested, as do the others.
    """
    rank = Window.partitionBy("panel_id").orderBy(F.col("aic").asc_nulls_last(), "p", "kappa1", "kappa2")
    chosen = grid.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top).select("panel_id", "p", "kappa1", "kappa2")
    tasks = spread(chosen.join(designs, ["panel_id", "p"]), "panel_id", "p", "kappa1", "kappa2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                try:
                    y, x = matrix(row.y), matrix(row.x)
                    _, sigma0, a0, p0 = kernels.ols_prior(y, x)
                    f = kernels.kalman(y, x, sigma0, a0, p0, row.kappa1, row.kappa2, ("s", "innovation"))
                    w = np.einsum("tij,tj->ti", kernels.power(f.s[0], -0.5), f.innovation[0])
                    w = w - w.mean(axis=0)
                    skew = stats.mardia(w)
                    p = [stats.hosking(w)[1], stats.hosking(w**2)[1], stats.joint_jarque_bera(w), skew[1], skew[3], stats.autocorrelation_lr(w)[1]]
                except (np.linalg.LinAlgError, ValueError, FloatingPointError):
                    continue
                yield pd.DataFrame([[row.panel_id, row.p, row.kappa1, row.kappa2, *p]], columns=["panel_id", "p", "kappa1", "kappa2", *P_VALUES])

    tested = tasks.mapInPandas(run, "panel_id string, p int, kappa1 double, kappa2 double, " + ", ".join(f"{c} double" for c in P_VALUES))
    joined = grid.join(tested.withColumn("tested", F.lit(True)), ["panel_id", "p", "kappa1", "kappa2"], "left")
    return joined.withColumn("tested", F.coalesce("tested", F.lit(False)))


def choose(diagnosed: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per panel the least AIC among the tested with both Hosking p above ``alpha``, else the least AIC of all."""
    passed = F.col("tested") & (F.coalesce("p_hmean", F.lit(0.0)) > alpha) & (F.coalesce("p_harch", F.lit(0.0)) > alpha) & ~F.isnan("p_hmean") & ~F.isnan("p_harch")
    rows = diagnosed.withColumn("passed", F.coalesce(passed, F.lit(False)))
    order = Window.partitionBy("panel_id").orderBy(F.desc("passed"), F.col("aic").asc_nulls_last(), "p", "kappa1", "kappa2")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def nodes(panel: DataFrame) -> DataFrame:
    """panel_id, names: the series in the order of pos."""
    rows = panel.select("panel_id", "pos", "series").distinct()
    return rows.groupBy("panel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "series"))), lambda x: x["series"]).alias("names"))


THETA = "panel_id string, ts date, theta array<double>, theta_g array<double>"


def theta(fitted: DataFrame, p: int = 1, horizon: int = 20, sigma: str = "sigma_before", shards: int | None = None) -> DataFrame:
    """theta and theta_g of each date, row-major: dates are independent, so any partitioning will do."""
    rows = fitted.select("panel_id", "ts", "beta", F.col(sigma).alias("sigma"))
    rows = rows if shards is None else rows.repartition(shards)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            sizes = part["sigma"].map(len)
            for size in sizes.unique():
                own = part[sizes == size]
                n = int(round(size**0.5))
                share, raw, _ = kernels.gfevd(matrix(own["beta"]), matrix(own["sigma"]).reshape(-1, n, n), p, horizon)
                yield pd.DataFrame({"panel_id": own["panel_id"], "ts": own["ts"], "theta": list(share.reshape(len(own), -1)), "theta_g": list(raw.reshape(len(own), -1))})

    return rows.mapInPandas(run, THETA)


MEASURED = "panel_id string, ts date, tci double, to_idx array<double>, from_idx array<double>, net_idx array<double>, tci_sub double, net_sub array<double>, theta array<double>"


def measures(fitted: DataFrame, names: DataFrame, p: int = 1, horizon: int = 20, sigma: str = "sigma_before", sub_nodes: Sequence[str] = ()) -> DataFrame:
    """One row per panel and date: theta (row-major) and all its indices as arrays in the order of ``names``, which is
    kept as a column; tci_sub and net_sub are of the network among ``sub_nodes`` alone (0 outside and without any).

    A name that a panel lacks is an error. ``names`` may have a column p: each panel's own lag order.
    """
    wanted = list(sub_nodes)
    rows = fitted.select("panel_id", "ts", "beta", F.col(sigma).alias("sigma")).join(names, "panel_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for panel_id, own in part.groupby("panel_id", sort=False):
                known = list(own["names"].iloc[0])
                if missing := set(wanted) - set(known):
                    raise ValueError(f"no such node in {panel_id}: {sorted(missing)}")
                n, order = len(known), int(own["p"].iloc[0]) if "p" in own else p
                share, _, numer = kernels.gfevd(matrix(own["beta"]), matrix(own["sigma"]).reshape(-1, n, n), order, horizon)
                found = kernels.indices(share, np.isin(known, wanted), numer)
                yield pd.DataFrame({"panel_id": panel_id, "ts": own["ts"].to_numpy(), "tci": found["tci"], "to_idx": list(found["to"]), "from_idx": list(found["from"]), "net_idx": list(found["net"]),
                                    "tci_sub": found["tci_sub"], "net_sub": list(found["net_sub"]), "theta": list(share.reshape(len(own), -1)), "names": [known] * len(own)})

    return rows.mapInPandas(run, MEASURED + ", names array<string>")


def node_indices(measured: DataFrame) -> DataFrame:
    """panel_id, ts, node, to_idx, from_idx, net_idx, net_sub and the date's tci and tci_sub."""
    columns = ["to_idx", "from_idx", "net_idx", "net_sub"]
    rows = measured.select("panel_id", "ts", "tci", "tci_sub", F.explode(F.arrays_zip("names", *columns)).alias("x"))
    return rows.select("panel_id", "ts", F.col("x.names").alias("node"), *[F.col("x")[c].alias(c) for c in columns], "tci", "tci_sub")


def theta_long(thetas: DataFrame, names: DataFrame) -> DataFrame:
    """panel_id, ts, to_node, from_node, theta, theta_g."""
    rows = thetas.join(names, "panel_id").select("panel_id", "ts", "names", F.posexplode(F.arrays_zip("theta", "theta_g")).alias("_i", "_x"))
    n = F.size("names")
    return rows.select("panel_id", "ts", F.col("names")[F.floor(F.col("_i") / n).cast("int")].alias("to_node"), F.col("names")[F.col("_i") % n].alias("from_node"), F.col("_x.theta").alias("theta"), F.col("_x.theta_g").alias("theta_g"))


def phi(fitted: DataFrame, n: int, p: int = 1, horizon: int = 20) -> DataFrame:
    """Moving-average coefficients of the VAR frozen at each date: panel_id, ts, h, phi (row-major)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                beta = matrix(part["beta"])
                found = kernels.moving_average(beta, n, beta.shape[1] // n, p, horizon).reshape(len(part), horizon, -1)
                yield pd.DataFrame({"panel_id": np.repeat(part["panel_id"].to_numpy(), horizon), "ts": np.repeat(part["ts"].to_numpy(), horizon), "h": np.tile(np.arange(horizon), len(part)), "phi": list(found.reshape(len(part) * horizon, -1))})

    return fitted.select("panel_id", "ts", "beta").mapInPandas(run, "panel_id string, ts date, h int, phi array<double>")


def connectedness(panel: DataFrame, p: int = 1, kappa1: float = 0.99, kappa2: float = 0.96, horizon: int = 20, add_const: bool = True) -> DataFrame:
    """theta_long from end to end: design, prior, filter, covariance one step back, decomposition."""
    return theta_long(theta(fit(packed_design(panel, p, add_const), kappa1, kappa2), p, horizon), nodes(panel))


def connectedness_indices(panel: DataFrame, p: int = 1, kappa1: float = 0.99, kappa2: float = 0.96, horizon: int = 20, add_const: bool = True, sub_nodes: Sequence[str] = ()) -> DataFrame:
    """node_indices from end to end, with one filter and one decomposition for all of them."""
    fitted = fit(packed_design(panel, p, add_const), kappa1, kappa2)
    return node_indices(measures(fitted, nodes(panel), p, horizon, sub_nodes=sub_nodes))


def chosen_designs(panel: DataFrame, chosen: DataFrame, add_const: bool = True, orders: Sequence[int] = (1, 2)) -> DataFrame:
    """Packed designs with kappa1 and kappa2, each panel at its own order: ``chosen`` (panel_id, p, kappa1, kappa2) of choose().

    A panel is packed once, for its order alone, over all the rows that this order leaves. Panels without a choice, or with an
    order outside ``orders``, take no part. ``chosen`` is read once for each order: store what is dear.
    """
    found = None
    for p in sorted(set(orders)):
        own = chosen.where(F.col("p") == p).select("panel_id", "kappa1", "kappa2")
        some = packed_design(panel.join(own, "panel_id", "left_semi"), p, add_const).join(own, "panel_id")
        found = some if found is None else found.unionByName(some)
    return found


def chosen_indices(panel: DataFrame, chosen: DataFrame, horizon: int = 20, add_const: bool = True, sub_nodes: Sequence[str] = (), orders: Sequence[int] = (1, 2)) -> DataFrame:
    """node_indices from end to end, each panel with its own p, kappa1 and kappa2 of ``chosen`` (see chosen_designs)."""
    names = nodes(panel).join(chosen.select("panel_id", "p"), "panel_id")
    return node_indices(measures(fit(chosen_designs(panel, chosen, add_const, orders)), names, horizon=horizon, sub_nodes=sub_nodes))
