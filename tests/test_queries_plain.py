"""Registered queries that SQL cannot express, on the given small tables, against plain loops over a panel's rows."""

import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F
from test_kernels import plain_gfevd, plain_kalman

from netdrift.functions import kernels, stats
from netdrift.operators import bootstrap, model, panel
from netdrift.plans import queries
from netdrift.sources import panels

SF = "/root/testdata/sf0.001"
ONE = "NATION_3"


DONE: dict = {}


def rows(spark, name, of=ONE):
    if name not in DONE:
        DONE[name] = [r.asDict(recursive=True) for r in queries.QUERIES[name](spark, SF).where(F.col("panel_id") == of).collect()]
    return DONE[name]


@pytest.fixture(scope="module")
def y(spark):
    found = panel.pack(panels.nation_panels(spark, SF)).where(F.col("panel_id") == ONE).collect()
    return np.array([r["y"] for r in sorted(found, key=lambda r: r["t"])])


@pytest.fixture(scope="module")
def series(spark):
    found = panels.nation_panels(spark, SF).where(F.col("panel_id") == ONE).collect()
    out = {}
    for r in sorted(found, key=lambda r: r["t"]):
        out.setdefault(r["series"], []).append(r["value"])
    return {k: np.array(v) for k, v in out.items()}


def design(y, p, skip=None):
    skip = p if skip is None else skip
    x = np.array([np.r_[y[t - p : t][::-1].ravel(), 1.0] for t in range(skip, len(y))])
    return y[skip:], x


def prior(y, x):
    b = np.linalg.lstsq(x, y, rcond=None)[0].T
    e = y - x @ b.T
    sigma0 = e.T @ e / len(y)
    return sigma0, b.ravel(), 10 * np.kron(sigma0, np.linalg.pinv(x.T @ x))


@pytest.fixture(scope="module")
def fitted(y):
    own, x = design(y, 1)
    sigma0, a0, p0 = prior(own[:250], x[:250])
    return own, x, sigma0, plain_kalman(own, x, sigma0, a0, p0, 0.99, 0.96)


def test_filter_and_predictions(spark, fitted):
    own, x, sigma0, (beta, sigma, loglik, s, v) = fitted
    found = {r["t"]: r for r in rows(spark, "k02_filter")}
    assert len(found) == len(own)
    for t in range(len(own)):
        for c, want in (("loglik", loglik[t]), ("beta", beta[t].sum()), ("sigma", sigma[t].sum()), ("s", s[t].sum()), ("innovation", v[t].sum())):
            assert math.isclose(found[t + 1][c], want, rel_tol=1e-6, abs_tol=2e-6)
    before = np.concatenate([[sigma0], sigma[:-1]])
    for r in rows(spark, "c12_sigma_before"):
        assert np.allclose([r["sigma"], r["sigma_before"]], [sigma[r["t"] - 1][0, 0], before[r["t"] - 1][0, 0]], atol=2e-6)
    for r in rows(spark, "k09_predictions"):
        t, i = r["t"] - 1, r["i"]
        assert np.allclose([r["innovation"], r["residual"]], [v[t][i], own[t][i] - beta[t].reshape(5, 6)[i] @ x[t]], atol=2e-6)


def test_connectedness(spark, fitted):
    own, _, sigma0, (beta, sigma, *_) = fitted
    before = np.concatenate([[sigma0], sigma[:-1]])
    names, dates = sorted({r["node"] for r in rows(spark, "c11_connectedness")}), {}
    for r in rows(spark, "c11_connectedness"):
        dates.setdefault(r["ts"], {})[r["node"]] = r
    sub = {(r["ts"], r["node"]): r for r in rows(spark, "c08_fitted_sub_network")}
    long, same, phi = {}, {}, {}
    for r in rows(spark, "c02_gfevd"):
        long.setdefault(r["ts"], {})[r["to_node"], r["from_node"]] = r
    for r in rows(spark, "c09_gfevd_same_date"):
        same.setdefault(r["ts"], {})[r["to_node"], r["from_node"]] = r["theta"]
    for r in rows(spark, "c01_moving_average"):
        phi[r["ts"], r["h"]] = r
    chosen = np.isin(names, ["1-URGENT", "3-MEDIUM", "5-LOW"])
    for t, ts in enumerate(sorted(dates)):
        if t % 20:  # every 20th date of the panel, to keep the plain loops short
            continue
        theta, raw = plain_gfevd(beta[t], before[t] + 0, 1, 20) if np.diag(before[t]).min() > 1e-9 else (None, None)
        if theta is None or not np.isfinite(theta).all():
            continue
        off = theta - np.diag(np.diag(theta))
        for i, node in enumerate(names):
            r = dates[ts][node]
            assert np.allclose([r["to_idx"], r["from_idx"], r["net_idx"], r["tci"]], np.array([off[:, i].sum(), off[i].sum(), off[:, i].sum() - off[i].sum(), off.sum()]) * 20, atol=1e-4)
            for j, other in enumerate(names):
                assert np.allclose([long[ts][node, other]["theta"], long[ts][node, other]["theta_g"]], [theta[i, j], raw[i, j]], atol=1e-5)
        inner = theta[np.ix_(chosen, chosen)]
        inner = inner / inner.sum(axis=1, keepdims=True)
        inner -= np.diag(np.diag(inner))
        nets = (inner.sum(axis=0) - inner.sum(axis=1)) * 100 / 3
        assert np.allclose([sub[ts, n]["net_sub"] for n in np.array(names)[chosen]], nets, atol=1e-4) and abs(sub[ts, names[0]]["tci_sub"] - inner.sum() * 100 / 3) < 1e-4
        if np.diag(sigma[t]).min() > 1e-9:
            now = plain_gfevd(beta[t], sigma[t], 1, 20)[0]
            assert all(abs(same[ts][a, b] - now[i, j]) < 1e-5 for i, a in enumerate(names) for j, b in enumerate(names))
        a, power = beta[t].reshape(5, 6)[:, :5], np.eye(5)
        for h in range(20):
            assert math.isclose(phi[ts, h]["total"], power.sum(), rel_tol=1e-5, abs_tol=2e-6) and math.isclose(phi[ts, h]["size"], np.abs(power).sum(), rel_tol=1e-5, abs_tol=2e-6)
            power = a @ power


def test_search_and_diagnosis(spark, y):
    grid = {(r["p"], r["kappa1"], r["kappa2"]): r for r in rows(spark, "k05_grid_search")}
    one = {(r["kappa1"], r["kappa2"]): r["loglik"] for r in rows(spark, "k03_loglik")}
    assert len(grid) == 32 and len(one) == 16
    for p, k1, k2 in [(1, 0.94, 0.94), (1, 0.99, 0.96), (2, 0.96, 0.99)]:
        own, x = design(y, p, 2)
        loglik = plain_kalman(own, x, *prior(own, x), k1, k2)[2].sum()
        r = grid[p, k1, k2]
        assert r["t_eff"] == len(own) and math.isclose(r["loglik"], loglik, rel_tol=1e-6) and math.isclose(r["aic"], -2 * loglik + 2 * (5 * (5 * p + 1) + 15), rel_tol=1e-6)
    own, x = design(y, 1)
    loglik = plain_kalman(own, x, *prior(own, x), 0.99, 0.96)[2].sum()
    assert math.isclose(one[0.99, 0.96], loglik, rel_tol=1e-6) and math.isclose(rows(spark, "k04_aic")[0]["aic"], -2 * loglik + 90, rel_tol=1e-6)

    told = {(r["p"], r["kappa1"], r["kappa2"]): r for r in rows(spark, "k07_diagnose")}
    best = sorted(grid, key=lambda k: (grid[k]["aic"], k))
    assert {k for k in told if told[k]["tested"]} <= set(best[:20])
    tested = next(k for k in best if told[k]["tested"])
    own, x = design(y, tested[0], 2)
    _, _, _, s, v = plain_kalman(own, x, *prior(own, x), *tested[1:])
    w = []
    for t in range(len(own)):
        e, q = np.linalg.eigh((s[t] + s[t].T) / 2 + 1e-10 * np.eye(5))
        w.append(q @ np.diag(np.maximum(e, 1e-12) ** -0.5) @ q.T @ v[t])
    w = np.array(w) - np.mean(w, axis=0)
    r = told[tested]
    wanted = {"p_hmean": stats.chi2_tail(plain.hosking(w, 10), 250), "p_harch": stats.chi2_tail(plain.hosking(w**2, 10), 250), "p_lm": stats.chi2_tail(plain.autocorrelation_lr(w, 5), 125), "p_mskew": stats.chi2_tail(plain.mardia(w)[0], 35)}
    assert all(abs(r[c] - p) < 1e-4 for c, p in wanted.items())
    passed = [k for k in best if told[k]["tested"] and told[k]["p_hmean"] > 0.05 and told[k]["p_harch"] > 0.05]
    chosen = rows(spark, "k08_choose")[0]
    assert (chosen["p"], chosen["kappa1"], chosen["kappa2"]) == (passed or best)[0]
    searched = {r["p"]: r for r in rows(spark, "k06_continuous_search")}
    assert set(searched) == {1, 2} and all(searched[p]["aic"] <= min(grid[k]["aic"] for k in grid if k[0] == p) + 1e-6 for p in (1, 2) if searched[p]["aic"] is not None)


def test_connectedness_of_the_choice(spark):
    """c11_chosen is the connectedness of a panel at the values that k08_choose names for it."""
    chosen = rows(spark, "k08_choose")[0]
    one = panels.nation_panels(spark, SF).where(F.col("panel_id") == chosen["panel_id"])
    want = {(r["ts"], r["node"]): r for r in model.connectedness_indices(one, chosen["p"], chosen["kappa1"], chosen["kappa2"]).collect()}
    got = {(r["ts"], r["node"]): r for r in rows(spark, "c11_chosen") if r["panel_id"] == chosen["panel_id"]}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(abs(got[k][c] - want[k][c]) < 1e-6 for k in got for c in ("to_idx", "from_idx", "net_idx", "tci"))


def test_unit_roots(spark, series):
    for name, lag in (("t01_adf", True), ("t03_phillips_perron", False)):
        for r in rows(spark, name):
            if r["stat"] is None:
                assert r["error"]
                continue
            x = series[r["series"]]
            d, lags = np.diff(x), r["lags"] if lag else 0
            target = d[lags:] if lag else x[1:]
            z = np.array([np.r_[x[t], d[t - lags : t][::-1], 1.0] for t in range(lags, len(d))])
            b, *_ = np.linalg.lstsq(z, target, rcond=None)
            e = target - z @ b
            se = math.sqrt(e @ e / (len(target) - z.shape[1]) * np.linalg.pinv(z.T @ z)[0, 0])
            stat = b[0] / se
            if not lag:
                size, l2 = len(target), r["lags"]
                gamma = [e[k:] @ e[: size - k] / size for k in range(l2 + 1)]
                lam = gamma[0] + 2 * sum((1 - k / (l2 + 1)) * gamma[k] for k in range(1, l2 + 1))
                stat = math.sqrt(gamma[0] / lam) * (b[0] - 1) / se - (lam - gamma[0]) / (2 * math.sqrt(lam)) * size * se / math.sqrt(e @ e / (size - 2))
            assert math.isclose(r["stat"], stat, rel_tol=1e-5, abs_tol=1e-5)
    for r in rows(spark, "t02_kpss"):
        if r["stat"] is None:
            continue
        x = series[r["series"]]
        e, lags = x - x.mean(), r["lags"]
        long_run = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / len(x)
        assert math.isclose(r["stat"], (np.cumsum(e) ** 2).sum() / len(x) ** 2 / long_run, rel_tol=1e-5)
    each = {(n, r["series"]): r for n in ("t01_adf", "t02_kpss", "t03_phillips_perron") for r in rows(spark, n)}
    for r in rows(spark, "t04_battery"):
        p = [each[n, r["series"]]["p"] for n in ("t01_adf", "t02_kpss", "t03_phillips_perron")]
        yes = sum(v is not None and (v >= 0.05 if i == 1 else v < 0.05) for i, v in enumerate(p))
        valid = sum(v is not None for v in p)
        assert r["majority"] == f"{'Stationary' if yes > valid / 2 else 'Non-stationary'} ({yes}/{valid})"


def test_normality_report(spark, series):
    null = stats.cramer_von_mises_null(len(next(iter(series.values()))), 500)
    for r in rows(spark, "g05_normality_report"):
        x = series[r["series"]]
        wanted = [stats.jarque_bera(x), plain.anderson_darling(x), plain.kolmogorov_smirnov(x), plain.cramer_von_mises(x, null)]
        assert np.allclose([[r["jb"], r["jb_p"]], [r["ad"], r["ad_p"]], [r["ks"], r["ks_p"]], [r["cvm"], r["cvm_p"]]], wanted, atol=6e-5)


def test_bootstrap_draw(spark):
    """One replica of a small bootstrap, step by step."""
    ships = panels.shipping_panel(spark, SF)
    drawn = {(r["rep"], r["t"]): r for r in bootstrap.draws(ships, 3, horizon=6).collect()}
    paths = {(r["rep"], r["t"]): r["y"] for r in bootstrap.paths(ships, 3).collect()}
    found = sorted(panel.pack(ships).collect(), key=lambda r: r["t"])
    own, x = design(np.array([r["y"] for r in found]), 1)
    steps, n = own.shape
    sigma0, a0, p0 = prior(own[:250], x[:250])
    beta, _, _, s, v = plain_kalman(own, x, sigma0, a0, p0, 0.99, 0.96)
    half = [kernels.power(m[None], e, scaled=True)[0] for e in (-0.5, 0.5) for m in s]
    white = np.array([half[t] @ v[t] for t in range(steps)])
    white -= white.mean(axis=0)
    at = kernels.block_rows(bootstrap.generator(7, "all", 1), steps, 20)
    past, ys, xs = x[0][:n], [], []
    for t in range(steps):
        xs.append(np.r_[past, 1.0])
        past = beta[max(t - 1, 0)].reshape(n, n + 1) @ xs[-1] + half[steps + t] @ white[at[t]]
        ys.append(past)
    assert np.allclose([paths[1, t + 1] for t in range(steps)], ys, rtol=1e-6, atol=1e-6)
    ys, xs = np.array(ys), np.array(xs)
    start, big, first = kernels.diffuse_start(ys[None, 0], sigma0, 0.96, n * (n + 1))
    g = kernels.kalman(ys, xs, first[0], start, big, 0.99, 0.96, ("beta", "sigma"), jitter=False)
    for t in range(0, steps, 50):
        theta = plain_gfevd(g.beta[0, t], g.sigma[0, t], 1, 6)[0]
        assert abs(drawn[1, t + 1]["tci"] - 100 * (1 - np.trace(theta) / n)) < 1e-6
