"""Numpy kernels against plain loops, closed forms and published values."""

import math

import numpy as np
import plain
import pytest

from netdrift.functions import kernels, special, stats
from netdrift.operators import model


@pytest.fixture(scope="module")
def var():
    """A seeded VAR(1) of three series: y, x with a constant, and its true coefficients."""
    rng = np.random.default_rng(11)
    b = np.array([[0.4, 0.1, 0.0], [0.0, 0.3, 0.2], [0.1, 0.0, 0.5]])
    root = np.linalg.cholesky(np.array([[1.0, 0.3, 0.1], [0.3, 1.0, 0.2], [0.1, 0.2, 1.0]]))
    y = np.zeros((400, 3))
    for t in range(1, 400):
        y[t] = b @ y[t - 1] + root @ rng.standard_normal(3)
    return y[1:], np.hstack([y[:-1], np.ones((399, 1))]), b


def plain_kalman(y, x, sigma0, a0, p0, k1, k2):
    n, k = y.shape[1], x.shape[1]
    a, p, sigma, out = a0.copy(), p0.copy(), sigma0.copy(), []
    for t in range(len(y)):
        h = np.kron(np.eye(n), x[t])
        v = y[t] - h @ a
        s = h @ p @ h.T + sigma
        s = (s + s.T) / 2
        s = s + np.eye(n) * (1e-10 * np.trace(s) / n + 1e-12)
        gain = p @ h.T @ np.linalg.inv(s)
        ll = -0.5 * (n * math.log(2 * math.pi) + math.log(np.linalg.det(s)) + v @ np.linalg.inv(s) @ v)
        a = a + gain @ v
        p = p - gain @ s @ gain.T
        p = (p + p.T) / 2
        e = y[t] - a.reshape(n, k) @ x[t]
        sigma = k2 * sigma + (1 - k2) * np.outer(e, e)
        out.append((a, sigma, ll, s, v))
        p = p / k1
    return [np.array(c) for c in zip(*out, strict=True)]


def test_kalman_equals_plain_loop_in_a_batch(var):
    y, x, _ = var
    _, sigma0, a0, p0 = kernels.ols_prior(y[:250], x[:250])
    points = [(0.99, 0.96), (0.95, 0.94), (1.0, 1.0)]
    f = kernels.kalman(y, x, sigma0, a0, p0, [a for a, _ in points], [b for _, b in points], ("beta", "sigma", "s", "innovation"))
    for i, (k1, k2) in enumerate(points):
        beta, sigma, ll, s, v = plain_kalman(y, x, sigma0, a0, p0, k1, k2)
        for got, want in ((f.beta[i], beta), (f.sigma[i], sigma), (f.loglik[i], ll), (f.s[i], s), (f.innovation[i], v)):
            assert np.allclose(got, want, rtol=1e-8, atol=1e-9)


def test_kalman_without_forgetting_is_bayesian_least_squares(var):
    y, x, b = var
    sigma0, k = np.eye(3), x.shape[1]
    p0 = np.eye(3 * k)
    f = kernels.kalman(y, x, sigma0, np.zeros(3 * k), p0, 1.0, 1.0, ("beta", "sigma"), jitter=False)
    assert np.allclose(f.sigma[0, -1], sigma0)
    posterior = np.linalg.solve(np.eye(k) + x.T @ x, x.T @ y).T
    assert np.allclose(f.beta[0, -1].reshape(3, k), posterior, atol=1e-9)
    assert np.abs(posterior[:, :3] - b).max() < 0.15


def test_ols_prior(var):
    y, x, _ = var
    b, sigma0, a0, p0 = kernels.ols_prior(y, x)
    assert np.allclose(b.T, np.linalg.lstsq(x, y, rcond=None)[0]) and np.allclose(a0, b.ravel())
    assert np.allclose(p0, 10 * np.kron(sigma0, np.linalg.inv(x.T @ x)))


def plain_gfevd(beta, sigma, p, horizon):
    n = len(sigma)
    a = beta.reshape(n, -1)[:, : n * p]
    phis = [np.eye(n)]
    for h in range(1, horizon):
        phis.append(sum(a[:, (lag - 1) * n : lag * n] @ phis[h - lag] for lag in range(1, min(p, h) + 1)))
    numer, denom = np.zeros((n, n)), np.zeros(n)
    for phi in phis:
        for i in range(n):
            denom[i] += phi[i] @ sigma @ phi[i]
            for j in range(n):
                numer[i, j] += (phi[i] @ sigma[:, j]) ** 2 / sigma[j, j]
    raw = numer / denom[:, None]
    return raw / raw.sum(axis=1, keepdims=True), raw


@pytest.mark.parametrize("p", [1, 2])
def test_gfevd_and_indices(p):
    rng = np.random.default_rng(p)
    n, dates = 4, 5
    beta = rng.normal(0, 0.15, (dates, n * (n * p + 1)))
    root = rng.normal(size=(dates, n, n))
    sigma = root @ np.swapaxes(root, 1, 2) + np.eye(n)
    theta, raw, numer = kernels.gfevd(beta, sigma, p, 10)
    for t in range(dates):
        want, want_raw = plain_gfevd(beta[t], sigma[t], p, 10)
        assert np.allclose(theta[t], want) and np.allclose(raw[t], want_raw)
    found = kernels.indices(theta, np.array([1, 0, 1, 1]), numer)
    assert np.allclose(theta.sum(axis=2), 1) and np.allclose(found["net"].sum(axis=1), 0)
    assert np.allclose(found["tci"], found["from"].sum(axis=1)) and np.allclose(found["tci"], 100 * (1 - np.einsum("tii->t", theta) / n))
    assert np.allclose(found["pdc"], -np.swapaxes(found["pdc"], 1, 2))
    kept = theta[:, [0, 2, 3]][:, :, [0, 2, 3]]
    kept = kept / kept.sum(axis=2, keepdims=True)
    assert np.allclose(found["tci_sub"], 100 * (kept.sum(axis=(1, 2)) - np.einsum("tii->t", kept)) / 3) and np.allclose(found["net_sub"][:, 1], 0)
    assert (kernels.indices(theta)["tci_sub"] == 0).all()


def test_gfevd_closed_forms():
    sigma = np.array([[[2.0, 0.5], [0.5, 1.0]]])
    theta, _, _ = kernels.gfevd(np.zeros((1, 6)), sigma, 1, 1)
    want = sigma[0] ** 2 / np.diag(sigma[0])
    assert np.allclose(theta[0], want / want.sum(axis=1, keepdims=True))
    diagonal = np.array([[0.5, 0, 0, 0, 0.3, 0]])
    assert np.allclose(kernels.gfevd(diagonal, np.array([np.diag([1.0, 2.0])]), 1, 20)[0], np.eye(2))


def test_powers_and_definiteness():
    rng = np.random.default_rng(2)
    root = rng.normal(size=(6, 3, 3))
    a = root @ np.swapaxes(root, 1, 2) + 0.1 * np.eye(3)
    for scaled in (False, True):
        half, inverse = kernels.power(a, 0.5, scaled=scaled), kernels.power(a, -0.5, scaled=scaled)
        assert np.allclose(half @ half, a, atol=1e-7) and np.allclose(inverse @ a @ inverse, np.eye(3), atol=1e-6)
    pca = kernels.power(a, -0.5, method="pca")
    assert np.allclose(pca @ a @ np.swapaxes(pca, 1, 2), np.eye(3), atol=1e-6)
    bad = np.array([np.eye(3), np.diag([1.0, 0.0, 2.0]), np.diag([1.0, -1.0, 1.0]), np.eye(3) + np.eye(3, k=1)])
    ok, least, why = kernels.is_positive(bad)
    assert ok.tolist() == [True, True, False, False] and why.tolist() == ["ok", "ok", "negative eigenvalue", "not symmetric"]


def test_simulation_and_blocks():
    rng = np.random.default_rng(3)
    beta, shocks = rng.normal(0, 0.2, (30, 2 * 5)), rng.normal(size=(2, 30, 2))
    y, x = kernels.simulate(beta, shocks, np.array([[1.0, 2.0], [3.0, 4.0]]), 2, True)
    past = [np.array([1.0, 2.0]), np.array([3.0, 4.0])]
    for t in range(30):
        row = np.r_[past[0], past[1], 1.0]
        assert np.allclose(x[0, t], row)
        now = beta[max(t - 1, 0)].reshape(2, 5) @ row + shocks[0, t]
        assert np.allclose(y[0, t], now)
        past = [now, past[0]]
    rows = kernels.block_rows(np.random.default_rng(1), 100, 20)
    assert len(rows) == 100 and all((np.diff(rows[i : i + 20]) == 1).all() for i in range(0, 100, 20)) and rows.max() < 100
    assert kernels.block_rows(np.random.default_rng(1), 50, 50).tolist() == list(range(50))


def test_special_functions():
    assert np.allclose(special.normal_quantile(np.array([0.025, 0.5, 0.975, 1e-10])), [-1.959963984540054, 0, 1.959963984540054, -6.361340902404056], atol=1e-12)
    z = np.linspace(-6, 6, 41)
    assert np.allclose(special.normal_quantile(special.normal_cdf(z)), z, atol=1e-6)
    assert abs(special.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-12 and abs(special.chi2_tail(18.307038053275146, 10) - 0.05) < 1e-12
    assert abs(special.chi2_tail(4.0, 2) - math.exp(-2)) < 1e-14 and special.chi2_tail(-1, 3) == 1 and math.isnan(special.chi2_tail(math.nan, 3))
    stat, df = np.array([0.5, 3.0, 40.0, 300.0, 0.0, -1.0]), np.array([1.0, 7.0, 30.0, 250.0, 2.0, 3.0])
    assert np.allclose(special.chi2_tail(stat, df)[:4], [plain.chi2_tail(a, b) for a, b in zip(stat[:4], df[:4], strict=True)], atol=2e-4) and special.chi2_tail(stat, df)[4:].tolist() == [1, 1]
    assert np.allclose(special.chi2_tail_wilson_hilferty(stat, df)[:4], [plain.wilson_hilferty(a, b) for a, b in zip(stat[:4], df[:4], strict=True)])
    assert abs(special.chi2_tail_wilson_hilferty(18.307, 10) - 0.05) < 1e-3 and special.chi2_tail_wilson_hilferty(1, 0) == 1
    y = np.array([-0.9, 0.1, 0.5])
    assert np.allclose(special.erf(special.approximate_erfinv(y)), y, atol=1e-4)


def test_kendall():
    rng = np.random.default_rng(0)
    for size in (2, 3, 17, 64):
        x, y = rng.integers(0, 6, size).astype(float), rng.integers(0, 6, size).astype(float)
        pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(size) for j in range(i)]
        scale = math.sqrt(sum(a != 0 for a, _ in pairs)) * math.sqrt(sum(b != 0 for _, b in pairs))
        got = special.kendall_tau_b(x, y)
        assert math.isnan(got) if scale == 0 else abs(got - sum(a * b for a, b in pairs) / scale) < 1e-12


def test_multivariate_statistics_equal_plain_loops():
    w = np.random.default_rng(4).normal(size=(60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2.0]]) + 0.7
    found = stats.mardia(w)
    assert np.allclose([found[0], found[2]], plain.mardia(w))
    assert np.allclose(found[1], plain.chi2_tail(found[0], 10), atol=1e-6)
    assert stats.mardia(w[:4], robust=True) == (0.0, 1.0, 0.0, 1.0)
    assert np.allclose(stats.hosking(w, 6)[0], plain.hosking(w, 6)) and stats.hosking(w, 6)[2] == 54
    assert np.allclose(stats.portmanteau_from(stats.gram(stats.lagged_rows(w, 6)), 3)[0], plain.portmanteau(w, 6))
    assert np.allclose(stats.autocorrelation_lr(w, 4)[0], plain.autocorrelation_lr(w, 4))
    for vech in (True, False):
        stat, degrees, p = stats.multivariate_arch_lm(w, 2, vech)
        assert degrees == (12 if vech else 18) and np.allclose((stat, p), plain.arch_lm(w, 2, whole=not vech))
    two = stats.gram(stats.lagged_rows(w, 5))
    assert np.allclose(two, stats.gram(stats.lagged_rows(w, 5)[:17]) + stats.gram(stats.lagged_rows(w, 5)[17:]))


def test_degenerate_inputs():
    flat = np.ones(30)
    assert stats.jarque_bera(flat)[0] == 0
    assert stats.multivariate_arch_lm(np.ones((3, 2)), 1) == (0.0, 0, 1.0) and math.isnan(stats.hosking(np.ones((30, 2)))[0])
    assert stats.multivariate_arch_lm(np.ones((30, 2)), 1)[0] == 0 and math.isnan(stats.autocorrelation_lr(np.zeros((30, 2)))[0])
    with pytest.raises(np.linalg.LinAlgError):
        stats.mardia(np.ones((30, 2)))
    with pytest.raises(ValueError):
        plain.adf(flat)
    with pytest.raises(ValueError):
        plain.adf(np.arange(30.0), "x")


def test_unit_roots_tell_walks_from_noise():
    rng = np.random.default_rng(6)
    noise = rng.standard_normal(400)
    walk = np.cumsum(noise)
    assert plain.adf(noise)["p"] < 0.01 and plain.adf(walk)["p"] > 0.05
    assert plain.phillips_perron(noise)["p"] < 0.01 and plain.phillips_perron(walk)["p"] > 0.05
    assert plain.kpss(noise)["p"] > 0.05 and plain.kpss(np.cumsum(noise + 0.2))["p"] == 0.01
    assert abs(stats.mackinnon_p(-2.86154, "c") - 0.05) < 2e-3 and abs(stats.mackinnon_p(-1.941, "n") - 0.05) < 2e-3 and abs(stats.mackinnon_p(-3.41049, "ct") - 0.05) < 2e-3
    assert plain.adf(noise, "nc")["critical"] == plain.adf(noise, "n")["critical"]


def test_search_reaches_the_minimum():
    def value(points):
        return (points[:, 0] - 0.963) ** 2 + 3 * (points[:, 1] - 0.971) ** 2

    at, best, done, _ = model.descend(value, np.array(model.starts(3, 0.94, 0.99, 1)), 0.94, 0.99, 200, 1e-6)
    assert done.all() and np.allclose(at, [0.963, 0.971], atol=1e-4)
    edge, *_ = model.descend(lambda p: -p.sum(axis=1), np.array([[0.95, 0.95]]), 0.94, 0.99, 200, 1e-6)
    assert np.allclose(edge, 0.99)
    assert model.starts(2, 0.9, 1.0, 5) == model.starts(2, 0.9, 1.0, 5) and len(model.starts(2, 0.9, 1.0, 5)) == 7
