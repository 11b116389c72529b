"""Dense kernels for time-varying vector autoregressions, batched over configurations, replicas or dates.

Shapes: n series, k regressors of an equation (n p, and 1 for the constant), m = n k coefficients, B batch.
A coefficient vector is the (n, k) matrix row by row; a symmetric matrix is (n, n).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

EPS = 1e-12


def symmetric(a: np.ndarray) -> np.ndarray:
    return 0.5 * (a + np.swapaxes(a, -1, -2))


def ols_prior(y: np.ndarray, x: np.ndarray, spread: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """B (n, k), Sigma0 = E'E / T, a0 = B by rows, P0 = spread * Sigma0 (x) (X'X)^+."""
    inverse = np.linalg.pinv(x.T @ x)
    b = (inverse @ (x.T @ y)).T
    e = y - x @ b.T
    sigma0 = e.T @ e / len(y)
    return b, sigma0, b.ravel().copy(), spread * np.kron(sigma0, inverse)


@dataclass
class Filtered:
    """What the filter leaves, each (B, T, ...); None where it was not asked for."""

    loglik: np.ndarray
    beta: np.ndarray | None = None
    sigma: np.ndarray | None = None
    y_pred: np.ndarray | None = None
    s: np.ndarray | None = None
    innovation: np.ndarray | None = None
    gain: np.ndarray | None = None
    p_filt: np.ndarray | None = None
    p_pred: np.ndarray | None = None


def kalman(y, x, sigma0, a0, p0, kappa1, kappa2, keep: tuple[str, ...] = (), jitter: bool = True) -> Filtered:
    """Forgetting-factor Kalman filter of a TVP-VAR with an exponentially weighted covariance.

    y (T, n) and x (T, k) may have a leading batch axis, as may all else; kappas are (B,). P0 enters the first step
    undiscounted. ``keep`` names what to keep besides the log-likelihood.
    """
    kappa1, kappa2 = np.atleast_1d(np.asarray(kappa1, float)), np.atleast_1d(np.asarray(kappa2, float))
    batch = max(len(kappa1), y.shape[0] if y.ndim == 3 else 1, sigma0.shape[0] if np.ndim(sigma0) == 3 else 1)
    steps, n = y.shape[-2:]
    k = x.shape[-1]
    m = n * k
    a = np.broadcast_to(a0, (batch, m)).copy()
    p = np.broadcast_to(p0, (batch, m, m)).copy()
    sigma = np.broadcast_to(sigma0, (batch, n, n)).copy()
    kappa1, kappa2 = np.broadcast_to(kappa1, batch)[:, None, None], np.broadcast_to(kappa2, batch)[:, None, None]
    shapes = {"beta": (m,), "sigma": (n, n), "y_pred": (n,), "s": (n, n), "innovation": (n,), "gain": (m, n), "p_filt": (m, m), "p_pred": (m, m)}
    kept = {name: np.empty((batch, steps, *shapes[name])) for name in keep}
    loglik = np.empty((batch, steps))
    eye, log2pi = np.eye(n), n * math.log(2 * math.pi)
    for t in range(steps):
        yt = np.broadcast_to(y[..., t, :], (batch, n))
        xt = np.broadcast_to(x[..., t, :], (batch, k))
        forecast = np.einsum("bik,bk->bi", a.reshape(batch, n, k), xt)
        v = yt - forecast
        ph = np.einsum("bmjk,bk->bmj", p.reshape(batch, m, n, k), xt)
        s = np.einsum("bikj,bk->bij", ph.reshape(batch, n, k, n), xt) + sigma
        if jitter:
            s = symmetric(s)
            s = s + eye * (1e-10 * np.trace(s, axis1=1, axis2=2) / n + 1e-12)[:, None, None]
        gain = np.swapaxes(np.linalg.solve(np.swapaxes(s, 1, 2), np.swapaxes(ph, 1, 2)), 1, 2)
        if "p_pred" in kept:
            kept["p_pred"][:, t] = p
        a = a + np.einsum("bmn,bn->bm", gain, v)
        p = symmetric(p - gain @ s @ np.swapaxes(gain, 1, 2))
        e = yt - np.einsum("bik,bk->bi", a.reshape(batch, n, k), xt)
        sigma = symmetric(kappa2 * sigma + (1 - kappa2) * e[:, :, None] * e[:, None, :])
        with np.errstate(all="ignore"):
            logdet = np.linalg.slogdet(s)[1]
            loglik[:, t] = -0.5 * (log2pi + logdet + np.einsum("bi,bi->b", v, np.linalg.solve(s, v[:, :, None])[:, :, 0]))
        for name, value in (("beta", a), ("sigma", sigma), ("y_pred", forecast), ("s", s), ("innovation", v), ("gain", gain), ("p_filt", p)):
            if name in kept:
                kept[name][:, t] = value
        p = p / kappa1
    return Filtered(loglik, **kept)


def diffuse_start(y0: np.ndarray, sigma0: np.ndarray, kappa2: float, m: int, p0_scale: float = 1e4, early: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bootstrap filter's start for first rows y0 (B, n): a = 0, P = scale I, Sigma mixed with early * y0 y0'."""
    first = symmetric(kappa2 * sigma0 + (1 - kappa2) * early * y0[:, :, None] * y0[:, None, :])
    return np.zeros(m), p0_scale * np.eye(m), first


def moving_average(beta: np.ndarray, n: int, k: int, p: int, horizon: int) -> np.ndarray:
    """Phi (N, H, n, n) of the VAR frozen at each date; a constant column is left out."""
    a = beta.reshape(len(beta), n, k)[:, :, : n * p].reshape(len(beta), n, p, n)
    phi = np.empty((len(beta), horizon, n, n))
    phi[:, 0] = np.eye(n)
    for h in range(1, horizon):
        phi[:, h] = sum(a[:, :, lag - 1] @ phi[:, h - lag] for lag in range(1, min(p, h) + 1))
    return phi


def gfevd(beta: np.ndarray, sigma: np.ndarray, p: int, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """theta with rows summing to 1, theta_g, and the numerators, each (N, n, n); rows receive, columns send."""
    n = sigma.shape[-1]
    phi = moving_average(beta, n, beta.shape[-1] // n, p, horizon)
    shocked = phi @ sigma[:, None]
    own = np.maximum(np.einsum("tii->ti", sigma), EPS)
    numer = (shocked**2).sum(axis=1) / own[:, None, :]
    denom = np.einsum("thij,thij->ti", shocked, phi)
    theta_g = numer / np.where(np.abs(denom) > EPS, denom, 1.0)[:, :, None]
    rows = numer.sum(axis=2, keepdims=True)
    return numer / np.where(rows > EPS, rows, 1.0), theta_g, numer


def indices(theta: np.ndarray, sub: np.ndarray | None = None, numer: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """tci, to, from, net, pdc of theta (N, n, n), and tci_sub, net_sub over the mask ``sub`` (0 where it is empty)."""
    n = theta.shape[-1]
    own = np.einsum("tii->ti", theta)
    to, frm = 100 * (theta.sum(axis=1) - own) / n, 100 * (theta.sum(axis=2) - own) / n
    out = {"tci": to.sum(axis=1), "to": to, "from": frm, "net": to - frm, "pdc": theta - np.swapaxes(theta, 1, 2)}
    mask = np.zeros(n) if sub is None else np.asarray(sub, float)
    inner = (theta if numer is None else numer) * mask[:, None] * mask[None, :]
    rows = inner.sum(axis=2, keepdims=True)
    inner = inner / np.where(rows > EPS, rows, 1.0)
    own, size = np.einsum("tii->ti", inner), max(mask.sum(), 1.0)
    to, frm = 100 * (inner.sum(axis=1) - own) / size, 100 * (inner.sum(axis=2) - own) / size
    return out | {"tci_sub": to.sum(axis=1), "net_sub": to - frm}


def power(a: np.ndarray, exponent: float, jitter: float = 1e-10, scaled: bool = False, floor: float = 1e-12, method: str = "zca") -> np.ndarray:
    """(N, n, n) matrices to +-1/2 by eigenvalues floored at ``floor``; ``scaled`` jitter goes with the mean variance.

    'zca' rotates back to the series; 'pca' (for -1/2) stays in the eigenvectors' order.
    """
    if method not in ("zca", "pca"):
        raise ValueError("method must be 'zca' or 'pca'")
    a = symmetric(a)
    n = a.shape[-1]
    add = jitter * np.trace(a, axis1=1, axis2=2) / n if scaled else np.full(len(a), jitter)
    w, q = np.linalg.eigh(a + add[:, None, None] * np.eye(n))
    part = np.maximum(w, floor)[:, :, None] ** exponent * np.swapaxes(q, 1, 2)
    return part if method == "pca" else q @ part


def is_positive(a: np.ndarray, tol_symmetry: float = 1e-8, tol_eigen: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each (N, n, n) matrix is symmetric and has no eigenvalue at or below -tol; least eigenvalue; reason."""
    mirrored = np.swapaxes(a, 1, 2)
    even = (np.abs(a - mirrored) <= tol_symmetry + 1e-5 * np.abs(mirrored)).all(axis=(1, 2))
    least = np.linalg.eigvalsh(symmetric(a))[:, 0]
    good = even & (least > -tol_eigen)
    return good, least, np.where(~even, "not symmetric", np.where(good, "ok", "negative eigenvalue"))


def simulate(beta: np.ndarray, shocks: np.ndarray, y_init: np.ndarray, p: int, add_const: bool) -> tuple[np.ndarray, np.ndarray]:
    """Paths y (B, T, n) and their regressors x (B, T, k) from beta (T, m) one step behind and shocks (B, T, n).

    y_init (p, n) holds the first rows, newest first.
    """
    batch, steps, n = shocks.shape
    k = beta.shape[1] // n
    past = np.broadcast_to(y_init, (batch, p, n)).copy()
    ys, xs = np.empty((batch, steps, n)), np.zeros((batch, steps, k))
    for t in range(steps):
        xs[:, t, : n * p] = past.reshape(batch, n * p)
        if add_const:
            xs[:, t, -1] = 1.0
        ys[:, t] = xs[:, t] @ beta[max(t - 1, 0)].reshape(n, k).T + shocks[:, t]
        past = np.concatenate([ys[:, t : t + 1], past[:, :-1]], axis=1)
    return ys, xs


def block_rows(rng: np.random.Generator, steps: int, block: int) -> np.ndarray:
    """Row numbers of a moving-block resample: starts uniform in [0, T - b], no wrapping, cut to T."""
    block = min(block, steps)
    starts = rng.integers(0, steps - block + 1, -(-steps // block))
    return (starts[:, None] + np.arange(block)).ravel()[:steps]
