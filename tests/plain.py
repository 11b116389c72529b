"""Plain loops over one series, as truth for the jobs: none of it is used by the package."""

import math

import numpy as np

from netdrift.functions import stats

TINY = 1e-12


def normal(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def ordered(x):
    mean = sum(x) / len(x)
    sd = max(math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1)), TINY)
    return [min(max(normal((v - mean) / sd), TINY), 1 - TINY) for v in sorted(x)]


def anderson_darling(x):
    n, f = len(x), ordered(x)
    if n < 8:
        return 0.0, 1.0
    total = sum((2 * i - 1) * (math.log(f[i - 1]) + math.log(1 - f[n - i])) for i in range(1, n + 1))
    a = (-n - total / n) * (1 + 4 / n - 25 / n**2)
    if a >= 0.6:
        p = math.exp(1.2937 - 5.709 * a + 0.0186 * a * a)
    elif a >= 0.34:
        p = math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    elif a >= 0.2:
        p = 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)
    else:
        p = 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)
    return a, min(max(p, 0.0), 1.0)


def kolmogorov_smirnov(x):
    n, f = len(x), ordered(x)
    if n < 5:
        return 0.0, 1.0
    d = max(max((i + 1) / n - f[i], f[i] - i / n) for i in range(n))
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return d, min(max(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)), 0.0), 1.0)


def cramer_von_mises(x, null):
    n, f = len(x), ordered(x)
    if n < 5:
        return 0.0, 1.0
    w2 = 1 / (12 * n) + sum((f[i] - (2 * i + 1) / (2 * n)) ** 2 for i in range(n))
    return w2, sum(v >= w2 for v in null) / len(null)


def acf(x, lags):
    mean = sum(x) / len(x)
    d = [v - mean for v in x]
    total = sum(v * v for v in d)
    return [sum(d[t] * d[t - k] for t in range(k, len(d))) / total if total >= TINY else 0.0 for k in range(1, lags + 1)]


def chi2_tail(stat, df, steps=200_000):
    """By the trapezoid rule over the density, up to where nothing is left."""
    top = stat + 60 * math.sqrt(2 * df) + 200
    t = np.linspace(stat, top, steps)
    log = (df / 2 - 1) * np.log(np.maximum(t, 1e-300)) - t / 2 - df / 2 * math.log(2) - math.lgamma(df / 2)
    y = np.exp(log)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(t)).sum())


def wilson_hilferty(stat, df):
    return 1 - normal(((stat / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def ljung_box(x, lags):
    n = len(x)
    q = n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(acf(x, lags), 1))
    return q, wilson_hilferty(q, lags)


def residuals(y, x):
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def arch_lm(w, lags, whole=False):
    """Of one series' squares, or of all products of a matrix' columns (those of the lower triangle, unless ``whole``)."""
    w = np.asarray(w).reshape(len(w), -1)
    n = w.shape[1]
    v = np.array([[r[i] * r[j] for i in range(n) for j in range(n if whole else i + 1)] for r in w])
    x = np.array([np.r_[1.0, v[t - lags : t][::-1].ravel()] for t in range(lags, len(v))])
    y = v[lags:]
    e = residuals(y, x)
    total = ((y - y.mean(axis=0)) ** 2).sum()
    stat = len(y) * (1 - (e**2).sum() / total) if total > TINY else 0.0
    return stat, wilson_hilferty(stat, lags * v.shape[1])


def covariances(w, lags):
    d = w - w.mean(axis=0)
    return [sum(np.outer(d[t], d[t - k]) for t in range(k, len(d))) / len(d) for k in range(lags + 1)]


def hosking(w, lags):
    c = covariances(w, lags)
    inverse = np.linalg.inv(c[0])
    return len(w) ** 2 * sum(np.trace(c[k].T @ inverse @ c[k] @ inverse) / (len(w) - k) for k in range(1, lags + 1))


def portmanteau(w, lags):
    c, n = covariances(w, lags), len(w)
    inverse = np.linalg.inv(c[0])
    return sum(n**2 / (n - k) * ((c[k] * n / (n - k) @ inverse) ** 2).sum() for k in range(1, lags + 1))


def mardia(w):
    d = w - w.mean(axis=0)
    g = d @ np.linalg.inv(d.T @ d / len(d)) @ d.T
    n = w.shape[1]
    return (g**3).sum() / len(d) / 6, ((np.diag(g) ** 2).mean() - n * (n + 2)) / math.sqrt(8 * n * (n + 2) / len(d))


def autocorrelation_lr(w, lags):
    y = w[lags:]
    x = np.array([np.r_[w[t - lags : t][::-1].ravel(), 1.0] for t in range(lags, len(w))])
    e, n = residuals(y, x), w.shape[1]
    return (len(y) - n * lags - n - 1) * math.log(np.linalg.det(y.T @ y / len(y)) / np.linalg.det(e.T @ e / len(y)))


# unit roots of a whole series held in memory
def _deterministic(size: int, trend: str) -> list[np.ndarray]:
    return [np.ones(size)] * (trend != "n") + [np.arange(1.0, size + 1)] * (trend == "ct")


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their standard errors, residuals."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    e = y - x @ b
    return b, np.sqrt(np.maximum(np.diag(inverse) * (e @ e) / max(len(y) - x.shape[1], 1), 0)), e


def adf(x: np.ndarray, trend: str = "c") -> dict:
    """Augmented Dickey-Fuller, lags by AIC on the common sample of all candidates."""
    trend = stats.trend_name(trend)
    size, extra = len(x), {"n": 0, "c": 1, "ct": 2}[trend]
    most = min(math.ceil(12 * (size / 100) ** 0.25), size // 2 - extra - 1)
    if most < 0 or np.ptp(x) == 0:
        raise ValueError("series too short or constant")
    d = np.diff(x)

    def design(lags: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(d) - cut
        columns = [x[cut:-1], *[d[cut - i : len(d) - i] for i in range(1, lags + 1)], *_deterministic(rows, trend)]
        return d[cut:], np.column_stack(columns)

    def aic(lags: int) -> float:
        y, z = design(lags, most)
        e = _regress(y, z)[2]
        return len(y) * (math.log(2 * math.pi) + math.log(max(e @ e, 1e-300) / len(y)) + 1) + 2 * z.shape[1]

    lags = min(range(most + 1), key=lambda i: (aic(i), i))
    y, z = design(lags, lags)
    b, se, _ = _regress(y, z)
    stat = float(b[0] / se[0])
    return {"stat": stat, "p": stats.mackinnon_p(stat, trend), "lags": lags, "nobs": len(y), "critical": stats.mackinnon_critical(len(y), trend)}


def kpss(x: np.ndarray, trend: str = "c") -> dict:
    """KPSS with the bandwidth of Hobijn and others; p by interpolation, within 0.01 and 0.1."""
    if trend not in stats._KPSS:
        raise ValueError("trend must be 'c' or 'ct'")
    size = len(x)
    if size < 3 or np.ptp(x) == 0:
        raise ValueError("series too short or constant")
    e = _regress(x, np.column_stack(_deterministic(size, trend)))[2]
    products = [float(e[i:] @ e[: size - i]) for i in range(size)] if size <= 64 else None
    product = (lambda i: products[i]) if products else (lambda i: float(e[i:] @ e[: size - i]))
    s0, s1 = product(0) / size, 0.0
    for i in range(1, int(size ** (2 / 9)) + 1):
        s0 += product(i) / (size / 2)
        s1 += i * product(i) / (size / 2)
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * size ** (1 / 3)), size - 1)
    long_run = (product(0) + 2 * sum(product(i) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / size
    if not long_run > 0:
        raise ValueError("no long-run variance")
    stat = float((np.cumsum(e) ** 2).sum() / size**2 / long_run)
    at = stats._KPSS[trend]
    return {"stat": stat, "p": float(np.interp(stat, at, stats._KPSS_P)), "lags": lags, "critical": [at[3], at[1], at[0]]}


def phillips_perron(x: np.ndarray, trend: str = "c") -> dict:
    """Z-tau with a Newey-West variance of ceil(12 (T / 100)^(1/4)) lags."""
    trend = stats.trend_name(trend)
    if len(x) < 3 or np.ptp(x) == 0:
        raise ValueError("series too short or constant")
    lags = math.ceil(12 * (len(x) / 100) ** 0.25)
    y = x[1:]
    z = np.column_stack([x[:-1], *_deterministic(len(y), trend)])
    b, se, e = _regress(y, z)
    size = len(y)
    gamma = [float(e[i:] @ e[: size - i]) / size for i in range(lags + 1)]
    long_run = gamma[0] + 2 * sum((1 - i / (lags + 1)) * gamma[i] for i in range(1, lags + 1))
    s = math.sqrt(e @ e / (size - z.shape[1]))
    if not (long_run > 0 and s > 0):
        raise ValueError("constant series")
    stat = math.sqrt(gamma[0] / long_run) * (b[0] - 1) / se[0] - 0.5 * (long_run - gamma[0]) / math.sqrt(long_run) * size * se[0] / s
    return {"stat": float(stat), "p": stats.mackinnon_p(stat, trend), "lags": lags, "nobs": size, "critical": stats.mackinnon_critical(size, trend)}
