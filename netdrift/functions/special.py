"""Distribution functions that Spark lacks, on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-12

#: Cody's rational approximations (1969), highest power first, with the term that he adds last at its place.
#: erf(x) / x in x^2 up to 0.46875; erfc(x) exp(x^2) in x up to 4; x^2 (1 / sqrt(pi) - x erfc(x) exp(x^2)) in 1 / x^2 beyond.
_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03),
    (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03),
)
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03),
    (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(parts: tuple[tuple[float, ...], tuple[float, ...]], x: np.ndarray) -> np.ndarray:
    return np.polyval(parts[0], x) / np.polyval(parts[1], x)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to rounding, in three ranges of |x|."""
    x = np.asarray(x, float)
    size, out = np.abs(x), np.where(np.isnan(x), math.nan, np.sign(x))
    near, middle, far = size <= 0.46875, (size > 0.46875) & (size <= 4), (size > 4) & (size < 6)
    out[near] = x[near] * _ratio(_NEAR, x[near] ** 2)
    y = size[middle]
    out[middle] *= 1 - np.exp(-y * y) * _ratio(_MIDDLE, y)
    y = size[far]
    out[far] *= 1 - np.exp(-y * y) / y * (1 / math.sqrt(math.pi) - _ratio(_FAR, 1 / (y * y)) / (y * y))
    return out


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * erf(np.atleast_1d(np.asarray(z, float)) / math.sqrt(2.0)).reshape(np.shape(z))


#: Acklam's rational approximation of the normal quantile (relative error 1.15e-9), refined below.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of normal_cdf; one Halley step makes it accurate to rounding."""
    p = np.asarray(p, float)
    if not p.size:
        return p
    with np.errstate(all="ignore"):
        q = np.sqrt(-2 * np.log(np.where(p < 0.5, p, 1 - p)))
        tail = np.polyval(_C, q) / np.polyval((*_D, 1.0), q)
        tail = np.where(p < 0.5, tail, -tail)
        r = (p - 0.5) ** 2
        middle = (p - 0.5) * np.polyval(_A, r) / np.polyval((*_B, 1.0), r)
        x = np.where((p > 0.02425) & (p < 1 - 0.02425), middle, tail)
        e = (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
        x = x - e / (1 + x * e / 2)
    x = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, x))
    return np.where((p < 0) | (p > 1), np.nan, x)


def approximate_erfinv(y: np.ndarray) -> np.ndarray:
    """Winitzki's closed form with a = 0.147 and one Newton step: an approximation, kept as such for plots."""
    y = np.asarray(y, float)
    if not y.size:
        return y
    a = 0.147
    with np.errstate(all="ignore"):
        log = np.log1p(-y * y)
        half = 2 / (math.pi * a) + log / 2
        x = np.copysign(np.sqrt(np.sqrt(half * half - log / a) - half), y)
        return x - (erf(x) - y) * math.sqrt(math.pi) / 2 * np.exp(x * x)


#: The series of Stirling's formula, B(2k) / (2k (2k - 1)), highest power of 1 / x^2 first.
_STIRLING = (-1 / 360360 * 691, 1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12)


def _lgamma(a: np.ndarray) -> np.ndarray:
    """ln Gamma for a > 0: Stirling's formula from a + 10, brought back by the product of the steps."""
    x = a + 10
    steps = np.prod([a + i for i in range(10)], axis=0)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + np.polyval(_STIRLING, 1 / (x * x)) / x - np.log(steps)


def _lower_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) without its front factor, for x < a + 1."""
    term = 1 / a
    total, k = term.copy(), a.copy()
    for _ in range(100_000):
        k += 1
        term = term * x / k
        total += term
        if (np.abs(term) <= np.abs(total) * 1e-16).all():
            break
    return total


def _upper_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x) without its front factor, for x >= a + 1 (Lentz's continued fraction)."""
    tiny = 1e-300
    b = x + 1 - a
    c, d = np.full_like(x, 1 / tiny), 1 / b
    h = d.copy()
    for i in range(1, 100_000):
        n = -i * (i - a)
        b = b + 2
        d = n * d + b
        d = 1 / np.where(np.abs(d) > tiny, d, tiny)
        c = b + n / c
        c = np.where(np.abs(c) > tiny, c, tiny)
        h *= d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized upper incomplete gamma function Q(a, x); NaN outside a > 0, x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, math.nan)
    fine = (a > 0) & (x >= 0)
    out[fine & (x == 0)] = 1.0
    out[fine & np.isinf(x)] = 0.0
    for part, below in ((fine & (x > 0) & (x < a + 1), True), (fine & (x >= a + 1) & np.isfinite(x), False)):
        p, q = a[part], x[part]
        if p.size:
            front = np.exp(p * np.log(q) - q - _lgamma(p))
            out[part] = np.clip(1 - _lower_series(p, q) * front if below else front * _upper_fraction(p, q), 0.0, 1.0)
    return out


def chi2_tail(stat: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(chi-square with df degrees > stat), elementwise; 1 where stat <= 0, NaN where it is NaN."""
    stat, df = np.broadcast_arrays(np.asarray(stat, float), np.asarray(df, float))
    return np.where(stat <= 0, 1.0, upper_gamma(df / 2, np.where(stat > 0, stat, math.nan) / 2))[()]


def chi2_tail_wilson_hilferty(stat: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The cube-root normal approximation of chi2_tail, elementwise; 1 where df <= 0 or stat < 0."""
    stat, df = np.broadcast_arrays(np.asarray(stat, float), np.asarray(df, float))
    with np.errstate(all="ignore"):
        spread = 2.0 / (9.0 * df)
        z = (np.cbrt(stat / df) - (1 - spread)) / np.sqrt(spread)
        return np.where((df <= 0) | (stat < 0), 1.0, 1.0 - normal_cdf(z))[()]


def inversions(rank: np.ndarray, width: int = 64) -> int:
    """How many earlier items are larger than later ones: blocks of ``width`` by counting, then merges of all blocks at once."""
    n = len(rank)
    blocks = 1 << max(-(-n // width) - 1, 0).bit_length()
    top = int(rank.max(initial=0)) + 1
    run = np.full(blocks * width, top, np.int64)  # fillers are larger than all and last
    run[:n] = rank
    run = run.reshape(blocks, width)
    upper = np.triu(np.ones((width, width), bool), 1)
    swaps = 0
    for low in range(0, blocks, 256):
        part = run[low : low + 256]
        swaps += int(((part[:, :, None] > part[:, None, :]) & upper).sum())
    run = np.sort(run, axis=1)
    while len(run) > 1:
        width = run.shape[1]
        pair = np.arange(len(run) // 2)[:, None]
        left, right = run[::2] + pair * (top + 1), run[1::2] + pair * (top + 1)
        met = np.searchsorted(left.ravel(), right.ravel(), side="right").reshape(right.shape) - pair * width
        swaps += int((width - met).sum())
        run = np.sort(run.reshape(len(run) // 2, 2 * width), axis=1)
    return swaps


def concordance(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs of rows in which x and y go the same way, less those in which they do not; ties on either count as neither."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = np.asarray(x)[order], np.unique(np.asarray(y)[order], return_inverse=True)[1]

    def tied(*keys: np.ndarray) -> int:
        edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        counts = np.diff(np.r_[-1, edges, n - 1])
        return int((counts * (counts - 1) // 2).sum())

    return n * (n - 1) // 2 - tied(x) - tied(np.sort(y)) + tied(x, y) - 2 * inversions(y) if n else 0


def grid_concordance(row: np.ndarray, column: np.ndarray, count: np.ndarray) -> int:
    """concordance() of rows that are counted by cells of a grid, pairs of one grid row or column being ties."""
    grid = np.zeros((int(row.max(initial=0)) + 1, int(column.max(initial=0)) + 1), np.int64)
    np.add.at(grid, (row, column), count)
    before = np.zeros_like(grid[0])
    same = 0
    for cells in grid:  # rows of smaller x against those of this x
        left = np.cumsum(before) - before
        same += int((cells * (2 * left + before - before.sum())).sum())
        before += cells
    return same


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b of rows with finite values; nan where a side is constant."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    total = len(x) * (len(x) - 1) // 2
    on_x, on_y = (int(sum(int(c) * (int(c) - 1) // 2 for c in np.unique(v, return_counts=True)[1])) for v in (x, y))
    scale = math.sqrt(float(total - on_x)) * math.sqrt(float(total - on_y))
    return concordance(x, y) / scale if scale else math.nan
