"""Residual and normality diagnostics: univariate per series, multivariate per panel, all from sums that Spark takes.

Univariate statistics are sums over ordered or lagged rows. Multivariate ones are functions of cross products of a
row with rows before it, or of third and fourth moments: a task sums its rows where they lie, Spark adds the tasks' sums
cell by cell, and a finish on small matrices follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netdrift.functions import special, stats

from . import describe
from .order import with_history
from .panel import ALONG
from .sums import array_sums, blocks_of


def wilson_hilferty(stat: Column, df: Column) -> Column:
    """Tail probability of a chi-square value by the cube-root approximation."""
    return F.pandas_udf(lambda s, d: pd.Series(special.chi2_tail_wilson_hilferty(s.to_numpy(), d.to_numpy())), "double")(stat, df.cast("double"))


def chi2(stat: Column, df: Column) -> Column:
    return F.pandas_udf(lambda s, d: pd.Series(special.chi2_tail(s.to_numpy(), d.to_numpy())), "double")(stat, df.cast("double"))


def jarque_bera_value() -> Column:
    return F.col("n") / 6 * (F.col("skewness") ** 2 + 0.25 * F.col("excess_kurtosis") ** 2)


def jarque_bera(panel: DataFrame) -> DataFrame:
    return describe.moments(panel).withColumn("jb", jarque_bera_value()).withColumn("p", wilson_hilferty(F.col("jb"), F.lit(2)))


def joint_jarque_bera(panel: DataFrame) -> DataFrame:
    """Per panel the sum of its series' statistics; an even chi-square's tail is a finite sum, so all stays in SQL."""
    rows = describe.moments(panel).groupBy("panel_id").agg(F.sum(jarque_bera_value()).alias("stat"), (2 * F.count("*")).cast("int").alias("df"))
    half = F.col("stat") / 2
    tail = F.aggregate(F.sequence(F.lit(1), (F.col("df") / 2).cast("int")), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
                       lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * half / i).alias("term")), lambda a: a["sum"])
    return rows.withColumn("p", F.exp(-half) * tail)


def ljung_box(panel: DataFrame, lags: int = 10) -> DataFrame:
    sizes = panel.groupBy(*ALONG).agg(F.count("value").alias("n"))
    rows = describe.autocorrelation(panel, lags).join(sizes, list(ALONG))
    q = F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag"))) * F.first("n") * (F.first("n") + 2)
    return rows.groupBy(*ALONG).agg(q.alias("q")).withColumn("p", wilson_hilferty(F.col("q"), F.lit(lags)))


def ordered_sums(panel: DataFrame) -> DataFrame:
    """Per series, from one ranked pass: n, moments, and what the tests on ordered values sum up.

    With F the clipped normal distribution at the i-th of n ordered z-scores: ad, the mean of
    (2i - 1) ln F + (2n + 1 - 2i) ln(1 - F), which is Anderson and Darling's sum with its mirrored half told by the
    same row; d, the largest gap to the empirical steps; and w2, Cramer and von Mises' statistic. The m rows of one value
    share F and are summed at once: with c rows before them, sums of 2i - 1 and of its square are differences of
    (c + m)^2 - c^2 and of i (4 i^2 - 1) / 3.
    """
    rows = describe.ranked_normal(panel)
    c, m, n, f = F.col("below").cast("double"), F.col("m").cast("double"), F.col("n").cast("double"), F.col("f")
    odd = m * (2 * c + m)
    cubes = lambda i: i * (4 * i * i - 1) / 3
    gap = F.greatest((c + m) / n - f, f - c / n)
    apart = m * f * f - f * odd / n + (cubes(c + m) - cubes(c)) / (4 * n * n)
    sums = rows.groupBy(*ALONG).agg(
        (F.sum(odd * F.log(f) + (2 * n * m - odd) * F.log(1 - f)) / F.first("n")).alias("ad"), F.max(gap).alias("d"), (1 / (12 * F.first("n")) + F.sum(apart)).alias("w2"))
    return describe.moments(panel).join(sums, list(ALONG))


def with_anderson_darling(sums: DataFrame) -> DataFrame:
    """stat, adjusted, and its piecewise p; under 8 rows (0, 1)."""
    n, short, a = F.col("n"), F.col("n") < 8, F.col("stat")
    # fixed values: the piecewise p of Stephens
    p = (
        F.when(a < 0.2, 1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a)).when(a < 0.34, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a))
        .when(a < 0.6, F.exp(0.9177 - 4.279 * a - 1.38 * a * a)).otherwise(F.exp(1.2937 - 5.709 * a + 0.0186 * a * a))
    )
    found = sums.withColumn("stat", F.when(short, 0.0).otherwise((-n - F.col("ad")) * (1 + 4 / n - 25 / (n * n))))
    return found.withColumn("p", F.when(short, 1.0).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))))


def anderson_darling(panel: DataFrame) -> DataFrame:
    return with_anderson_darling(ordered_sums(panel)).select(*ALONG, "stat", "p")


def kolmogorov_smirnov_p(n: Column, d: Column, terms: int = 100) -> Column:
    root = F.sqrt(n)
    lam = (root + 0.12 + 0.11 / root) * d
    series = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(n < 5, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))


def kolmogorov_smirnov(panel: DataFrame, terms: int = 100) -> DataFrame:
    n, d = F.col("n"), F.col("d")
    return ordered_sums(panel).select(*ALONG, F.when(n < 5, 0.0).otherwise(d).alias("d"), kolmogorov_smirnov_p(n, d, terms).alias("p"))


def with_cramer_von_mises(sums: DataFrame, draws: int, seed: int = 1234) -> DataFrame:
    """cvm and cvm_p. The null sample is drawn once for each series length that a batch holds."""

    def tail(n: pd.Series, w2: pd.Series) -> pd.Series:
        out = np.ones(len(n))
        for size in n[n >= 5].unique():
            at = (n == size).to_numpy()
            null = stats.cramer_von_mises_null(int(size), draws, seed)
            out[at] = (draws - np.searchsorted(null, w2[at], side="left")) / draws
        return pd.Series(out)

    return sums.withColumns({"cvm": F.when(F.col("n") < 5, 0.0).otherwise(F.col("w2")), "cvm_p": F.pandas_udf(tail, "double")("n", "w2")})


def cramer_von_mises(panel: DataFrame, draws: int = 500, seed: int = 1234) -> DataFrame:
    return with_cramer_von_mises(ordered_sums(panel), draws, seed).select(*ALONG, F.col("cvm").alias("w2"), F.col("cvm_p").alias("p"))


def normality_report(panel: DataFrame, draws: int = 500) -> DataFrame:
    """The univariate tests side by side, to four places, from one ranked pass."""
    n, d = F.col("n"), F.col("d")
    found = with_cramer_von_mises(with_anderson_darling(ordered_sums(panel)), draws).withColumn("jb", jarque_bera_value())
    told = {
        "skewness": F.col("skewness"), "excess_kurtosis": F.col("excess_kurtosis"), "jb": F.col("jb"), "jb_p": wilson_hilferty(F.col("jb"), F.lit(2)),
        "ad": F.col("stat"), "ad_p": F.col("p"), "ks": F.when(n < 5, 0.0).otherwise(d), "ks_p": kolmogorov_smirnov_p(n, d), "cvm": F.col("cvm"), "cvm_p": F.col("cvm_p"),
    }
    return found.select(*ALONG, *[F.round(x, 4).alias(name) for name, x in told.items()])


def arch_lm(panel: DataFrame, lags: int = 5) -> DataFrame:
    """LM test of the squares on their lags. Spark sums the cross products; a small solve per series finishes."""
    rows, own, order = with_history(panel.withColumn("_s0", F.col("value") * F.col("value")), ALONG, lags)
    rows = rows.withColumns({f"_s{k}": F.lag("_s0", k).over(order) for k in range(1, lags + 1)}).where(own & F.col(f"_s{lags}").isNotNull()).withColumn("_c", F.lit(1.0))
    names = ["_c", *[f"_s{k}" for k in range(1, lags + 1)], "_s0"]
    sums = rows.groupBy(*ALONG).agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).alias("g"))

    def finish(grams: pd.Series) -> pd.Series:
        out = []
        for g in grams:
            g = np.asarray(g).reshape(lags + 2, lags + 2)
            n, total = g[0, 0], g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
            b = np.linalg.pinv(g[:-1, :-1]) @ g[:-1, -1]
            out.append(n * (b @ g[:-1, -1] - g[0, -1] ** 2 / n) / total if total > special.EPS else 0.0)
        return pd.Series(out)

    found = sums.withColumn("lm", F.pandas_udf(finish, "double")("g")).drop("g")
    return found.withColumn("p", wilson_hilferty(F.col("lm"), F.lit(lags)))


def suggest_block_lengths(panel: DataFrame, max_lag: int = 24) -> DataFrame:
    """Per panel: the first lag that ends a run of three mean |acf| under 2 / sqrt(T), and block lengths from it and from T."""
    mean = describe.autocorrelation(panel, max_lag).groupBy("panel_id", "lag").agg(F.avg(F.abs("acf")).alias("m"))
    sizes = panel.groupBy("panel_id").agg(F.max("t").alias("n"))
    order = Window.partitionBy("panel_id").orderBy("lag")
    low = mean.join(sizes, "panel_id").withColumn("low", F.col("m") < 2 / F.sqrt("n"))
    run = low.withColumn("run", F.col("low") & F.lag("low", 1).over(order) & F.lag("low", 2).over(order))
    found = run.groupBy("panel_id").agg(F.coalesce(F.min(F.when(F.col("run"), F.col("lag"))), F.lit(max_lag)).alias("l_eff"), F.first("n").alias("n"))
    half = F.floor(F.col("n") / 2)
    return found.select(
        "panel_id", F.col("l_eff").cast("int").alias("l_eff"), F.least(F.greatest(F.lit(5), F.ceil(1.5 * F.col("l_eff"))), half).cast("long").alias("b1_acf"),
        F.least(F.greatest(F.lit(5), F.ceil(F.pow("n", F.lit(1 / 3)))), half).cast("long").alias("b2_t13"),
    )


def lagged(packed: DataFrame, lags: int, column: str = "y", transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """panel_id, t, z: z is an array of the row (after ``transform``) and of the rows 1 to ``lags`` before, null where there is none."""
    value = F.col(column) if transform is None else transform(F.col(column))
    rows, own, order = with_history(packed.select("panel_id", "t", value.alias("v")), ["panel_id"], lags)
    return rows.withColumn("z", F.array("v", *[F.lag("v", k).over(order) for k in range(1, lags + 1)])).where(own).select("panel_id", "t", "z")


def summed(rows: DataFrame, sums: Callable[[pd.DataFrame], np.ndarray], finish: Callable[[np.ndarray], tuple], names: list[str]) -> DataFrame:
    """One row of doubles per panel: ``finish`` of the total of ``sums`` over the panel's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([[key, *map(float, finish(np.asarray(s)))] for key, s in zip(batch["panel_id"], batch["s"], strict=True)], columns=["panel_id", *names])

    return array_sums(rows, "panel_id", sums).mapInPandas(run, ", ".join(["panel_id string", *[f"{n} double" for n in names]]))


def with_ones(own: pd.DataFrame) -> np.ndarray:
    """Rows of 1 and values for each lag, as stats.lagged_rows has them; zeros where a lag is missing."""
    n = len(own["z"].iloc[0][0])
    return np.stack([np.concatenate([np.zeros(n + 1) if x is None else np.r_[1.0, x] for x in z]) for z in own["z"]])


def as_square(flat: np.ndarray) -> np.ndarray:
    size = int(round(len(flat) ** 0.5))
    return flat.reshape(size, size)


def _from_products(rows: DataFrame, lags: int, finish: Callable[[np.ndarray, int], tuple], names: list[str]) -> DataFrame:
    def last(total: np.ndarray) -> tuple:
        g = as_square(total)
        return finish(g, len(g) // (lags + 1) - 1)

    return summed(rows, lambda own: stats.gram(with_ones(own)), last, names)


def _complete(rows: DataFrame, lags: int) -> DataFrame:
    return rows.where(F.col("z")[lags].isNotNull())


def multivariate_arch_lm(packed: DataFrame, lags: int = 2, vech: bool = True, column: str = "y") -> DataFrame:
    """Of the rows' outer products, by their lower triangles or, without ``vech``, whole; under lags + 3 rows (0, 0, 1)."""

    def outer(y: Column) -> Column:
        inner = lambda a, i: F.transform(F.slice(y, 1, i + 1) if vech else y, lambda b: a * b)
        return F.flatten(F.transform(y, inner))

    if lags < 1:
        return packed.select("panel_id").distinct().select("panel_id", *[F.lit(x).alias(n) for n, x in (("stat", 0.0), ("df", 0.0), ("p", 1.0))])

    def finish(g: np.ndarray, n: int) -> tuple:
        return stats.arch_from(g, n) if g[0, 0] > 2 else (0.0, 0, 1.0)

    rows = _complete(lagged(packed, lags, column, outer), lags)
    found = _from_products(rows, lags, finish, ["stat", "df", "p"])
    every = packed.select("panel_id").distinct().join(found, "panel_id", "left")  # panels too short for a complete row
    return every.select("panel_id", *[F.coalesce(n, F.lit(x)).alias(n) for n, x in (("stat", 0.0), ("df", 0.0), ("p", 1.0))])


def portmanteau(packed: DataFrame, lags: int = 10, column: str = "y") -> DataFrame:
    return _from_products(lagged(packed, lags, column), lags, stats.portmanteau_from, ["stat", "df", "p"])


def hosking(packed: DataFrame, lags: int = 10, square: bool = False, column: str = "y") -> DataFrame:
    """With ``square`` of the squared values: a check for changing variance."""
    of = (lambda y: F.transform(y, lambda v: v * v)) if square else None
    return _from_products(lagged(packed, lags, column, of), lags, stats.hosking_from, ["stat", "p", "df"])


def autocorrelation_lr(packed: DataFrame, lags: int = 5, column: str = "y") -> DataFrame:
    return _from_products(_complete(lagged(packed, lags, column), lags), lags, stats.autocorrelation_lr_from, ["stat", "p"])


def mardia(packed: DataFrame, robust: bool = False, column: str = "y") -> DataFrame:
    """Two passes of sums: means and covariances, one row a panel, and with them the third and fourth moments of whitened rows.
    The second pass takes rows in blocks, so that a panel's whitener travels once a block."""
    rows = packed.select("panel_id", F.array(column).alias("z"))

    def whiteners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for s in batch["s"]:
                g = as_square(np.asarray(s))
                mean = g[0, 1:] / g[0, 0]
                made.append((mean, stats.whitener(g[1:, 1:] / g[0, 0] - np.outer(mean, mean), robust).ravel()))
            yield pd.DataFrame({"panel_id": batch["panel_id"], "mean": [m for m, _ in made], "white": [w for _, w in made]})

    first = array_sums(rows, "panel_id", lambda own: stats.gram(with_ones(own))).mapInPandas(whiteners, "panel_id string, mean array<double>, white array<double>")

    def sums(own: pd.DataFrame) -> np.ndarray:
        mean = np.asarray(own["mean"].iloc[0])
        white = np.asarray(own["white"].iloc[0]).reshape(len(mean), -1)
        y = np.array([r["y"] for block in own["rows"] for r in block])
        return np.r_[stats.mardia_sums((y - mean) @ white), len(y), float(len(mean) * len(y))]

    def finish(total: np.ndarray) -> tuple:
        return stats.mardia_from(total[:-2], total[-2], int(round(total[-1] / total[-2])), robust)

    blocks = blocks_of(packed.select("panel_id", F.col(column).alias("y")), "panel_id")
    return summed(blocks.join(first, "panel_id"), sums, finish, ["skew_stat", "skew_p", "kurt_z", "kurt_p"])
