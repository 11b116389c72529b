"""Unit-root tests, one row per series, and the vote of the three, from sums over blocks of time.

A series is dealt to blocks of its rows, each with as many rows before it as the test has lags. A block gives the products
of its regression's columns, or of its residuals at all lags; Spark adds them up, and what is left for a series is a
regression on a few sums. No task holds a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netdrift.functions import stats
from netdrift.session import stored

from . import order
from .order import positions, time_blocks
from .panel import ALONG
from .sums import array_sums

KEYS = list(ALONG)
RESULT = "panel_id string, series string, stat double, p double, lags int, nobs int, crit_1 double, crit_5 double, crit_10 double, error string"
#: Why a series has no numbers, if not told otherwise; also said of one whose autocovariances add up to nothing.
SHORT = "series too short or constant"


Series = tuple[DataFrame, DataFrame]


def _series(panel: DataFrame) -> Series:
    """Rows with a value, numbered anew by t and written for the tests' passes, and for every series (of no such row, too) n, mean, low, high and slope."""
    rows = positions(panel.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*KEYS, F.col("t").alias("_t"), "value"), KEYS, "_t", "t").drop("_t")
    rows = stored(rows, "series")
    sums = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.regr_slope("value", F.col("t").cast("double")).alias("slope"))
    sizes = panel.select(*KEYS).distinct().join(sums, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows, stored(sizes, "sizes")


def _pass(rows: DataFrame, known: DataFrame, before: Column, sums: Callable[[np.ndarray, int, int, object], np.ndarray]) -> DataFrame:
    """``known`` (a row for each series) with s: ``sums`` of (a block's values, the number of the first, how many of them are from earlier
    blocks, the series' row of ``known``), added up."""
    reach = known.withColumn("_before", before)
    blocks = time_blocks(rows.join(reach.select(*KEYS, "_before"), KEYS), KEYS, "_before", block=order.BLOCK)
    size = order.BLOCK

    def of_blocks(own: pd.DataFrame) -> np.ndarray:
        return np.sum([sums(np.asarray(r.values_, float), int(r.b) * size - int(r.ahead), int(r.ahead), r) for r in own.itertuples(index=False)], axis=0)

    return array_sums(blocks.withColumnRenamed("values", "values_").join(known, KEYS), KEYS, of_blocks).join(known, KEYS)


def _finished(sums: DataFrame, sizes: DataFrame, finish: Callable[[object], dict]) -> DataFrame:
    """RESULT of every series of ``sizes``: ``finish`` of its row of ``sums``, or why there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    d = finish(r)
                    out.append([r.panel_id, r.series, d["stat"], d["p"], d["lags"], d.get("nobs"), *d["critical"], None])
                except (ValueError, ZeroDivisionError) as why:
                    out.append([r.panel_id, r.series, *[None] * 7, str(why)])
            yield pd.DataFrame(out, columns=[*KEYS, "stat", "p", "lags", "nobs", "crit_1", "crit_5", "crit_10", "error"]).astype({"lags": "Int32", "nobs": "Int32"})

    told = sums.mapInPandas(run, RESULT)
    return sizes.select(*KEYS).join(told.withColumn("_met", F.lit(True)), KEYS, "left").withColumn("error", F.when(F.col("_met").isNull(), SHORT).otherwise(F.col("error"))).drop("_met")


def _varies(least: int = 3) -> Column:
    return (F.col("n") >= least) & (F.col("high") > F.col("low"))


def adf(panel: DataFrame, trend: str = "c") -> DataFrame:
    """Augmented Dickey-Fuller, lags by AIC on the common sample of all candidates; a failing series gives its error and no numbers."""
    return _adf(_series(panel), trend)


def _adf(series: Series, trend: str) -> DataFrame:
    trend, (rows, sizes) = stats.trend_name(trend), series
    most = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - {"n": 0, "c": 1, "ct": 2}[trend] - 1).cast("int")
    known = sizes.withColumns({"most": most, "shift": F.lit(0.0) if trend == "n" else F.col("mean")}).where(_varies(1) & (F.col("most") >= 0))
    known = known.select(*KEYS, "n", "most", "shift")

    def products(values: np.ndarray, first: int, ahead: int, r: object) -> np.ndarray:
        z = stats.adf_rows(values - r.shift, first, ahead, r.most, r.n)
        head = np.zeros(r.most + 1)
        if first == 0 and not ahead:
            head[: len(values)] = (values - r.shift)[: r.most + 1]
        return np.r_[(z.T @ z).ravel(), head]

    def finish(r: object) -> dict:
        size = r.most + 4
        s = np.asarray(r.s)
        return stats.adf_from(s[: size * size].reshape(size, size), s[size * size :], int(r.n), trend)

    return _finished(_pass(rows, known, F.col("most") + 1, products), sizes, finish)


def kpss(panel: DataFrame, trend: str = "c") -> DataFrame:
    """KPSS with the bandwidth of Hobijn and others, found from a first pass of the residuals' products."""
    return _kpss(_series(panel), trend)


def _kpss(series: Series, trend: str) -> DataFrame:
    if trend not in ("c", "ct"):
        raise ValueError("trend must be 'c' or 'ct'")
    rows, sizes = series
    known = sizes.where(_varies()).select(*KEYS, "n", "mean", (F.col("slope") if trend == "ct" else F.lit(0.0)).alias("slope"))
    residual = lambda values, first, r: values - r.mean - r.slope * (np.arange(first + 1, first + 1 + len(values)) - (r.n + 1) / 2)

    def some(values: np.ndarray, first: int, ahead: int, r: object) -> np.ndarray:
        return stats.lagged_products(residual(values, first, r), ahead, int(r.n ** (2 / 9)))

    def bandwidth(products: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([stats.kpss_lags(np.asarray(p), int(m)) for p, m in zip(products, n, strict=True)])

    first = _pass(rows, known, F.floor(F.pow(F.col("n").cast("double"), F.lit(2 / 9))), some)
    known = stored(first.withColumn("most", F.pandas_udf(bandwidth, "int")("s", "n")).drop("s").where("most >= 0"), "bandwidths")

    def whole(values: np.ndarray, first: int, ahead: int, r: object) -> np.ndarray:
        return stats.lagged_products(residual(values, first, r), ahead, r.most)

    # squares of running sums: of a block's own, shifted by what the blocks before sum up to
    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                c = np.cumsum(residual(np.asarray(r.values_, float), int(r.b) * size, r))
                out.append([r.panel_id, r.series, r.b, float(len(c)), c[-1], c.sum(), (c * c).sum()])
            yield pd.DataFrame(out, columns=[*KEYS, "b", "m", "total", "c1", "c2"])

    size = order.BLOCK
    blocks = time_blocks(rows, KEYS, F.lit(0), block=size).withColumnRenamed("values", "values_").join(known.drop("most"), KEYS)
    parts = blocks.mapInPandas(running, "panel_id string, series string, b bigint, m double, total double, c1 double, c2 double")
    before = F.coalesce(F.sum("total").over(Window.partitionBy(*KEYS).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    squares = parts.withColumn("o", before).groupBy(*KEYS).agg(F.sum(F.col("m") * F.col("o") * F.col("o") + 2 * F.col("o") * F.col("c1") + F.col("c2")).alias("squares"))
    sums = _pass(rows, known, F.col("most"), whole).join(squares, KEYS)
    return _finished(sums, sizes, lambda r: stats.kpss_from(np.asarray(r.s), r.squares, int(r.n), trend))


def _phillips_perron(series: Series, trend: str) -> DataFrame:
    trend, (rows, sizes) = stats.trend_name(trend), series
    known = sizes.where(_varies()).select(*KEYS, "n", F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))).cast("int").alias("most"), (F.lit(0.0) if trend == "n" else F.col("mean")).alias("shift"))

    def columns(values: np.ndarray, first: int, ahead: int, r: object) -> np.ndarray:
        x, t = values - r.shift, np.arange(max(ahead, 1 - first), len(values))
        return np.column_stack([np.ones(len(t)), (first + t) / r.n, x[t - 1], x[t]])

    def products(values: np.ndarray, first: int, ahead: int, r: object) -> np.ndarray:
        z = columns(values, first, ahead, r)
        return (z.T @ z).ravel()

    def regress(grams: pd.Series) -> pd.DataFrame:
        found = [stats.level_regression(np.asarray(g).reshape(4, 4), trend) for g in grams]
        return pd.DataFrame([[*b, error] for b, error, _ in found], columns=["b0", "b1", "b2", "error"])

    fitted = _pass(rows, known, F.lit(1), products).withColumn("fit", F.pandas_udf(regress, "b0 double, b1 double, b2 double, error double")("s")).drop("s")
    fitted = stored(fitted.select(*KEYS, "n", "most", "shift", "fit.b0", "fit.b1", "fit.b2", "fit.error"), "levels")

    def residuals(values: np.ndarray, first: int, ahead: int, r: object) -> np.ndarray:
        z = columns(values, first, 1, r)  # of the rows from earlier blocks, too
        e = z[:, 3] - z[:, :3] @ np.array([r.b0, r.b1, r.b2])
        return stats.lagged_products(e, max(ahead - 1, 0), r.most)

    sums = _pass(rows, fitted, F.col("most") + 1, residuals)
    return _finished(sums, sizes, lambda r: stats.phillips_perron_from(r.b2, r.error, np.asarray(r.s), int(r.n) - 1, trend))


def phillips_perron(panel: DataFrame, trend: str = "c") -> DataFrame:
    """Phillips-Perron, Z-tau with a Newey-West variance; a failing series fails the job."""
    found = _phillips_perron(_series(panel), trend)
    return found.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("string"))


def battery(panel: DataFrame, trend_adf: str = "c", trend_kpss: str = "c", trend_pp: str = "c", alpha: float = 0.05) -> DataFrame:
    """The three tests of every series with at least 20 rows, their decisions, and the strict majority of the valid ones."""
    series = _series(panel)
    found = series[1].where(F.col("n") >= 20).select(*KEYS)
    for name, tested in (("adf", _adf(series, trend_adf)), ("kpss", _kpss(series, trend_kpss)), ("pp", _phillips_perron(series, trend_pp))):
        found = found.join(tested.select(*KEYS, F.col("stat").alias(f"{name}_stat"), F.col("p").alias(f"{name}_p")), KEYS)
    votes = {"adf": F.col("adf_p") < alpha, "kpss": F.col("kpss_p") >= alpha, "pp": F.col("pp_p") < alpha}
    failed = {"adf": "Error", "kpss": "Error", "pp": "Not computed"}
    found = found.withColumns({f"{n}_decision": F.when(v.isNull(), failed[n]).when(v, "Stationary").otherwise("Non-stationary") for n, v in votes.items()})
    yes = sum(F.when(v, 1).otherwise(0) for v in votes.values())
    valid = sum(F.when(v.isNotNull(), 1).otherwise(0) for v in votes.values())
    told = F.concat(F.when(yes > valid / 2, "Stationary").otherwise("Non-stationary"), F.lit(" ("), yes.cast("string"), F.lit("/"), valid.cast("string"), F.lit(")"))
    return found.withColumn("majority", F.when(valid == 0, "Insufficient test information").otherwise(told))
