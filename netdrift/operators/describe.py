"""Descriptive statistics of series and of pairs of series. Panels as in sources.panels."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netdrift.functions import special
from netdrift.session import stored

from .order import BLOCK, each_row, percentiles, positions, quantile_ranges, value_ranks, with_history
from .panel import ALONG

TINY = 1e-12


def corr(x: str, y: str, over: Window | None = None) -> Column:
    """Correlation, null where a side is constant; as an aggregate, or over a window."""
    parts = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    cov, a, b = parts if over is None else (p.over(over) for p in parts)
    return F.try_divide(cov, a * b)


def summary(panel: DataFrame, value_pad: float = 0.05, time_pad: float = 0.02) -> DataFrame:
    """Per series: range of values (in hundredths) and dates, with the pads of an axis."""
    found = panel.groupBy(*ALONG).agg(
        F.count("value").alias("n"), (F.min("value") * 100).alias("low"), (F.max("value") * 100).alias("high"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    span = F.date_diff("last_ts", "first_ts")
    return found.withColumns({"value_pad": (F.col("high") - F.col("low")) * value_pad, "span_days": span.cast("long"), "time_pad_days": span * time_pad})


def pairs(panel: DataFrame, ordered: bool = False) -> DataFrame:
    """panel_id, ts, t, a, b, x, y: values of two series at the same date, a before b by pos.

    The dates' values are packed and exploded again, so that all pairs of a date come from one row.
    """
    rows = panel.where(F.col("value").isNotNull() & ~F.isnan("value"))
    packed = rows.groupBy("panel_id", "ts").agg(F.min("t").alias("t"), F.array_sort(F.collect_list(F.struct("pos", "series", "value"))).alias("v"))
    left = packed.select("panel_id", "ts", "t", "v", F.posexplode("v").alias("i", "one"))
    rest = F.filter("v", lambda x: x["pos"] != F.col("one.pos")) if ordered else F.filter("v", lambda x: x["pos"] > F.col("one.pos"))
    both = left.select("panel_id", "ts", "t", "one", F.explode(rest).alias("two"))
    return both.select("panel_id", "ts", "t", F.col("one.series").alias("a"), F.col("two.series").alias("b"), F.col("one.value").alias("x"), F.col("two.value").alias("y"))


def correlation(panel: DataFrame) -> DataFrame:
    """Pearson correlation of each pair over its common dates (lower triangle)."""
    return pairs(panel).groupBy("panel_id", "a", "b").agg(corr("x", "y").alias("corr"), F.count("*").alias("n"))


def rank_correlation(panel: DataFrame) -> DataFrame:
    """Spearman correlation of each pair: Pearson's of the average ranks, (rows below) + (rows of the value + 1) / 2.

    Rows of equal values are counted first and met by both ranks; their number weighs them.
    """
    by = ["panel_id", "a", "b"]
    rows = pairs(panel)
    counted = rows.groupBy(*by, "x", "y").agg(F.count("*").cast("double").alias("w"))
    rank = {v: value_ranks(rows, by, v).select(*by, v, (F.col("below") + (F.col("m") + 1) / 2 - (F.col("n") + 1) / 2).alias(f"r{v}")) for v in ("x", "y")}
    met = counted.join(rank["x"], [*by, "x"]).join(rank["y"], [*by, "y"])
    product = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))  # noqa: E731  # ranks are about their mean already
    scale = F.sqrt(product("rx", "rx")) * F.sqrt(product("ry", "ry"))
    return met.groupBy(*by).agg(F.try_divide(product("rx", "ry"), scale).alias("corr"), F.sum("w").cast("long").alias("n"))


def kendall_tau(panel: DataFrame, block: int = BLOCK) -> DataFrame:
    """Kendall's tau-b of each pair; null where a side is constant.

    x and y are cut into ranges of about ``block`` rows. Rows of unlike ranges of both are compared by counts of the cells
    of ranges; rows that share a range of x, of y or of both by a merge count of that range, and the last are taken off once,
    having been told twice. A range of a single value holds ties alone and is left out, so no task has more than a range.
    """
    by = ["panel_id", "a", "b"]
    finite = [F.col(v).between(-sys.float_info.max, sys.float_info.max) for v in ("x", "y")]
    rows = stored(quantile_ranges(pairs(panel).where(finite[0] & finite[1]).select(*by, "x", "y"), by, ("x", "y"), block), "kendall")

    def told(group: list[str], over: list[str], sign: int) -> DataFrame:
        """The concordance inside each group of rows; groups in which a side is constant are left out."""
        spread = rows.groupBy(*by, *group).agg(*[(F.min(v) < F.max(v)).alias(f"_{v}") for v in over]).where(" AND ".join(f"_{v}" for v in over)).select(*by, *group)

        def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[*key[:3], sign * special.concordance(part["x"].to_numpy(), part["y"].to_numpy())]], columns=[*by, "s"])

        return rows.join(spread, [*by, *group], "left_semi").groupBy(*by, *group).applyInPandas(one, kind)

    def cells(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, special.grid_concordance(part["x_range"].to_numpy(), part["y_range"].to_numpy(), part["c"].to_numpy())]], columns=[*by, "s"])

    kind = "panel_id string, a string, b string, s long"
    far = rows.groupBy(*by, "x_range", "y_range").agg(F.count("*").alias("c")).groupBy(*by).applyInPandas(cells, kind)
    near = told(["x_range"], ["x", "y"], 1).unionByName(told(["y_range"], ["x", "y"], 1)).unionByName(told(["x_range", "y_range"], ["x", "y"], -1))
    found = far.unionByName(near).groupBy(*by).agg(F.sum("s").alias("s"))
    couples = lambda n: F.col(n) * (F.col(n) - 1) / 2
    total = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, couples("n").alias("total"))
    for v in ("x", "y"):
        ties = rows.groupBy(*by, v).agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum(couples("n")).alias(f"on_{v}"))
        total = total.join(ties, by)
    scale = F.sqrt(F.col("total") - F.col("on_x")) * F.sqrt(F.col("total") - F.col("on_y"))
    return found.join(total, by).select(*by, F.try_divide(F.col("s").cast("double"), scale).alias("tau"))


def rolling_volatility(panel: DataFrame, window: int = 60) -> DataFrame:
    """Sample deviation over the last ``window`` rows; rows before the first full window go."""
    dealt, own, order = with_history(panel, ALONG, window - 1)
    frame = order.rowsBetween(-(window - 1), 0)
    rows = dealt.withColumns({"volatility": F.stddev_samp("value").over(frame), "_n": F.count("value").over(frame)})
    return rows.where(own & (F.col("_n") == window)).select("panel_id", "series", "ts", "t", "volatility")


def rolling_correlation(panel: DataFrame, window: int = 252) -> DataFrame:
    """Correlation of each pair over its last ``window`` common rows, beside that of all its rows; ``above`` compares them to nine places."""
    by = ["panel_id", "a", "b"]
    rows = positions(pairs(panel).drop("t"), by, "ts")
    static = rows.groupBy(*by).agg(corr("x", "y").alias("static"))
    dealt, own, order = with_history(rows, by, window - 1)
    frame = order.rowsBetween(-(window - 1), 0)
    kept = dealt.withColumns({"rolling": corr("x", "y", frame), "_n": F.count("*").over(frame)}).where(own & (F.col("_n") == window)).join(static, by)
    return kept.select(*by, "ts", "rolling", "static", (F.round("rolling", 9) >= F.round("static", 9)).alias("above"))


def histogram(panel: DataFrame, bins: int = 60, standardize: bool = False) -> DataFrame:
    """Density in equal bins from the least to the largest value, beside the normal density at the middles.

    Places are rounded to nine digits, so that a value on an edge does not move by rounding errors.
    """
    known = panel.groupBy(*ALONG).agg(
        F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"),
    )
    rows = panel.join(known, list(ALONG))
    if standardize:
        standard = {c: (F.col(c) - F.col("mu")) / F.greatest("sd", F.lit(TINY)) for c in ("value", "low", "high")}
        rows = rows.withColumns(standard).withColumns({"mu": F.lit(0.0), "sd": F.lit(1.0)})
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.least(F.floor(F.round((F.col("value") - F.col("low")) / width, 9)), F.lit(bins - 1))).otherwise(0).cast("int")
    found = rows.groupBy(*ALONG, place.alias("bin")).agg(F.count("*").alias("count"), *[F.first(c).alias(c) for c in ("mu", "sd", "low", "high", "n")])
    middle = F.col("low") + (F.col("bin") + 0.5) * width
    z = (middle - F.col("mu")) / F.col("sd")
    return found.select(*ALONG, "bin", "count", (F.col("count") / (F.col("n") * width)).alias("density"), middle.alias("middle"), (F.exp(-z * z / 2) / (F.col("sd") * np.sqrt(2 * np.pi))).alias("normal"))


def box(panel: DataFrame) -> DataFrame:
    """Quartiles, the last values inside 1.5 interquartile ranges, and how many lie outside."""
    quartiles = percentiles(panel, ALONG, "value", (0.25, 0.5, 0.75))
    quartiles = quartiles.select(*ALONG, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    rows = panel.join(quartiles, list(ALONG))
    return rows.groupBy(*ALONG, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"), F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("outliers"),
    )


def _ranked(panel: DataFrame) -> DataFrame:
    """value_ranks() of each series with its mean mu and deviation sd."""
    scale = panel.groupBy(*ALONG).agg(F.avg("value").alias("mu"), F.greatest(F.stddev_samp("value"), F.lit(TINY)).alias("sd"))
    return value_ranks(panel, ALONG, "value").join(scale, list(ALONG))


def normal_quantile(p: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(special.normal_quantile(s.to_numpy())), "double")(p)


def normal_cdf(z: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(special.normal_cdf(s.to_numpy())), "double")(z)


def qq_fit(panel: DataFrame) -> DataFrame:
    """Line through ordered values against the medians of normal order statistics: slope, intercept, r."""
    rows = each_row(_ranked(panel), ALONG, "value")
    half = F.pow(F.lit(0.5), 1 / F.col("n"))
    median = F.when(F.col("i") == F.col("n"), half).when(F.col("i") == 1, 1 - half).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    rows = rows.withColumn("q", normal_quantile(median))
    return rows.groupBy(*ALONG).agg(F.regr_slope("value", "q").alias("slope"), F.regr_intercept("value", "q").alias("intercept"), corr("value", "q").alias("r"))


def qq_points(panel: DataFrame) -> DataFrame:
    """Ordered z-scores against the approximate normal quantile of (i - 1/2) / T."""
    rows = each_row(_ranked(panel), ALONG, "value")
    approximate = F.pandas_udf(lambda s: pd.Series(np.sqrt(2) * special.approximate_erfinv(2 * s.to_numpy() - 1)), "double")
    return rows.select(*ALONG, "i", approximate((F.col("i") - 0.5) / F.col("n")).alias("theory"), ((F.col("value") - F.col("mu")) / F.col("sd")).alias("z"))


def ranked_normal(panel: DataFrame) -> DataFrame:
    """The distinct values of each series (m rows each, ``below`` of n before them), with f, the normal distribution at the
    z-score, clipped off 0 and 1."""
    p = normal_cdf((F.col("value") - F.col("mu")) / F.col("sd"))
    return _ranked(panel).withColumn("f", F.greatest(F.least(p, F.lit(1 - TINY)), F.lit(TINY)))


def pp_points(panel: DataFrame) -> DataFrame:
    """Empirical share i / T against the normal distribution at the ordered z-scores, clipped off 0 and 1."""
    return each_row(ranked_normal(panel), ALONG, "value").select(*ALONG, "i", (F.col("i") / F.col("n")).alias("empirical"), F.col("f").alias("normal"))


def autocorrelation(panel: DataFrame, lags: int = 24, square: bool = False) -> DataFrame:
    """series, lag, acf for lags 1 to ``lags``; 0 where a series does not vary. One sort of each block serves all lags."""
    value = F.col("value") * F.col("value") if square else F.col("value")
    means = panel.groupBy(*ALONG).agg(F.avg(value).alias("_mu"))
    dealt, own, order = with_history(panel.join(means, list(ALONG)).withColumn("d", value - F.col("_mu")), ALONG, lags)
    rows = dealt.withColumns({f"_{k}": F.lag("d", k).over(order) for k in range(1, lags + 1)}).where(own)
    sums = rows.groupBy(*ALONG).agg(F.sum(F.col("d") * F.col("d")).alias("_0"), F.array(*[F.sum(F.col("d") * F.col(f"_{k}")) for k in range(1, lags + 1)]).alias("c"))
    found = sums.select(*ALONG, "_0", F.posexplode("c").alias("k", "c"))
    return found.select(*ALONG, (F.col("k") + 1).alias("lag"), F.when(F.col("_0") < TINY, F.lit(0.0)).otherwise(F.coalesce(F.col("c"), F.lit(0.0)) / F.col("_0")).alias("acf"))


def acf_bound(panel: DataFrame, lags: int = 40) -> DataFrame:
    """Per series: the axis bound max(1.2 max |acf|, 0.1) over the values and their squares."""
    both = autocorrelation(panel, lags).unionByName(autocorrelation(panel, lags, square=True))
    return both.groupBy(*ALONG).agg(F.greatest(1.2 * F.max(F.abs("acf")), F.lit(0.1)).alias("bound"))


def cross_correlation(panel: DataFrame, lags: int = 24) -> DataFrame:
    """a, b, lag, ccf for lags -L to L: b ``lag`` rows after a; and the band 1.96 / sqrt(T)."""
    by = ["panel_id", "a", "b"]
    found = pairs(panel).drop("t")
    means = found.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    rows = positions(found, by, "ts").join(means, by).withColumns({"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my")})
    dealt, own, order = with_history(rows, by, lags, lags)
    shifted = dealt.withColumns({f"_{k + lags}": F.lead("y", k).over(order) if k >= 0 else F.lag("y", -k).over(order) for k in range(-lags, lags + 1)}).where(own)
    sums = shifted.groupBy(*by).agg(
        F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))), F.lit(TINY)).alias("norm"), F.count("*").alias("n"),
        F.array(*[F.sum(F.col("x") * F.col(f"_{k}")) for k in range(2 * lags + 1)]).alias("c"),
    )
    told = sums.select(*by, "norm", "n", F.posexplode("c").alias("k", "c"))
    return told.select(*by, (F.col("k") - lags).alias("lag"), (F.coalesce("c", F.lit(0.0)) / F.col("norm")).alias("ccf"), (1.96 / F.sqrt("n")).alias("band"))


def moment_columns() -> list[Column]:
    """n, population skewness and excess kurtosis of value, as aggregates; 0 where it does not vary."""
    flat = F.var_pop("value") <= TINY
    return [F.count("value").alias("n"), F.when(flat, 0.0).otherwise(F.skewness("value")).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis("value")).alias("excess_kurtosis")]


def moments(panel: DataFrame) -> DataFrame:
    """n, population skewness and excess kurtosis of each series."""
    return panel.groupBy(*ALONG).agg(*moment_columns())
