"""Panel preparation: choice of series, reshaping, ordinals, lagged designs, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import positions, with_history

ALONG = ("panel_id", "series")


def choose_series(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the named series; a name that no panel has is an error."""
    wanted = panel.sparkSession.createDataFrame([(n,) for n in names], "series string")
    missing = [r["series"] for r in wanted.join(panel.select("series").distinct(), "series", "left_anti").collect()]
    if missing:
        raise ValueError(f"no such series: {sorted(missing)}")
    return panel.where(F.col("series").isin(list(names)))


def to_wide(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per series, in the order given."""
    return panel.groupBy("panel_id", "ts").pivot("series", list(names)).agg(F.first("value"))


def to_long(wide: DataFrame, keys: Sequence[str] = ("panel_id", "ts")) -> DataFrame:
    """series, value rows of all columns but ``keys``."""
    return wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "series", "value")


def with_ordinal(rows: DataFrame, ts: str = "ts", by: Sequence[str] = ALONG) -> DataFrame:
    """Parse ``ts`` (text or time) and number the rows of each series by it, from 1."""
    parsed = rows.withColumn(ts, F.to_timestamp(ts))
    return parsed.withColumn("t", F.row_number().over(Window.partitionBy(*by).orderBy(ts)).cast("long"))


def coerce_numeric(rows: DataFrame, column: str = "value") -> DataFrame:
    """``column`` as double; what is no number, is null or NaN goes."""
    number = F.expr(f"try_cast(`{column}` AS double)")
    return rows.withColumn(column, number).where(F.col(column).isNotNull() & ~F.isnan(column))


def long_enough(panel: DataFrame, least: int = 20) -> DataFrame:
    """Series with at least ``least`` rows."""
    sizes = panel.groupBy(*ALONG).count().where(F.col("count") >= least).drop("count")
    return panel.join(sizes, list(ALONG), "left_semi")


def numeric_columns(df: DataFrame, least: int = 2) -> DataFrame:
    """The numeric columns; fewer than ``least`` is an error."""
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if len(found) < least:
        raise ValueError(f"{len(found)} numeric columns; {least} are needed")
    return df.select(*found)


def pack(panel: DataFrame) -> DataFrame:
    """panel_id, ts, t, y: the values of a date in the order of pos; dates that lack a series go."""
    rows = panel.groupBy("panel_id", "ts").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("packed"))
    rows = rows.join(rows.groupBy("panel_id").agg(F.max(F.size("packed")).alias("_n")), "panel_id").where(F.size("packed") == F.col("_n"))
    return positions(rows.select("panel_id", "ts", F.transform("packed", lambda x: x["value"]).alias("y")), ["panel_id"], "ts").select("panel_id", "ts", "t", "y")


def lagged_design(packed: DataFrame, p: int = 1, add_const: bool = True) -> DataFrame:
    """panel_id, ts, t, y, x: x holds y of 1 to p rows before and a final 1; the first p rows of a panel go."""
    if p < 1:
        raise ValueError("p must be 1 or more")
    dealt, own, order = with_history(packed, ["panel_id"], p)
    lags = [F.lag("y", i).over(order) for i in range(1, p + 1)]
    x = F.concat(*lags, F.array(F.lit(1.0))) if add_const else F.concat(*lags)
    return dealt.withColumn("x", x).where(own & (F.col("t") > p)).select("panel_id", "ts", "t", "y", "x")


def common_sample(design: DataFrame, max_p: int) -> DataFrame:
    """Designs of any lag order on the rows that order ``max_p`` has."""
    return design.where(F.col("t") > max_p)


def nonfinite(df: DataFrame) -> DataFrame:
    """column, n: how many values of each double or array-of-double column are NaN or infinite."""
    def bad(x):
        return F.isnan(x) | (F.abs(x) == float("inf"))

    counts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            counts.append((f.name, F.sum(F.when(bad(F.col(f.name)), 1).otherwise(0))))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            counts.append((f.name, F.sum(F.size(F.filter(f.name, bad)))))
    row = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts])
    return row.unpivot([], [n for n, _ in counts], "column", "n")


def relabel(rows: DataFrame, names: DataFrame, column: str = "series") -> DataFrame:
    """``column`` by the map ``names`` (key, label); what the map lacks keeps its name."""
    small = F.broadcast(names.select(F.col("key").alias("_key"), F.col("label").alias("_label")))
    joined = rows.join(small, F.col(column) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce("_label", column)).drop("_key", "_label")
