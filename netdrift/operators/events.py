"""Percentile zones, significance classes, stress periods and critical episodes of index series.

Indices are (series, ts, t, value[, lo, hi]). Percentiles and runs come from ranges of values and of rows, and intervals
meet by the stretches of the calendar that they touch, so that no task holds a series and no side need be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdrift.session import stored

from .order import percentiles, positions

#: Days of a stretch of the calendar.
STRETCH = 512


def _stretch(date: Column | str) -> Column:
    return F.floor(F.unix_date(F.col(date) if isinstance(date, str) else date) / STRETCH)


def overlapping(spans: DataFrame, periods: DataFrame, first: str, last: str, how: str = "inner") -> DataFrame:
    """``spans`` (from ``first`` to ``last``) with the columns of each of ``periods`` (from ``start`` to ``end``) that overlaps.

    Both sides are dealt to the stretches of the calendar that they touch and meet in the first that they share. With
    ``how`` = "left" a span comes once for each stretch and period, and with nulls where there is none. Spans and periods
    without dates overlap nothing.
    """
    left = spans.withColumn("_b", F.explode_outer(F.sequence(_stretch(first), _stretch(last))))
    right = periods.withColumn("_c", F.explode(F.sequence(_stretch("start"), _stretch("end"))))
    meet = (F.col("start") <= F.col(last)) & (F.col("end") >= F.col(first)) & (F.col("_b") == F.greatest(_stretch(first), _stretch("start")))
    return left.join(right, (F.col("_b") == F.col("_c")) & meet, how).drop("_b", "_c")


def zones(index: DataFrame, burn_in: int = 200) -> DataFrame:
    """value with p95 and p99 of the rows after ``burn_in`` and the zone it falls in."""
    index = stored(index, "zones")
    bounds = percentiles(index.where(F.col("t") > burn_in), ["series"], "value", (0.95, 0.99), "_p")
    rows = index.join(bounds, "series").withColumns({"p95": F.col("_p")[0], "p99": F.col("_p")[1]}).drop("_p")
    return rows.withColumn("zone", F.when(F.col("value") > F.col("p99"), "above P99").when(F.col("value") >= F.col("p95"), "P95-P99").otherwise("normal"))


def stable_range(index: DataFrame, burn_in: int = 200, pad: float = 0.05) -> DataFrame:
    """Least and largest value (of the bands, where there are any) after ``burn_in``, with a pad."""
    low, high = (F.col("lo"), F.col("hi")) if {"lo", "hi"} <= set(index.columns) else (F.col("value"), F.col("value"))
    found = index.where(F.col("t") > burn_in).groupBy("series").agg(F.min(low).alias("least"), F.max(high).alias("most"))
    room = (F.col("most") - F.col("least")) * pad
    return found.select("series", (F.col("least") - room).alias("low"), (F.col("most") + room).alias("high"))


def sign_class(index: DataFrame) -> DataFrame:
    """class: significant or not, and the sign; 'zero' for an insignificant 0."""
    kind = (
        F.when(F.col("lo") > 0, "significant positive").when(F.col("hi") < 0, "significant negative")
        .when(F.col("value") > 0, "positive").when(F.col("value") < 0, "negative").otherwise("zero")
    )
    return index.withColumn("class", kind)


def periods_in_sample(index: DataFrame, periods: DataFrame, start_inside: bool = False) -> DataFrame:
    """Periods that overlap a series' dates, or with ``start_inside`` begin among them."""
    spans = index.groupBy("series").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    met = periods.withColumn("_end", F.col("end"))
    met = overlapping(spans, met.withColumn("end", F.col("start")) if start_inside else met, "first_ts", "last_ts")
    return met.select("series", "ord", "start", F.col("_end").alias("end"), "name")


def episodes(index: DataFrame, quantile: float = 95.0) -> DataFrame:
    """Runs of consecutive rows whose value, or upper band, reaches the series' percentile.

    start_date, end_date, duration_days (calendar days, both ends in), max_value (of the value itself).
    """
    index = stored(index, "episodes")
    limits = percentiles(index, ["series"], "value", (quantile / 100,), "_limit")
    upper = F.col("hi") >= F.col("_limit")[0] if "hi" in index.columns else F.lit(False)
    numbered = positions(index, ["series"], "t", "_at", written=True).join(limits, "series")
    hot = numbered.where((F.col("value") >= F.col("_limit")[0]) | F.coalesce(upper, F.lit(False))).select("series", "ts", "value", "_at")
    # along a run the number among all rows and that among the hot ones grow alike
    runs = positions(hot, ["series"], "_at", "_nth").withColumn("_run", F.col("_at") - F.col("_nth"))
    found = runs.groupBy("series", "_run").agg(F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.max("value").alias("max_value"))
    return found.select("series", "start_date", "end_date", (F.date_diff("end_date", "start_date") + 1).cast("long").alias("duration_days"), "max_value")


def episode_events(found: DataFrame, periods: DataFrame) -> DataFrame:
    """Episodes with the names of the periods they overlap, joined by ' | ' in the periods' order; '-' for none."""
    joined = overlapping(found, periods, "start_date", "end_date", "left")
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("ord", "name")))), lambda x: x["name"]), " | ")
    grouped = joined.groupBy("series", "start_date", "end_date", "duration_days", "max_value").agg(named.alias("events"))
    return grouped.withColumn("events", F.when(F.col("events") == "", "-").otherwise(F.col("events")))


def episode_summary(named: DataFrame) -> DataFrame:
    """Per series: episodes, those with an event, and their percentage."""
    hit = F.when(F.col("events") != "-", 1).otherwise(0)
    return named.groupBy("series").agg(F.count("*").alias("episodes"), F.sum(hit).cast("long").alias("with_event"), (F.avg(hit) * 100).alias("percent"))
