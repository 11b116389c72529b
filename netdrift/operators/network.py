"""Network tables: as-of theta, groups, net edges, significance, strengths, contribution shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import connect

OTHER = "Otros"


def panel_keys(rows: DataFrame) -> list[str]:
    """What tells panels apart: panel_id, where the table has one."""
    return [c for c in connect.keys(rows) if c != "ts"]


def month(date: Column) -> Column:
    return F.trunc(date, "month")


def as_of(requests: DataFrame, dates: DataFrame, how: str = "pad") -> DataFrame:
    """``requests`` (request, wanted) with ts: the date that stands for it.

    how: 'exact', 'pad' (the last before or at), 'backfill' (the first after or at), 'nearest' (the earlier of two
    equally near), 'last' (the last of all). Where ``dates`` has panel_id, requests name their panel. Requests outside clamp to the ends, but for 'exact', which gives null.
    A panel's dates and requests are ordered within a calendar month; what the months before and after hand over comes from
    a table of one row per panel and month.
    """
    by = panel_keys(dates)
    marks = dates.select(*by, F.col("ts").alias("at"), F.lit(None).cast("string").alias("request"), F.col("ts").alias("ts")).distinct()
    asked = requests.select(*by, F.col("wanted").alias("at"), "request", F.lit(None).cast("date").alias("ts"))
    both = marks.unionByName(asked).withColumn("_m", month(F.col("at")))
    along = Window.partitionBy(*by, F.lit(0)).orderBy("_m")
    months = both.groupBy(*by, "_m").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    months = months.withColumns({
        "_earlier": F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        "_later": F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)),
        "final": F.max("_last").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).drop("_first", "_last")
    inside = Window.partitionBy(*by, "_m")
    rows = both.withColumns({
        "before": F.last("ts", ignorenulls=True).over(inside.orderBy("at", F.col("request").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first("ts", ignorenulls=True).over(inside.orderBy("at", F.col("request").isNull()).rowsBetween(0, Window.unboundedFollowing)),
    }).where(F.col("request").isNotNull())
    rows = rows.join(months, [*by, "_m"]).withColumns({"before": F.coalesce("before", "_earlier"), "after": F.coalesce("after", "_later")})
    nearer = F.when(F.date_diff("at", "before") <= F.date_diff("after", "at"), F.col("before")).otherwise(F.col("after"))
    found = {
        "exact": F.when(F.col("before") == F.col("at"), F.col("before")),
        "pad": F.coalesce("before", "after"),
        "backfill": F.coalesce("after", "before"),
        "nearest": F.coalesce(nearer, "before", "after"),
        "last": F.col("final"),
    }
    if how not in found:
        raise ValueError(f"how must be one of {sorted(found)}")
    return rows.select(*by, "request", F.col("at").alias("wanted"), found[how].alias("ts"))


def theta_as_of(theta: DataFrame, requests: DataFrame, how: str = "pad") -> DataFrame:
    """theta at the dates that stand for the requests, by panel where theta has panel_id."""
    return as_of(requests, theta.select(*connect.keys(theta)).distinct(), how).join(theta, connect.keys(theta))


def group_of(nodes: DataFrame, groups: DataFrame, column: str = "node") -> DataFrame:
    """``nodes`` with grp; nodes that ``groups`` (node, grp) lacks are 'Otros'."""
    small = groups.select(F.col("node").alias("_node"), F.col("grp").alias("_grp"))
    return nodes.join(small, F.col(column) == F.col("_node"), "left").withColumn("grp", F.coalesce("_grp", F.lit(OTHER))).drop("_node", "_grp")


def group_theta(theta: DataFrame, groups: DataFrame, normalize: bool = True) -> DataFrame:
    """theta summed between groups, rows summing to 1 unless ``normalize`` is off."""
    by = connect.keys(theta)
    named = group_of(theta, groups, "to_node").withColumnRenamed("grp", "_to")
    named = group_of(named, groups, "from_node").withColumnRenamed("grp", "_from")
    summed = named.groupBy(*by, F.col("_to").alias("to_node"), F.col("_from").alias("from_node")).agg(F.sum("theta").alias("theta"))
    if not normalize:
        return summed
    total = F.sum("theta").over(Window.partitionBy(*by, "to_node"))
    return summed.withColumn("theta", F.col("theta") / F.when(total == 0, 1.0).otherwise(total))


def role(value: Column, eps: float = 1e-12) -> Column:
    """'emitter', 'receiver' or 'neutral' of a net value."""
    return F.when(value > eps, "emitter").when(value < -eps, "receiver").otherwise("neutral")


def net_edges(theta: DataFrame, threshold: float = 0.0) -> DataFrame:
    """source, target, weight of each unordered pair whose net exceeds ``threshold``; equal pairs give none.

    theta(i, j) - theta(j, i) above 0 means that i receives more: the edge runs from j to i.
    """
    by = connect.keys(theta)
    both = theta.where("to_node <> from_node").select(
        *by, F.least("to_node", "from_node").alias("i"), F.greatest("to_node", "from_node").alias("j"), F.when(F.col("to_node") < F.col("from_node"), F.col("theta")).otherwise(-F.col("theta")).alias("w")
    )
    summed = both.groupBy(*by, "i", "j").agg(F.sum("w").alias("w")).where(F.abs("w") > threshold)
    up = F.col("w") > 0
    return summed.select(*by, F.when(up, F.col("j")).otherwise(F.col("i")).alias("source"), F.when(up, F.col("i")).otherwise(F.col("j")).alias("target"), F.abs("w").alias("weight"))


def significant(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def node_significance(nodes: DataFrame, bands: DataFrame) -> DataFrame:
    """``nodes`` (ts, node, ...) with lo, hi and significant from ``bands`` (ts, node, lo, hi); both may have panel_id."""
    return nodes.join(bands, [*connect.keys(nodes), "node"]).withColumn("significant", significant(F.col("lo"), F.col("hi")))


def edge_significance(edges: DataFrame, bands: DataFrame) -> DataFrame:
    """``edges`` with significant from ``bands`` (ts, node, node2, lo, hi); an edge without a band counts as such.

    A band may be told for either orientation of a pair, whose sign does not matter. Both tables may have panel_id.
    """
    by = connect.keys(edges)
    told = bands.select(*by, F.least("node", "node2").alias("_i"), F.greatest("node", "node2").alias("_j"), significant(F.col("lo"), F.col("hi")).alias("_s"))
    told = told.groupBy(*by, "_i", "_j").agg(F.bool_or("_s").alias("_s"))
    keyed = edges.withColumns({"_i": F.least("source", "target"), "_j": F.greatest("source", "target")})
    return keyed.join(told, [*by, "_i", "_j"], "left").withColumn("significant", F.coalesce("_s", F.lit(True))).drop("_i", "_j", "_s")


def out_strength(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per date and node (and panel): the sum of its outgoing weights and its share of the largest; nodes without edges 0."""
    by = connect.keys(edges)
    sums = edges.groupBy(*by, F.col("source").alias("node")).agg(F.sum("weight").alias("strength"))
    filled = nodes.select(*by, "node").join(sums, [*by, "node"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    top = F.max("strength").over(Window.partitionBy(*by))
    return filled.withColumn("share", F.when(top > 0, F.col("strength") / top).otherwise(0.0))


def relative_weight(edges: DataFrame, over_dates: bool = False) -> DataFrame:
    """weight relative to the largest of its date, or of all of the panel's dates (a largest of 0 or less counts as 1)."""
    if over_dates:
        by = panel_keys(edges)
        top = edges.groupBy(*by).agg(F.max("weight").alias("_top"))
        found = edges.join(top, by) if by else edges.crossJoin(F.broadcast(top))  # one row without panels
    else:
        found = edges.withColumn("_top", F.max("weight").over(Window.partitionBy(*connect.keys(edges))))
    return found.withColumn("relative", F.col("weight") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)).drop("_top")


def every(dates: DataFrame, step: int = 1, wanted: Sequence[str] | None = None) -> DataFrame:
    """Every ``step``-th of the ordered dates (of each panel) from the first on, or the listed ones. Dates are numbered
    within their month, on top of how many the months before have."""
    by = panel_keys(dates)
    found = dates.select(*by, "ts").distinct()
    if wanted is not None:
        listed = dates.sparkSession.createDataFrame([(d,) for d in wanted], "d string").select(F.to_date("d").alias("ts"))
        return found.join(listed, "ts", "left_semi")
    dealt = found.withColumn("_m", month(F.col("ts")))
    so_far = F.sum("_n").over(Window.partitionBy(*by, F.lit(0)).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    months = dealt.groupBy(*by, "_m").agg(F.count("*").alias("_n")).select(*by, "_m", F.coalesce(so_far, F.lit(0)).alias("_from"))
    numbered = dealt.withColumn("_t", F.row_number().over(Window.partitionBy(*by, "_m").orderBy("ts"))).join(months, [*by, "_m"])
    return numbered.where((F.col("_from") + F.col("_t") - 1) % max(1, step) == 0).select(*by, "ts")


def contributions(theta: DataFrame, target: str | None = None, include_self: bool = True, order: Sequence[str] | None = None) -> DataFrame:
    """ts, to_node, from_node, share: what each node contributes to a target (or to every one), to 100 percent, by panel
    where theta has panel_id.

    ``place`` orders the contributors: those named in ``order`` first and in its order, then the others (by mean share
    where there is no ``order``, by name where there is), with the target itself last.
    """
    by, of = connect.keys(theta), panel_keys(theta)
    rows = theta if target is None else theta.where(F.col("to_node") == target)
    rows = rows if include_self else rows.where("to_node <> from_node")
    total = F.sum("theta").over(Window.partitionBy(*by, "to_node"))
    rows = rows.select(*by, "to_node", "from_node", (100 * F.col("theta") / F.when(total == 0, 1.0).otherwise(total)).alias("share"))
    own = F.when(F.col("to_node") == F.col("from_node"), 1).otherwise(0)
    means = rows.groupBy(*of, "to_node", "from_node").agg(F.avg("share").alias("mean"))
    first = F.desc(F.round("mean", 9)) if order is None else F.coalesce(*[F.when(F.col("from_node") == c, i) for i, c in enumerate(order)], F.lit(len(order)))
    place = F.row_number().over(Window.partitionBy(*of, "to_node").orderBy(own, first, "from_node"))
    return rows.join(means.select(*of, "to_node", "from_node", place.alias("place")), [*of, "to_node", "from_node"])


def pair_name(a: Column, b: Column, longest: int = 12) -> Column:
    return F.concat_ws(" vs ", F.substring(a, 1, longest), F.substring(b, 1, longest))
