"""Order without one task a series: ranks and percentiles by ranges of values, and blocks of time with what the rows before them hand over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netdrift.session import stored

#: Distinct values of a key from which its values are dealt to ranges, and how many ranges.
RANGED, RANGES = 1 << 16, 1024
#: Rows of a block of time.
BLOCK = 1 << 14


def _summed_before(rows: DataFrame, by: list[str], value: str, weight: Column, name: str, ranged: int | None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over the rows of the key that are before them by ``value``, which does not
    repeat within ``by``.

    The rows of a key of over ``ranged`` rows are cut into ranges at approximate quantiles (a sketch of bounded size); rows
    are summed up in order inside a range, on top of the totals of the ranges before.
    """
    large = rows.groupBy(*by).agg(F.count("*").alias("_d")).where(F.col("_d") > (RANGED if ranged is None else ranged)).select(*by)
    cuts = rows.join(large, by, "left_semi").groupBy(*by).agg(F.percentile_approx(value, F.lit([i / RANGES for i in range(1, RANGES)]), F.lit(4 * RANGES)).alias("_cuts"))
    dealt = rows.join(cuts, by, "left").withColumn("_r", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value))))).drop("_cuts").withColumn("_w", weight)
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_r").agg(F.sum("_w").alias("_t")).select(*by, "_r", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(totals, [*by, "_r"])
    return summed.withColumn(name, F.col("_from") + F.col("_in")).select(*rows.columns, name)


def value_ranks(rows: DataFrame, by: Sequence[str], value: str, ranged: int | None = None) -> DataFrame:
    """``by``, ``value``, m, below, n: each distinct value of a key, how many rows have it, how many rows of the key are
    smaller, and how many rows the key has. Null values are no rows.

    Equal values are one row, so that ties have no edges and a value of any frequency is light.
    """
    by = list(by)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    sizes = counted.groupBy(*by).agg(F.sum("m").alias("n"))
    return _summed_before(counted, by, value, F.col("m"), "below", ranged).join(sizes, by)


def each_row(ranked: DataFrame, by: Sequence[str], value: str, chunk: int = BLOCK) -> DataFrame:
    """``ranked`` of value_ranks() with a row, and its place i from 1, for every row that was counted. A value that very many
    rows have is dealt out in chunks."""
    parts = ranked.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / chunk)))).repartition(*by, value, "_c")
    first, most = F.col("_c") * chunk + 1, F.least((F.col("_c") + 1) * chunk, F.col("m"))
    return parts.withColumn("i", F.explode(F.sequence(F.col("below") + first, F.col("below") + most))).drop("_c", "m", "below")


def percentiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float], name: str = "q") -> DataFrame:
    """``by`` and ``name``, an array: the exact percentiles of ``value`` at the shares ``at``, interpolated between order
    statistics. Null values are no rows; a key without others is left out. ``rows`` are read three times.

    A sketch of bounded size gives a narrow bracket of values about each order statistic, and a count of the rows below and
    inside tells whether it is in the bracket, before or behind it, so that the sketch's errors cost time alone. Only the distinct
    values of that range are then put in order: no task or buffer holds the values of a key.
    """
    by = list(by)
    some = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    edges = [min(max(p + d, 0.0), 1.0) for p in at for d in (-1 / RANGES, 1 / RANGES)]
    known = some.groupBy(*by).agg(F.percentile_approx("_v", F.lit(edges), F.lit(4 * RANGES)).alias("_e"))
    count = [F.count_if(F.col("_v") < F.col("_e")[i] if i % 2 == 0 else F.col("_v") <= F.col("_e")[i]).alias(f"_c{i}") for i in range(len(edges))]
    counted = some.join(known, by).groupBy(*by, "_e").agg(F.count("*").alias("_n"), *count)
    wanted = []
    for i, p in enumerate(at):
        low, high, below, upto = F.col("_e")[2 * i], F.col("_e")[2 * i + 1], F.col(f"_c{2 * i}"), F.col(f"_c{2 * i + 1}")
        for side, whole in enumerate((F.floor, F.ceil)):
            k = whole((F.col("_n") - 1) * F.lit(p))
            before, behind = k < below, k >= upto
            base = F.when(before, 0).when(behind, upto).otherwise(below)
            first, last = F.when(behind, high).when(~before, low), F.when(before, low).when(~behind, high)
            wanted.append(F.struct(F.lit(2 * i + side).alias("id"), k.alias("k"), base.alias("base"), first.alias("first"), last.alias("last"), before.alias("before"), behind.alias("behind")))
    asked = counted.select(*by, F.col("_n"), F.array(*wanted).alias("_w"))
    begins = lambda w: w["first"].isNull() | F.when(w["behind"], F.col("_v") > w["first"]).otherwise(F.col("_v") >= w["first"])
    ends = lambda w: w["last"].isNull() | F.when(w["before"], F.col("_v") < w["last"]).otherwise(F.col("_v") <= w["last"])
    near = some.join(asked, by).select(*by, "_n", "_v", F.explode(F.filter("_w", lambda w: begins(w) & ends(w))).alias("w"))
    ties = near.groupBy(*by, "_n", "w.id", "w.k", "w.base", "_v").agg(F.count("*").alias("_m"))
    upto = F.col("base") + F.sum("_m").over(Window.partitionBy(*by, "id").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = ties.withColumn("_to", upto).where((F.col("k") < F.col("_to")) & (F.col("k") >= F.col("_to") - F.col("_m")))
    picked = found.groupBy(*by, "_n").agg(*[F.max(F.when(F.col("id") == i, F.col("_v"))).alias(f"_s{i}") for i in range(2 * len(at))])
    out = []
    for i, p in enumerate(at):
        place, low, high = (F.col("_n") - 1) * F.lit(p), F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return picked.select(*by, F.array(*out).alias(name))


def positions(rows: DataFrame, by: Sequence[str], order: str, name: str = "t", ranged: int | None = None, written: bool = False) -> DataFrame:
    """``rows`` with their number from 1 along ``order``, which does not repeat within ``by``. They are written first, being read
    four times, unless they are ``written`` already."""
    numbered = _summed_before(rows if written else stored(rows, "ordered"), list(by), order, F.lit(1), "_before", ranged)
    return numbered.withColumn(name, (F.col("_before") + 1).cast("long")).drop("_before")


def quantile_ranges(rows: DataFrame, by: Sequence[str], values: Sequence[str], block: int = BLOCK, most: int = 256) -> DataFrame:
    """``rows`` with an int column ``value``_range for each of ``values``, which grows with the value: ranges of about ``block``
    rows (``most`` + 1 cuts at most). A value at a cut has a range of its own, so that one of very many rows stands alone there.
    """
    by = list(by)
    steps = F.lit([i / most for i in range(1, most)])
    found = rows.groupBy(*by).agg(F.count("*").alias("_n"), *[F.percentile_approx(v, steps, F.lit(16 * most)).alias(f"_{v}") for v in values])
    parts = F.least(F.lit(most), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("_n") / block, F.lit(1)))))).cast("int")
    cuts = found.select(*by, *[F.array_distinct(F.filter(f"_{v}", lambda _, i: (i + 1) % F.try_divide(F.lit(most), parts).cast("int") == 0)).alias(f"_{v}") for v in values])

    def place(v: str) -> Column:
        return (F.size(F.filter(f"_{v}", lambda c: c < F.col(v))) * 2 + F.array_contains(f"_{v}", F.col(v)).cast("int")).cast("int")

    return rows.join(cuts, by).withColumns({f"{v}_range": place(v) for v in values}).drop(*[f"_{v}" for v in values])


def with_history(rows: DataFrame, by: Sequence[str], before: int, after: int = 0, t: str = "t", block: int | None = None) -> tuple[DataFrame, Column, Window]:
    """``rows``, numbered by ``t``, dealt to blocks of time; which of a block's rows are its own; and the window over a block.

    A block also has copies of the last ``before`` rows ahead of it and of the first ``after`` rows behind it, so
    that lags, leads and frames of such reach are those of the whole series. Take the values, then keep the own rows.
    """
    block = max(BLOCK if block is None else block, before, after, 1)
    at = F.col(t) - 1
    dealt = rows.withColumn("_b", F.explode(F.sequence(F.greatest(F.floor((at - after) / block), F.lit(0)), F.floor((at + before) / block))))
    own = F.col("_b") == F.floor((F.col(t) - 1) / block)
    return dealt, own, Window.partitionBy(*by, "_b").orderBy(t)


def time_blocks(rows: DataFrame, by: Sequence[str], before: Column | str, t: str = "t", value: str = "value", block: int = BLOCK) -> DataFrame:
    """``by``, b, ahead, values: the values of each block of time in order, the first ``ahead`` of them from the blocks before.

    ``before``, a column or its name, is how many earlier rows a key's blocks need.
    """
    reach, at = F.col(before) if isinstance(before, str) else before, F.col(t) - 1
    dealt = rows.select(*by, at.alias("_at"), F.col(value).alias("_v"), F.explode(F.sequence(F.floor(at / block), F.floor((at + reach) / block))).alias("b"))
    packed = dealt.groupBy(*by, "b").agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_p"), F.max("_at").alias("_last"))
    ahead = F.size(F.filter("_p", lambda p: p["_at"] < F.col("b") * block))
    found = packed.where(F.col("_last") >= F.col("b") * block)  # not only what was handed over
    return found.select(*by, "b", ahead.alias("ahead"), F.transform("_p", lambda p: p["_v"]).alias("values"))
