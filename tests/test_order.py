"""Ranks by ranges and blocks of time: equal to one sort of a whole series, with no task for a whole one."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netdrift.functions import special
from netdrift.operators import describe, diagnostics, events, order, panel, stationarity


@pytest.fixture(scope="module")
def long_series(spark):
    """One series of most rows, with a value that a third of them have, and two short ones; a few nulls."""
    rng = np.random.default_rng(12)
    x = np.where(rng.random(3000) < 0.33, 0.5, np.round(rng.normal(size=3000), 3))
    rows = [("p", "big", t + 1, 1, float(v)) for t, v in enumerate(x)] + [("p", s, t + 1, 2, float(v)) for s in "ab" for t, v in enumerate(rng.normal(size=40))]
    found = spark.createDataFrame(rows, "panel_id string, series string, t long, pos int, value double")
    return found.withColumn("ts", F.expr("date_add(date'2000-01-01', cast(t as int))")).repartition(5).cache()


def test_ranks_by_ranges(long_series, monkeypatch):
    monkeypatch.setattr(order, "RANGES", 7)
    by = Window.partitionBy("panel_id", "series").orderBy("value")
    want = {(r["series"], r["value"]): (r["m"], r["below"], r["n"]) for r in long_series.withColumns({
        "below": F.rank().over(by) - 1, "m": F.count("*").over(by.partitionBy("panel_id", "series", "value")), "n": F.count("*").over(Window.partitionBy("panel_id", "series"))}).collect()}
    for ranged in (100, 10**6):
        found = order.value_ranks(long_series, panel.ALONG, "value", ranged)
        assert {(r["series"], r["value"]): (r["m"], r["below"], r["n"]) for r in found.collect()} == want
    places = order.each_row(found, panel.ALONG, "value", 50).collect()
    assert sorted((r["series"], r["i"]) for r in places) == sorted([("big", i + 1) for i in range(3000)] + [(s, i + 1) for s in "ab" for i in range(40)])
    assert [r["value"] for r in sorted(places, key=lambda r: (r["series"], r["i"]))] == [r["value"] for r in long_series.orderBy("series", "value").collect()]
    numbered = order.positions(long_series.drop("t"), panel.ALONG, "ts", ranged=100)
    assert {(r["series"], r["ts"]): r["t"] for r in numbered.collect()} == {(r["series"], r["ts"]): r["t"] for r in long_series.collect()}
    assert order.value_ranks(long_series.where("false"), panel.ALONG, "value").count() == 0


def test_history_over_edges(long_series, monkeypatch):
    """With blocks of 16 rows, jobs give what they give with one block, and a block holds its own rows and what it is handed."""
    jobs = {
        "volatility": lambda p: describe.rolling_volatility(p, 10), "rolling": lambda p: describe.rolling_correlation(p, 12), "acf": lambda p: describe.autocorrelation(p, 8),
        "ccf": lambda p: describe.cross_correlation(p, 5), "arch": lambda p: diagnostics.arch_lm(p, 4), "design": lambda p: panel.lagged_design(panel.pack(p), 2),
        "hosking": lambda p: diagnostics.hosking(panel.pack(p), 4), "portmanteau": lambda p: diagnostics.portmanteau(panel.pack(p), 3),
    }
    shown = lambda df: sorted((tuple(np.round(x, 7) if isinstance(x, float) else tuple(np.round(x, 9)) if isinstance(x, list) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    some = long_series.where("t <= 300 OR series <> 'big'")
    whole = {name: shown(job(some)) for name, job in jobs.items()}
    monkeypatch.setattr(order, "BLOCK", 16)
    for name, job in jobs.items():
        assert shown(job(some)) == whole[name], name
    dealt, own, _ = order.with_history(some, panel.ALONG, 3, 2)
    assert dealt.where(own).count() == some.count() and dealt.groupBy("series", "_b").count().agg(F.max("count")).first()[0] <= 16 + 5


def test_time_blocks(long_series):
    found = order.time_blocks(long_series, panel.ALONG, F.lit(5), block=7).where("series = 'a'").orderBy("b").collect()
    x = [r["value"] for r in long_series.where("series = 'a'").orderBy("t").collect()]
    assert [r["values"][r["ahead"]:] for r in found] == [x[i : i + 7] for i in range(0, 40, 7)]
    assert all(r["values"][: r["ahead"]] == x[max(0, 7 * r["b"] - 5) : 7 * r["b"]] for r in found)
    reach = order.time_blocks(long_series, panel.ALONG, F.lit(20), block=7).where("series = 'a'").orderBy("b").collect()
    assert len(reach) == 6 and all(r["values"][: r["ahead"]] == x[max(0, 7 * r["b"] - 20) : 7 * r["b"]] for r in reach)


def test_ties_are_summed_at_once(long_series):
    """Tests on ordered values of a series with many ties, against plain loops over its rows."""
    import plain

    x = sorted(r["value"] for r in long_series.where("series = 'big'").collect())
    found = diagnostics.ordered_sums(long_series).where("series = 'big'").first()
    assert np.isclose((-found["n"] - found["ad"]) * (1 + 4 / 3000 - 25 / 3000**2), plain.anderson_darling(x)[0])
    assert np.isclose(found["d"], plain.kolmogorov_smirnov(x)[0]) and np.isclose(found["w2"], plain.cramer_von_mises(x, [0.0])[0])


@pytest.mark.parametrize("trend", ["n", "c", "ct"])
def test_unit_roots_by_blocks(spark, monkeypatch, trend):
    """Series of many kinds, cut to blocks of 32 rows, against the tests on whole series; nulls are no rows."""
    import plain

    rng = np.random.default_rng(14)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400)) + 50
    series = {"noise": noise, "walk": walk, "trend": noise + 0.1 * np.arange(400), "lagged": np.convolve(noise, [1, -0.6, 0.3])[:300], "short": noise[:9], "tiny": noise[:1], "flat": np.ones(30), "levels": 1e4 + walk[:200]}
    rows = [("p", s, t + 1, float(v)) for s, x in series.items() for t, v in enumerate(x)] + [("p", s, 1000 + i, None) for s in series for i in range(3)] + [("p", "none", 1, None)]
    rows = [(p, s, t * 2, v) for p, s, t, v in rows]  # numbers with gaps
    given = spark.createDataFrame(rows, "panel_id string, series string, t long, value double").repartition(3)
    monkeypatch.setattr(order, "BLOCK", 32)
    jobs = [(stationarity.adf, plain.adf), (lambda p, t: stationarity._phillips_perron(stationarity._series(p), t), plain.phillips_perron)] + [(stationarity.kpss, plain.kpss)] * (trend != "n")
    for job, truth in jobs:
        found = {r["series"]: r for r in job(given, trend).collect()}
        assert set(found) == {*series, "none"} and found["none"]["error"] == stationarity.SHORT
        for name, x in series.items():
            r = found[name]
            try:
                want = truth(x, trend)
            except ValueError as why:
                assert r["stat"] is None and r["error"] == str(why), name
                continue
            assert r["error"] is None and r["lags"] == want["lags"] and r["nobs"] == want.get("nobs"), (name, r, want)
            assert np.allclose([r["stat"], r["p"], r["crit_1"], r["crit_5"], r["crit_10"]], [want["stat"], want["p"], *want["critical"]], rtol=1e-5, atol=1e-8), (name, r, want)
    with pytest.raises(Exception, match="too short"):
        stationarity.phillips_perron(given, trend).collect()


def test_percentiles_by_brackets(spark, long_series, monkeypatch):
    at = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    rows = long_series.unionByName(long_series.limit(30).withColumn("value", F.lit(None).cast("double")))
    want = {r["series"]: r["q"] for r in rows.groupBy("series").agg(F.percentile("value", F.array(*[F.lit(p) for p in at])).alias("q")).collect()}
    assert {r["series"]: r["q"] for r in order.percentiles(rows, panel.ALONG, "value", at).collect()} == want
    # brackets that miss on either side: a sketch so coarse that its quantiles are far off
    coarse = F.percentile_approx
    for share in (0.9, 0.1):
        monkeypatch.setattr(order.F, "percentile_approx", lambda c, p, a, share=share: coarse(c, F.lit([share] * 2 * len(at)), F.lit(50)))
        assert {r["series"]: r["q"] for r in order.percentiles(rows, panel.ALONG, "value", at).collect()} == want
    monkeypatch.undo()
    assert order.percentiles(rows.where("value IS NULL"), panel.ALONG, "value", at).count() == 0


def test_concordance():
    rng = np.random.default_rng(5)
    for n, top in ((0, 3), (1, 3), (2, 2), (63, 5), (64, 10**6), (65, 4), (700, 30), (700, 10**6)):
        x, y = rng.integers(0, top, n), rng.integers(0, top, n)
        signs = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        assert special.concordance(x, y) == signs.sum() // 2
        rows, columns, count = rng.integers(0, 5, n), rng.integers(0, 7, n), np.ones(n, np.int64)
        assert special.grid_concordance(rows, columns, count) == (np.sign(rows[:, None] - rows) * np.sign(columns[:, None] - columns)).sum() // 2


@pytest.mark.parametrize("block", [40, 500, 10**6])
def test_kendall_by_ranges(spark, block):
    """Ties within and over ranges, a value that a third of the rows have on both sides, a constant side, infinite values."""
    rng = np.random.default_rng(6)
    n = 1200
    x = np.where(rng.random(n) < 0.33, 0.5, np.round(rng.normal(size=n), 1))
    y = np.where(rng.random(n) < 0.33, -0.5, np.round(x + rng.normal(size=n), 2))
    y[7] = np.inf
    rows = [("p", s, t + 1, i, float(v[t])) for i, (s, v) in enumerate({"x": x, "y": y, "z": np.ones(n)}.items()) for t in range(n)]
    found = spark.createDataFrame(rows, "panel_id string, series string, t long, pos int, value double").withColumn("ts", F.expr("date_add(date'2000-01-01', cast(t as int))"))
    got = {(r["a"], r["b"]): r["tau"] for r in describe.kendall_tau(found, block).collect()}
    ok = np.isfinite(y)
    signs = np.sign(x[ok][:, None] - x[ok]), np.sign(y[ok][:, None] - y[ok])
    want = (signs[0] * signs[1]).sum() / np.sqrt(float((signs[0] ** 2).sum()) * float((signs[1] ** 2).sum()))
    assert got["x", "y"] == pytest.approx(want, abs=1e-12)
    assert got["x", "z"] is None and got["y", "z"] is None
    assert describe.kendall_tau(found.where("false"), block).count() == 0


def test_ranges_stay_small(spark):
    rows = spark.range(20_000).select(F.lit("p").alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(3)).alias("v"))
    sizes = order.quantile_ranges(rows, ["k"], ["v"], 500).groupBy("v_range").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()
    assert max(r["n"] for r in sizes if r["d"] > 1) <= 700 and len(sizes) > 20


def test_intervals_by_stretches(spark):
    """Many periods of all lengths, reversed and unknown ones, against a plain comparison of all."""
    rng = np.random.default_rng(8)
    date = lambda d: None if d is None else (np.datetime64("1969-06-01") + int(d)).item()
    periods = [(i, date(s), date(s + w), f"n{i}") for i, (s, w) in enumerate(zip(rng.integers(0, 6000, 300), rng.choice([0, 3, 400, 3000, -5], 300), strict=True))] + [(300, None, date(9), "none"), (301, date(9), None, "none")]
    spans = [(f"s{i}", date(s), date(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 6000, 60), rng.choice([0, 30, 511, 512, 2000], 60), strict=True))] + [("far", date(90_000), date(90_001)), ("null", None, None)]
    given = spark.createDataFrame(periods, "ord int, start date, end date, name string")
    asked = spark.createDataFrame(spans, "series string, first date, last date")
    meets = lambda a, b, s, e: None not in (a, b, s, e) and s <= b and e >= a
    want = sorted((k, o) for k, a, b in spans for o, s, e, _ in periods if meets(a, b, s, e))
    assert sorted((r["series"], r["ord"]) for r in events.overlapping(asked, given, "first", "last").collect()) == want
    left = {(r["series"], r["ord"]) for r in events.overlapping(asked, given, "first", "last", "left").collect()}
    assert {x for x in left if x[1] is not None} == set(want) and {"far", "null"} <= {k for k, o in left if o is None}
    found = asked.where("first IS NOT NULL").select("series", F.col("first").alias("start_date"), F.col("last").alias("end_date"), F.lit(1).alias("duration_days"), F.lit(1.0).alias("max_value"))
    named = {r["series"]: r["events"] for r in events.episode_events(found, given).collect()}
    assert named == {k: " | ".join(n for _, s, e, n in periods if meets(a, b, s, e)) or "-" for k, a, b in spans if a}
    plan = events.episode_events(found, given)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_runs_over_ranges(spark, monkeypatch):
    """Episodes of a long series whose rows are numbered by ranges equal those of one pass."""
    monkeypatch.setattr(order, "RANGED", 50)
    monkeypatch.setattr(order, "RANGES", 9)
    rng = np.random.default_rng(9)
    v = np.repeat(rng.integers(0, 4, 150), rng.integers(1, 9, 150)).astype(float)
    t = np.cumsum(rng.integers(1, 3, len(v)))  # numbers with gaps
    day = lambda i: (np.datetime64("2001-01-01") + int(i)).item()
    index = spark.createDataFrame([("s", day(d), int(d), float(x)) for d, x in zip(t, v, strict=True)], "series string, ts date, t long, value double").repartition(7)
    hot = v >= np.percentile(v, 70)
    edges = np.flatnonzero(np.diff(np.r_[False, hot, False].astype(int)))
    want = sorted((day(t[a]), day(t[b - 1]), v[a:b].max()) for a, b in zip(edges[::2], edges[1::2], strict=True))
    assert sorted((r["start_date"], r["end_date"], r["max_value"]) for r in events.episodes(index, 70).collect()) == want
