"""Jobs on the given small tables against SQL, and on edge fixtures."""

import datetime
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from netdrift.functions import kernels, stats
from netdrift.operators import bootstrap, connect, describe, diagnostics, events, matrices, model, network, panel, stationarity
from netdrift.plans import queries, sql
from netdrift.sources import panels

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2000, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x.isoformat()[:10] if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_equals_sql(spark, con, name):
    found = queries.QUERIES[name](spark, SF)
    rel = con.sql(sql.ORACLE[name])
    order = sorted(rel.columns)
    assert order == sorted(found.columns)
    at = [list(rel.columns).index(c) for c in order]
    want = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(value(x) for x in r) for r in found.select(*order).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(8)
    rows = [(p, day(t), t + 1, s, i + 1, float(rng.normal())) for p in ("a", "b") for i, s in enumerate(("u", "v", "w")) for t in range(80)]
    return spark.createDataFrame(rows, "panel_id string, ts date, t long, series string, pos int, value double").cache()


def test_panel_errors(two):
    with pytest.raises(ValueError, match="no such series"):
        panel.choose_series(two, ["u", "missing"])
    with pytest.raises(ValueError):
        panel.lagged_design(panel.pack(two), 0)
    with pytest.raises(ValueError):
        panel.numeric_columns(two.select("panel_id", "value"))
    assert panel.lagged_design(panel.pack(two), 80).count() == 0


def test_univariate_jobs_equal_kernels(two):
    rows = {(r["panel_id"], r["series"]): r for r in two.groupBy("panel_id", "series").agg(F.collect_list(F.struct("t", "value")).alias("v")).collect()}
    series = {k: np.array([x["value"] for x in sorted(r["v"], key=lambda x: x["t"])]) for k, r in rows.items()}
    null = stats.cramer_von_mises_null(80, 500)
    for job, kernel, names in (
        (diagnostics.jarque_bera(two), stats.jarque_bera, ("jb", "p")), (diagnostics.anderson_darling(two), plain.anderson_darling, ("stat", "p")),
        (diagnostics.kolmogorov_smirnov(two), plain.kolmogorov_smirnov, ("d", "p")), (diagnostics.cramer_von_mises(two), lambda x: plain.cramer_von_mises(x, null), ("w2", "p")),
        (diagnostics.ljung_box(two, 6), lambda x: plain.ljung_box(x, 6), ("q", "p")), (diagnostics.arch_lm(two, 3), lambda x: plain.arch_lm(x, 3), ("lm", "p")),
    ):
        for r in job.collect():
            want = kernel(series[r["panel_id"], r["series"]])
            assert np.allclose([r[n] for n in names], want, atol=1e-8), names


def test_multivariate_jobs_equal_plain_loops(two, spark):
    packed = panel.pack(two).repartition(7, "t").cache()  # a panel's rows lie in many tasks
    w = {p: np.array([r["y"] for r in sorted(packed.where(F.col("panel_id") == p).collect(), key=lambda r: r["t"])]) for p in ("a", "b")}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # and in many batches
    try:
        for job, truth, name in (
            (diagnostics.hosking(packed), lambda x: plain.hosking(x, 10), "stat"), (diagnostics.hosking(packed, square=True), lambda x: plain.hosking(x**2, 10), "stat"),
            (diagnostics.portmanteau(packed), lambda x: plain.portmanteau(x, 10), "stat"), (diagnostics.autocorrelation_lr(packed), lambda x: plain.autocorrelation_lr(x, 5), "stat"),
            (diagnostics.multivariate_arch_lm(packed), lambda x: plain.arch_lm(x, 2)[0], "stat"), (diagnostics.multivariate_arch_lm(packed, vech=False), lambda x: plain.arch_lm(x, 2, whole=True)[0], "stat"),
            (diagnostics.mardia(packed), lambda x: plain.mardia(x)[0], "skew_stat"), (diagnostics.mardia(packed, robust=True), lambda x: plain.mardia(x)[1], "kurt_z"),
        ):
            found = {r["panel_id"]: r[name] for r in job.collect()}
            assert set(found) == {"a", "b"} and all(abs(found[p] - truth(w[p])) < 1e-8 for p in w), name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    short = packed.where("t <= 4")
    assert {tuple(r)[1:] for r in diagnostics.multivariate_arch_lm(short, 2).collect()} == {(0.0, 0.0, 1.0)} == {tuple(r)[1:] for r in diagnostics.multivariate_arch_lm(packed, 0).collect()}
    assert diagnostics.mardia(short, robust=True).first()["skew_p"] == 1.0


def test_constant_series(spark):
    rows = [("a", day(t), t + 1, s, i, v) for t in range(30) for i, (s, v) in enumerate((("flat", 1.0), ("line", float(t))), 1)]
    flat = spark.createDataFrame(rows, "panel_id string, ts date, t long, series string, pos int, value double")
    assert describe.correlation(flat).first()["corr"] is None
    assert {r["series"]: r["skewness"] for r in describe.moments(flat).collect()}["flat"] == 0.0
    assert all(r["acf"] == 0 for r in describe.autocorrelation(flat, 3).where("series = 'flat'").collect())
    assert describe.histogram(flat).where("series = 'flat'").count() == 1
    adf = {r["series"]: r for r in stationarity.adf(flat).collect()}
    assert adf["flat"]["stat"] is None and adf["flat"]["error"]
    vote = {r["series"]: r for r in stationarity.battery(flat).collect()}["flat"]
    assert vote["adf_decision"] == "Error" and vote["pp_decision"] == "Not computed"
    assert stationarity.battery(flat.where("t <= 19")).count() == 0


def test_connectedness_invariants(two):
    long = model.connectedness(two, horizon=8).cache()
    assert long.groupBy("panel_id", "ts", "to_node").agg(F.sum("theta").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    total = {(r["panel_id"], r["ts"]): r["tci"] for r in connect.tci(long).collect()}
    trace = {(r["panel_id"], r["ts"]): r["tci"] for r in connect.tci_from_trace(long).collect()}
    assert all(abs(total[k] - trace[k]) < 1e-9 for k in total) and len(total) == 2 * 79
    nets = connect.net(long).groupBy("panel_id", "ts").agg(F.sum("net_idx").alias("s"))
    assert nets.where(F.abs("s") > 1e-9).count() == 0
    everything = connect.sub_network(long, ["u", "v", "w"])
    assert connect.tci(everything).join(connect.tci(long).withColumnRenamed("tci", "whole"), ["panel_id", "ts"]).where(F.abs(F.col("tci") - F.col("whole")) > 1e-9).count() == 0
    assert connect.sub_network(long, []).count() == 0
    with pytest.raises(ValueError):
        connect.sub_network(long, ["u", "nobody"])
    # the one-pass indices equal the aggregates over the long table, and so do those of a sub-network
    told = {(r["panel_id"], r["ts"], r["node"]): r for r in model.connectedness_indices(two, horizon=8, sub_nodes=["u", "w"]).collect()}
    inner = connect.sub_network(long, ["u", "w"])
    for whole, columns in ((connect.net(long), ("to_idx", "from_idx", "net_idx")), (connect.net(inner).withColumnRenamed("net_idx", "net_sub"), ("net_sub",))):
        for r in whole.collect():
            assert np.allclose([told[r["panel_id"], r["ts"], r["node"]][c] for c in columns], [r[c] for c in columns], atol=1e-9)
    sub = {(r["panel_id"], r["ts"]): r["tci"] for r in connect.tci(inner).collect()}
    assert len(told) == 3 * 2 * 79 and all(abs(r["tci"] - total[k[:2]]) < 1e-9 and abs(r["tci_sub"] - sub[k[:2]]) < 1e-9 for k, r in told.items())
    with pytest.raises(Exception, match="no such node"):
        model.connectedness_indices(two, sub_nodes=["nobody"]).collect()


def test_one_node(spark):
    theta = spark.createDataFrame([(day(0), "a", "a", 1.0)], "ts date, to_node string, from_node string, theta double")
    assert [tuple(r)[1:] for r in connect.net(theta).collect()] == [("a", 0.0, 0.0, 0.0)] and connect.tci(theta).first()["tci"] == 0.0


def test_fit_equals_kernel(two):
    got = {r["t"]: r for r in model.fit(model.packed_design(two), keep=("gain", "p_filt", "p_pred")).where("panel_id = 'a'").collect()}
    y = np.array([r["y"] for r in sorted(panel.pack(two).where("panel_id = 'a'").collect(), key=lambda r: r["t"])])
    x = np.hstack([y[:-1], np.ones((79, 1))])
    _, sigma0, a0, p0 = kernels.ols_prior(y[1:], x)
    f = kernels.kalman(y[1:], x, sigma0, a0, p0, 0.99, 0.96, ("beta", "sigma"))
    for t in (1, 40, 79):
        assert np.allclose(got[t]["beta"], f.beta[0, t - 1]) and np.allclose(got[t]["sigma"], f.sigma[0, t - 1].ravel())
    assert np.allclose(got[1]["sigma_before"], sigma0.ravel()) and np.allclose(got[2]["sigma_before"], got[1]["sigma"]) and len(got[1]["gain"]) == 36


def test_selection(two):
    designs = model.all_designs(two, (1, 2)).cache()
    grid = model.grid_search(designs, (1, 2), (0.95, 0.99), (0.95, 0.99))
    assert grid.count() == 16 and {r["t_eff"] for r in grid.collect()} == {78}
    done = model.diagnose(grid, designs, top=3)
    assert done.where("tested").count() == 6
    best = {r["panel_id"]: r for r in model.choose(done).collect()}
    least = {r["panel_id"]: r["m"] for r in grid.groupBy("panel_id").agg(F.min("aic").alias("m")).collect()}
    assert all(best[p]["passed"] or best[p]["aic"] == least[p] for p in best)
    found = {r["panel_id"]: r for r in model.continuous_search(designs.where('p = 1'), 0.95, 0.99, n_starts=2, tol=1e-3).collect()}
    corner = {r["panel_id"]: r["m"] for r in grid.where("p = 1").groupBy("panel_id").agg(F.min("aic").alias("m")).collect()}
    assert all(found[p]["opt_success"] for p in found) and set(corner) == set(found)


def test_bootstrap_does_not_depend_on_partitions(two):
    small = two.where("panel_id = 'a'")
    one, many = (sorted((r["rep"], r["t"], r["tci"], tuple(r["pdc"])) for r in bootstrap.draws(small, 6, 10, horizon=5, sub_nodes=("u", "v"), chunk=c).collect()) for c in (6, 1))
    assert np.allclose([x[2] for x in one], [x[2] for x in many], rtol=1e-8) and len(one) == 6 * 79
    drawn = bootstrap.draws(small, 6, 10, horizon=5)
    assert drawn.where("tci_sub <> 0").count() == 0
    assert bootstrap.bands(drawn).where("lo > hi").count() == 0
    found = bootstrap.named_bands(bootstrap.bands(drawn), small).collect()
    assert {(r["node"], r["node2"]) for r in found if r["metric"] == "pdc"} == {("u", "v"), ("u", "w"), ("v", "w")} and {r["node"] for r in found if r["metric"] == "net"} == {"u", "v", "w"}
    assert {r["ts"] for r in found} == {day(i) for i in range(1, 80)} and all((r["node"] is None) == r["metric"].startswith("tci") for r in found)
    values = {(r["rep"], r["t"]): r for r in drawn.collect()}
    for r in found:
        t = (r["ts"] - DAY).days
        at = {"net": "uvw".find(r["node"] or ""), "pdc": ["uv", "uw", "vw"].index(f"{r['node']}{r['node2']}") if r["node2"] else 0}.get(r["metric"])
        if at is not None:
            assert np.allclose(np.percentile([values[i, t][r["metric"]][at] for i in range(6)], [2.5, 97.5]), [r["lo"], r["hi"]])
    rows = bootstrap.resampled_rows(panel.pack(small), 2, 80)
    assert rows.where("t <> source").count() == 0


def test_whitening_gives_unit_covariance(spark):
    rng = np.random.default_rng(9)
    u = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    cov = (u.T @ u / 300).ravel().tolist()
    rows = spark.createDataFrame([("a", i, x.tolist(), cov) for i, x in enumerate(u)], "panel_id string, i int, u array<double>, sigma array<double>")
    w = np.array([r["w"] for r in matrices.whiten(rows, center=False).collect()])
    assert np.allclose(w.T @ w / 300, np.eye(2), atol=1e-6)
    assert np.allclose(np.array([r["w"] for r in matrices.whiten(rows).collect()]).mean(axis=0), 0, atol=1e-12)
    back = matrices.colour(matrices.whiten(rows, scaled=True, center=False)).orderBy("i").collect()
    assert np.allclose([r["v"] for r in back], u, atol=1e-6)
    with pytest.raises(Exception, match="zca"):
        matrices.whiten(rows, method="other").collect()


def test_as_of(spark):
    dates = spark.createDataFrame([(day(0),), (day(4),), (day(10),)], "ts date")
    asks = spark.createDataFrame([("early", day(-3)), ("tie", day(2)), ("late", day(8)), ("hit", day(4)), ("end", day(99))], "request string, wanted date")
    found = {how: {r["request"]: r["ts"] for r in network.as_of(asks, dates, how).collect()} for how in ("exact", "pad", "backfill", "nearest", "last")}
    assert found["exact"] == {"early": None, "tie": None, "late": None, "hit": day(4), "end": None}
    assert found["pad"] == {"early": day(0), "tie": day(0), "late": day(4), "hit": day(4), "end": day(10)}
    assert found["backfill"] == {"early": day(0), "tie": day(4), "late": day(10), "hit": day(4), "end": day(10)}
    assert found["nearest"] == {"early": day(0), "tie": day(0), "late": day(10), "hit": day(4), "end": day(10)}
    assert set(found["last"].values()) == {day(10)}
    with pytest.raises(ValueError):
        network.as_of(asks, dates, "other")


def test_panels_with_their_own_choice(spark, two):
    """Orders, kappas and sub-networks of each panel: equal to each panel alone with these values."""
    chosen = spark.createDataFrame([("a", 2, 0.97, 0.95), ("b", 1, 0.99, 0.94), ("none", 1, 0.99, 0.96)], "panel_id string, p int, kappa1 double, kappa2 double")
    got = {(r["panel_id"], r["ts"], r["node"]): r for r in model.chosen_indices(two, chosen, 6, sub_nodes=("u", "v")).collect()}
    assert {k[0] for k in got} == {"a", "b"}
    for name, p, k1, k2 in (("a", 2, 0.97, 0.95), ("b", 1, 0.99, 0.94)):
        alone = model.connectedness_indices(two.where(F.col("panel_id") == name), p, k1, k2, 6, sub_nodes=("u", "v")).collect()
        assert len(alone) == sum(k[0] == name for k in got)
        for r in alone:
            assert np.allclose([r[c] for c in ("tci", "to_idx", "from_idx", "net_idx", "net_sub", "tci_sub")], [got[name, r["ts"], r["node"]][c] for c in ("tci", "to_idx", "from_idx", "net_idx", "net_sub", "tci_sub")])
    unknown = spark.createDataFrame([("a", 9, 0.97, 0.95)], chosen.schema)
    assert model.chosen_indices(two, unknown, 6).count() == 0 and model.chosen_indices(two, chosen.limit(0), 6).count() == 0


def test_draws_resume(spark, two, tmp_path, monkeypatch):
    """A run that breaks off keeps its finished batches; the next draws the rest alone, to the same result."""
    small, made = two.where("panel_id = 'a'"), []
    whole = bootstrap.draws

    def draws(panel, replicas, first=0, **settings):
        made.append((first, replicas))
        if len(made) == 3:
            raise RuntimeError("lost")
        return whole(panel, replicas, first=first, **settings)

    monkeypatch.setattr(bootstrap, "draws", draws)
    settings = {"block": 10, "horizon": 5, "chunk": 2}
    with pytest.raises(RuntimeError, match="lost"):
        bootstrap.resumed_draws(small, str(tmp_path), 8, 3, **settings)
    told = lambda df: sorted((r["rep"], r["t"], round(r["tci"], 8)) for r in df.collect())
    got = told(bootstrap.resumed_draws(small, str(tmp_path), 8, 3, **settings))
    assert made == [(0, 3), (3, 6), (6, 8), (6, 8)]
    assert got == told(whole(small, 8, **settings)) and {r[0] for r in got} == set(range(8))
    (marker,) = tmp_path.glob("*/replicas-3-6/_SUCCESS")
    marker.unlink()  # a batch that a job left unfinished
    assert told(bootstrap.resumed_draws(small, str(tmp_path), 8, 3, **settings)) == got and made[4:] == [(3, 6)]
    bootstrap.resumed_draws(small, str(tmp_path), 3, 3, **{**settings, "horizon": 4})
    bootstrap.resumed_draws(small.withColumn("value", F.col("value") * 2), str(tmp_path), 3, 3, **settings)
    assert made[5:] == [(0, 3), (0, 3)]


def test_network_edges(spark):
    theta = spark.createDataFrame([(day(0), "a", "b", 0.5), (day(0), "b", "a", 0.2), (day(0), "a", "a", 0.5), (day(0), "b", "b", 0.8), (day(1), "a", "b", 0.3), (day(1), "b", "a", 0.3)], "ts date, to_node string, from_node string, theta double")
    edge = network.net_edges(theta).collect()
    assert [(r["ts"], r["source"], r["target"], round(r["weight"], 9)) for r in edge] == [(day(0), "b", "a", 0.3)]
    zero = spark.createDataFrame([(day(0), "a", "b", 0.0), (day(0), "b", "a", 0.0)], theta.schema)
    groups = spark.createDataFrame([("a", "one")], "node string, grp string")
    assert {(r["to_node"], r["theta"]) for r in network.group_theta(zero, groups).collect()} == {("one", 0.0), ("Otros", 0.0)}
    strength = network.out_strength(network.net_edges(theta), theta.select("ts", F.col("to_node").alias("node")).distinct())
    assert {(r["ts"], r["node"]): r["share"] for r in strength.collect()}[day(1), "a"] == 0.0
    assert network.edge_significance(network.net_edges(theta), spark.createDataFrame([], "ts date, node string, node2 string, lo double, hi double")).first()["significant"]


def test_episodes(spark):
    rows = [("s", day(3 * i), i + 1, v) for i, v in enumerate([9.0, 9.0, 1.0, 2.0, 9.0, 1.0, 9.0])]
    index = spark.createDataFrame(rows, "series string, ts date, t long, value double")
    found = sorted((r["start_date"], r["end_date"], r["duration_days"]) for r in events.episodes(index, 50).collect())
    assert found == [(day(0), day(3), 4), (day(12), day(12), 1), (day(18), day(18), 1)]
    periods = spark.createDataFrame([(2, day(2), day(5), "second"), (1, day(3), day(3), "first"), (3, day(90), day(91), "never")], "ord int, start date, end date, name string")
    named = {r["start_date"]: r["events"] for r in events.episode_events(events.episodes(index, 50), periods).collect()}
    assert named == {day(0): "first | second", day(12): "-", day(18): "-"}
    upper = index.withColumn("hi", F.when(F.col("t") == 3, 99.0).otherwise(F.col("value")))
    assert sorted(r["duration_days"] for r in events.episodes(upper, 50).collect())[-1] == 7
    assert events.episodes(index.limit(0)).count() == 0


def test_entry_without_the_training_data_operators(tmp_path):
    """In a copy of the tree without the subpackage and the pipeline, everything else imports and is registered."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "netdrift", tmp_path / "netdrift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    say = "import sys, __spark_entry__ as e; print(len(e.queries()), any(n.startswith('netdrift.llm') for n in sys.modules), set(e.oracle_sql()) <= set(e.queries()), e.__file__)"
    out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), "False", "True", str(tmp_path / "__spark_entry__.py")]


def test_fixtures(spark):
    flows = panels.nation_flows(spark, SF)
    sums = flows.groupBy("ts", "to_node").agg(F.sum("theta").alias("s"), F.count("*").alias("n"))
    assert sums.where((F.abs(F.col("s") - 1) > 1e-9) & (F.col("s") != 0)).count() == 0 and sums.where("n <> 25").count() == 0
    ships = panels.shipping_panel(spark, SF)
    assert ships.groupBy("ts").count().select("count").distinct().collect() == [(6,)]


def test_bootstrap_and_search_queries_take_the_operators_defaults(spark, monkeypatch):
    from netdrift.operators import bootstrap, model
    from netdrift.plans import queries

    class Called(Exception):
        pass

    def seen(*args, **options):
        raise Called(options)

    monkeypatch.setattr(model, "grid_search", lambda *a, **k: spark.range(1))
    monkeypatch.setattr(model, "all_designs", lambda *a, **k: spark.range(1))
    names = {"b02_paths": (bootstrap, "paths"), "b03_draws": (bootstrap, "draws"), "b05_bands": (bootstrap, "draws"), "k06_continuous_search": (model, "continuous_search"), "k07_diagnose": (model, "diagnose"), "k08_choose": (model, "diagnose")}
    for name, (module, function) in names.items():
        monkeypatch.setattr(module, function, seen)
        with pytest.raises(Called) as found:
            queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert not {"replicas", "horizon", "n_starts", "tol", "top"} & set(found.value.args[0])
    assert queries.QUERIES["b01_resample"](spark, "/root/testdata/sf0.001").agg({"rep": "max"}).first()[0] == 999
