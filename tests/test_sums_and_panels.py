"""Sums by key over many batches and tasks, vectors by shared matrices, and network tables of several panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netdrift.functions import kernels
from netdrift.operators import connect, diagnostics, matrices, network
from netdrift.operators.sums import array_sums, blocks_of


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_tells_a_key_once(spark, small_batches):
    """Hundreds of batches: what leaves a task is one array a key, and with no room for sums one a batch; totals agree."""
    rows = spark.range(4000, numPartitions=3).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("key"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"))
    sums = lambda own: np.stack(list(own["v"])).sum(axis=0)
    found = {r["key"]: r["s"] for r in array_sums(rows, "key", sums).collect()}
    want = {}
    for r in rows.collect():
        want.setdefault(r["key"], np.zeros(2))
        want[r["key"]] += r["v"]
    assert found.keys() == want.keys() and all(np.array_equal(found[k], want[k]) for k in want)
    assert found == {r["key"]: r["s"] for r in array_sums(rows, "key", sums, held=0).collect()}
    exact = {r["key"]: r["s"] for r in array_sums(rows, "key", lambda own: np.array([len(own)]), "bigint").collect()}
    assert exact == {k: [int(v[1])] for k, v in want.items()}
    assert array_sums(rows.where("false"), "key", sums).count() == 0


def test_blocks_hold_all_rows_and_one_key(spark, small_batches):
    rows = spark.createDataFrame([(None if i % 4 == 0 else f"k{i % 3}", i, [float(i)] if i % 5 else None) for i in range(100)], "key string, i int, v array<double>")
    blocks = blocks_of(rows, "key", 2).collect()
    assert sorted(r["i"] for b in blocks for r in b["rows"]) == list(range(100))
    assert all(len(b["rows"]) <= 2 and {r["key"] for r in b["rows"]} == {b["key"]} for b in blocks)


def test_vectors_by_shared_matrices(spark, monkeypatch):
    """Equal to a matrix on every row, with as many decompositions as matrices; a null vector stays null, a key without a matrix goes."""
    rng = np.random.default_rng(4)
    u = rng.normal(size=(60, 3))
    sigma = {p: (lambda a: a @ a.T + np.eye(3))(rng.normal(size=(3, 3))) for p in ("a", "b")}
    rows = spark.createDataFrame([("ab"[i % 2], i, x.tolist()) for i, x in enumerate(u)] + [("a", 60, None), ("c", 61, [1.0] * 3)], "panel_id string, i int, u array<double>")
    table = spark.createDataFrame([(p, s.ravel().tolist()) for p, s in sigma.items()], "panel_id string, sigma array<double>")
    for made in (matrices.whiten(rows, sigmas=table, center=False), matrices.whiten(rows, sigmas=table, method="pca", center=False), matrices.colour(rows, "u", sigmas=table)):
        name = made.columns[-1]
        found = {r["i"]: r[name] for r in made.collect()}
        assert found.pop(60) is None and set(found) == set(range(60))
        for i, x in enumerate(u):
            w, q = np.linalg.eigh(sigma["ab"[i % 2]])
            turned = q.T @ x / np.sqrt(w) if name == "w" else None
            near = q @ turned if name == "w" else q @ (np.sqrt(w) * (q.T @ x))
            assert np.allclose(found[i], near, atol=1e-6) or np.allclose(np.abs(found[i]), np.abs(turned), atol=1e-6)
    assert matrices.powers(table, "panel_id", "sigma", -0.5, 1e-10, False, "zca").count() == 2
    same = rows.where("i < 60").join(table, "panel_id")
    wide = {r["i"]: r["w"] for r in matrices.whiten(same, scaled=True).collect()}
    assert all(np.allclose(r["w"], wide[r["i"]]) for r in matrices.whiten(rows.where("i < 60"), sigmas=table, scaled=True).collect())
    assert kernels.power(sigma["a"][None], 0.5).shape == (1, 3, 3)


def test_multivariate_sums_over_many_batches(spark, small_batches):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(900, 2))
    packed = spark.createDataFrame([("a", t + 1, x.tolist()) for t, x in enumerate(y)], "panel_id string, t long, y array<double>")
    found = diagnostics.mardia(packed.repartition(5)).first()
    d = y - y.mean(axis=0)
    g = d @ np.linalg.inv(d.T @ d / len(d)) @ d.T
    assert np.isclose(found["skew_stat"], (g**3).sum() / len(d) / 6)
    assert np.allclose(matrices.second_moments(packed.withColumnRenamed("y", "u"), "panel_id").first()["m"], (y.T @ y / len(y)).ravel())


@pytest.fixture(scope="module")
def theta(spark):
    """Two panels of three nodes with dates of their own, over several months."""
    rng = np.random.default_rng(6)
    rows = []
    for p, first in (("a", 1), ("b", 40)):
        for t in range(30):
            m = rng.dirichlet(np.ones(3), 3)
            rows += [(p, f"{1999 + (first + 9 * t) // 365}-{(first + 9 * t) % 365 // 31 + 1:02d}-{(first + 9 * t) % 365 % 31 % 28 + 1:02d}", "xyz"[i], "xyz"[j], float(m[i, j])) for i in range(3) for j in range(3)]
    found = spark.createDataFrame(rows, "panel_id string, ts string, to_node string, from_node string, theta double").withColumn("ts", F.to_date("ts"))
    return found.dropDuplicates(["panel_id", "ts", "to_node", "from_node"]).cache()


def bands_of(theta):
    return connect.pairwise(theta).where("to_node < from_node").select(*connect.keys(theta), F.col("to_node").alias("node"), F.col("from_node").alias("node2"), (F.col("pdc") - 0.2).alias("lo"), (F.col("pdc") + 0.2).alias("hi"))


def asked_of(theta):
    asks = [(p, f"r{i}", d) for p in "ab" for i, d in enumerate(("1998-01-01", "1999-03-09", "1999-04-30", "1999-12-31", "2003-01-01"))]
    found = theta.sparkSession.createDataFrame(asks, "panel_id string, request string, wanted string").withColumn("wanted", F.to_date("wanted"))
    return found if "panel_id" in theta.columns else found.where("panel_id = 'a'").drop("panel_id")


JOBS = {
    "nodes": lambda t: network.node_significance(connect.net(t), connect.net(t).select(*connect.keys(t), "node", (F.col("net_idx") - 5).alias("lo"), (F.col("net_idx") + 5).alias("hi"))),
    "edges": lambda t: network.edge_significance(network.net_edges(t), bands_of(t)),
    "strength": lambda t: network.out_strength(network.net_edges(t), t.select(*connect.keys(t), F.col("to_node").alias("node")).distinct()),
    "relative": lambda t: network.relative_weight(network.net_edges(t)),
    "over dates": lambda t: network.relative_weight(network.net_edges(t), over_dates=True),
    "every": lambda t: network.every(t, 4),
    "contributions": network.contributions,
    "one target": lambda t: network.contributions(t, "x", include_self=False, order=["z"]),
    "pad": lambda t: network.theta_as_of(t, asked_of(t), "pad"),
    "nearest": lambda t: network.theta_as_of(t, asked_of(t), "nearest"),
    "last": lambda t: network.as_of(asked_of(t), t.select(*connect.keys(t)).distinct(), "last"),
    "listed": lambda t: network.every(t, wanted=["1999-01-02", "1999-03-01"]),
}


@pytest.mark.parametrize("name", JOBS)
def test_panels_do_not_mix(theta, name):
    """A job over two panels gives for each what it gives for that one alone."""
    whole = JOBS[name](theta)
    assert "panel_id" in whole.columns
    for p in "ab":
        alone = JOBS[name](theta.where(F.col("panel_id") == p).drop("panel_id"))
        order = sorted(alone.columns)
        shown = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*order).collect()), key=repr)
        assert shown(whole.where(F.col("panel_id") == p)) == shown(alone)
