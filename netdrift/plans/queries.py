"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame, doubles rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netdrift.operators import bootstrap, connect, describe, diagnostics, events, matrices, model, network, panel, stationarity
from netdrift.session import remove_at_end, shared_folder, stored, table
from netdrift.sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(x: Column | str) -> Column:
    return F.round(x, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six places, and without a negative zero."""
    return df.select(*[r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def on_panels(name: str, job: Callable[[DataFrame], DataFrame]) -> None:
    """A query that runs ``job`` over the nations' panels."""
    QUERIES[name] = lambda spark, sf_dir: rounded(job(panels.nation_panels(spark, sf_dir)))


def on_theta(name: str, job: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(job(panels.region_flows(spark, sf_dir)))


def net_index(theta: DataFrame) -> DataFrame:
    """The regions' net values as index series, with bands of 1.96 deviations over 12 rows."""
    by = Window.partitionBy("series").orderBy("ts")
    rows = connect.net(theta).select(F.col("node").alias("series"), "ts", F.row_number().over(Window.partitionBy("node").orderBy("ts")).cast("long").alias("t"), (F.round("net_idx", 9) + F.lit(0.0)).alias("value"))
    sd = F.coalesce(F.stddev_samp("value").over(by.rowsBetween(-11, 0)), F.lit(0.0))
    return rows.withColumns({"lo": F.col("value") - 1.96 * sd, "hi": F.col("value") + 1.96 * sd})


def tci_index(theta: DataFrame) -> DataFrame:
    """The total index as a series, to nine places, so that ties with its percentiles are ties."""
    return connect.tci(theta).select(F.lit("tci").alias("series"), "ts", F.row_number().over(Window.partitionBy(F.lit("tci")).orderBy("ts")).cast("long").alias("t"), (F.round("tci", 9) + F.lit(0.0)).alias("value"))


# panel preparation
on_panels("p01_choose_series", lambda p: panel.choose_series(p, ["1-URGENT", "5-LOW"]).select("panel_id", "ts", "series", "value"))
on_panels("p02_reshape", lambda p: panel.to_long(panel.to_wide(p, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])))
on_panels("p03_ordinal", lambda p: panel.with_ordinal(p.select("panel_id", "series", F.col("ts").cast("string").alias("ts"))).withColumn("ts", F.to_date("ts")))


@query
def p04_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("bad"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string")).alias("value"))
    return panel.coerce_numeric(rows)


@query
def p05_long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit("all").alias("panel_id"), F.col("user_id").alias("series"))
    return panel.long_enough(rows).groupBy(F.col("series").alias("user_id")).agg(F.count("*").alias("n"))


@query
def p06_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.numeric_columns(table(spark, sf_dir, "lineitem"))


def _design_digest(p: DataFrame) -> DataFrame:
    rows = panel.lagged_design(panel.pack(p), 2)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    late = F.aggregate(F.slice("x", 6, 5), F.lit(0.0), lambda a, v: a + v)
    return rows.select("panel_id", "ts", "t", F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("sum_y"), (total + late).alias("sum_x"), F.col("x")[9].alias("last_x"), F.size("x").alias("k"))


on_panels("p07_lagged_design", _design_digest)


@query
def p08_common_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = panel.pack(panels.nation_panels(spark, sf_dir))
    parts = [panel.common_sample(panel.lagged_design(packed, p), 4).groupBy("panel_id").agg(F.count("*").alias("t_eff")).withColumn("p", F.lit(p)) for p in (1, 2, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("panel_id", "p", "t_eff")


@query
def p09_store_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panels written by panel_id to the shared folder, read back and summed."""
    kept = panels.write_partitioned(panels.nation_panels(spark, sf_dir), shared_folder(spark, "draws"))
    return rounded(kept.groupBy("panel_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query
def p10_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("value") == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return panel.nonfinite(rows)


@query
def p11_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = panels.nation_groups(spark, sf_dir).where("grp <> 'ASIA'").select(F.col("node").alias("key"), F.col("grp").alias("label"))
    return panel.relabel(table(spark, sf_dir, "nation").select(F.col("n_name").alias("node")), names, "node").groupBy("node").agg(F.count("*").alias("n"))


# description
on_panels("d01_summary", describe.summary)
on_panels("d02_pearson", describe.correlation)
on_panels("d03_spearman", describe.rank_correlation)
on_panels("d04_kendall", describe.kendall_tau)
on_panels("d05_rolling_volatility", describe.rolling_volatility)
on_panels("d06_rolling_correlation", lambda p: describe.rolling_correlation(p).drop("above"))
on_panels("d07_above_static", lambda p: describe.rolling_correlation(p).groupBy("panel_id", "a", "b").agg(F.count("*").alias("windows"), F.count(F.when(F.col("above"), 1)).alias("above")))
on_panels("d08_histogram", describe.histogram)
on_panels("d08_histogram_standardized", lambda p: describe.histogram(p, 30, True))
on_panels("d09_box", describe.box)
on_panels("d10_qq_fit", describe.qq_fit)
on_panels("d11_qq_points", describe.qq_points)
on_panels("d12_pp_points", describe.pp_points)
on_panels("d13_acf_bound", describe.acf_bound)
on_panels("d14_acf", describe.autocorrelation)
on_panels("d15_ccf", describe.cross_correlation)
on_panels("d16_skewness", lambda p: describe.moments(p).drop("excess_kurtosis"))
on_panels("d17_excess_kurtosis", lambda p: describe.moments(p).drop("skewness"))

# connectedness of observed flows
on_theta("flow_theta", lambda theta: theta)
on_theta("c03_to", connect.to_others)
on_theta("c04_from", connect.from_others)
on_theta("c05_net", connect.net)
on_theta("c06_tci", connect.tci)
on_theta("c07_pairwise", connect.pairwise)
on_theta("c10_trace_tci", connect.tci_from_trace)


@query
def c08_sub_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = connect.sub_network(panels.region_flows(spark, sf_dir), ["ASIA", "EUROPE", "AMERICA"])
    nodes = connect.net(sub).select("ts", "node", F.col("net_idx").alias("net_sub"))
    return rounded(nodes.join(connect.tci(sub).withColumnRenamed("tci", "tci_sub"), "ts"))


# networks
REQUESTS = [("before", "1990-01-01"), ("inside", "1996-07-05"), ("sunday", "1997-02-09"), ("monday", "1998-03-02"), ("tie", "1997-05-08"), ("after", "2030-01-01")]


def _as_of(how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = spark.createDataFrame(REQUESTS, "request string, wanted string").withColumn("wanted", F.to_date("wanted"))
        return network.as_of(asked, panels.region_flows(spark, sf_dir).select("ts"), how)

    return run


@query
def n01_theta_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """theta itself at the dates that stand for the requests."""
    asked = spark.createDataFrame(REQUESTS, "request string, wanted string").withColumn("wanted", F.to_date("wanted"))
    return rounded(network.theta_as_of(panels.region_flows(spark, sf_dir), asked, "nearest"))


QUERIES |= {f"n01_as_of_{how}": _as_of(how) for how in ("last", "exact", "pad", "backfill")} | {"n02_as_of_nearest": _as_of("nearest")}


@query
def n03_group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.group_of(table(spark, sf_dir, "nation").select(F.col("n_name").alias("node")), panels.nation_groups(spark, sf_dir).where("grp <> 'AFRICA'"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.group_theta(panels.nation_flows(spark, sf_dir), panels.nation_groups(spark, sf_dir))


@query
def n04_group_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_grouped(spark, sf_dir))


on_theta("n05_node_net", lambda theta: connect.net(theta, scaled=False).select("ts", "node", "net_idx"))
on_theta("n06_roles", lambda theta: connect.net(theta, scaled=False).withColumn("role", network.role(F.col("net_idx"))).groupBy("node").agg(
    F.count(F.when(F.col("role") == "emitter", 1)).alias("emitter"), F.count(F.when(F.col("role") == "receiver", 1)).alias("receiver")))
on_theta("n07_net_edges", lambda theta: network.net_edges(theta, 0.01))


@query
def n08_node_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = net_index(panels.region_flows(spark, sf_dir))
    nodes = index.select("ts", F.col("series").alias("node"), F.col("value").alias("net_idx"))
    return rounded(network.node_significance(nodes, index.select("ts", F.col("series").alias("node"), "lo", "hi")))


def _pair_bands(theta: DataFrame) -> DataFrame:
    pdc = connect.pairwise(theta).where("to_node < from_node")
    return pdc.select(*connect.keys(theta), F.col("to_node").alias("node"), F.col("from_node").alias("node2"), (F.col("pdc") - 0.1).alias("lo"), (F.col("pdc") + 0.1).alias("hi"))


@query
def n09_edge_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = panels.region_flows(spark, sf_dir)
    return rounded(network.edge_significance(network.net_edges(theta), _pair_bands(theta).where("node <> 'AFRICA'")))


@query
def n10_out_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = panels.region_flows(spark, sf_dir)
    return rounded(network.out_strength(network.net_edges(theta), theta.select("ts", F.col("to_node").alias("node")).distinct()))


on_theta("n11_relative_weight", lambda theta: network.relative_weight(network.net_edges(theta)).drop("weight"))
on_theta("n12_relative_over_dates", lambda theta: network.relative_weight(network.net_edges(theta), over_dates=True).drop("weight"))
on_theta("n13_every_date", lambda theta: network.every(theta, 4))


@query
def n14_dated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = panels.region_flows(spark, sf_dir)
    kept = network.net_edges(theta.join(network.every(theta, 4), "ts", "left_semi"), 0.01)
    return rounded(network.edge_significance(network.relative_weight(kept, over_dates=True), _pair_bands(theta)))


@query
def n15_group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.net_edges(_grouped(spark, sf_dir), 1e-9))


on_theta("n16_contributions", lambda theta: network.contributions(theta, "ASIA", include_self=False).drop("place"))
on_theta("n16_ordered_contributions", lambda theta: network.contributions(theta, "ASIA", order=["EUROPE", "AFRICA"]))
on_theta("n17_all_contributions", network.contributions)


# the same tables of several panels at once
def on_panel_theta(name: str, job: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(job(panels.priority_flows(spark, sf_dir)))


def _asked_panels(theta: DataFrame) -> DataFrame:
    asked = theta.sparkSession.createDataFrame([(p, r, d) for p in ("1-URGENT", "5-LOW") for r, d in REQUESTS], "panel_id string, request string, wanted string")
    return network.theta_as_of(theta, asked.withColumn("wanted", F.to_date("wanted")), "nearest")


on_panel_theta("n01_theta_as_of_panels", _asked_panels)
on_panel_theta("n08_node_significance_panels", lambda theta: network.node_significance(connect.net(theta).drop("to_idx", "from_idx"), connect.net(theta).select("panel_id", "ts", "node", (F.col("net_idx") - 2).alias("lo"), (F.col("net_idx") + 2).alias("hi"))))
on_panel_theta("n09_edge_significance_panels", lambda theta: network.edge_significance(network.net_edges(theta), _pair_bands(theta).where("node <> 'AFRICA'")))
on_panel_theta("n10_out_strength_panels", lambda theta: network.out_strength(network.net_edges(theta), theta.select("panel_id", "ts", F.col("to_node").alias("node")).distinct()))
on_panel_theta("n11_relative_weight_panels", lambda theta: network.relative_weight(network.net_edges(theta)).drop("weight"))
on_panel_theta("n12_relative_over_dates_panels", lambda theta: network.relative_weight(network.net_edges(theta), over_dates=True).drop("weight"))
on_panel_theta("n13_every_date_panels", lambda theta: network.every(theta, 4))
on_panel_theta("n17_all_contributions_panels", network.contributions)


@query
def n18_pair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), nation.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("a", "b", network.pair_name(F.col("a"), F.col("b")).alias("pair"))


# events
on_theta("e01_zones", lambda theta: events.zones(tci_index(theta)).drop("t"))
on_theta("e02_stable_range", lambda theta: events.stable_range(net_index(theta)))
on_theta("e03_sign_class", lambda theta: events.sign_class(net_index(theta)).drop("t", "lo", "hi"))


@query
def e04_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.periods_in_sample(tci_index(panels.region_flows(spark, sf_dir)), panels.stress_periods(spark))


@query
def e04_periods_start_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods that begin inside the sample: the index is cut to dates from 1996 on, so that some began before."""
    index = tci_index(panels.region_flows(spark, sf_dir)).where("ts >= '1996-06-01'")
    return events.periods_in_sample(index, panels.stress_periods(spark), start_inside=True)


on_theta("e05_episodes", lambda theta: events.episodes(tci_index(theta)))


def _named_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.episode_events(events.episodes(tci_index(panels.region_flows(spark, sf_dir))), panels.stress_periods(spark))


@query
def e06_episode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_named_episodes(spark, sf_dir))


@query
def e07_episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.episode_summary(_named_episodes(spark, sf_dir)))


# stationarity
on_panels("t01_adf", stationarity.adf)
on_panels("t02_kpss", stationarity.kpss)
on_panels("t03_phillips_perron", stationarity.phillips_perron)
on_panels("t04_battery", stationarity.battery)

# diagnostics
on_panels("g01_jarque_bera", lambda p: diagnostics.jarque_bera(p).select("panel_id", "series", "jb", "p"))
on_panels("g01_jarque_bera_stat", lambda p: diagnostics.jarque_bera(p).select("panel_id", "series", "jb"))
on_panels("g02_anderson_darling", diagnostics.anderson_darling)
on_panels("g03_kolmogorov_smirnov", diagnostics.kolmogorov_smirnov)
on_panels("g04_cramer_von_mises", diagnostics.cramer_von_mises)
on_panels("g04_cramer_von_mises_stat", lambda p: diagnostics.cramer_von_mises(p).select("panel_id", "series", "w2"))
on_panels("g05_normality_report", diagnostics.normality_report)
on_panels("g06_ljung_box", diagnostics.ljung_box)
on_panels("g06_ljung_box_stat", lambda p: diagnostics.ljung_box(p).select("panel_id", "series", "q"))
on_panels("g07_arch_lm", diagnostics.arch_lm)
on_panels("g08_multivariate_arch_lm", lambda p: diagnostics.multivariate_arch_lm(panel.pack(p)))
on_panels("g08_multivariate_arch_lm_vec", lambda p: diagnostics.multivariate_arch_lm(panel.pack(p), vech=False))
on_panels("g09_portmanteau", lambda p: diagnostics.portmanteau(panel.pack(p)))
on_panels("g10_hosking", lambda p: diagnostics.hosking(panel.pack(p)))
on_panels("g11_hosking_squares", lambda p: diagnostics.hosking(panel.pack(p), square=True))
on_panels("g12_joint_jarque_bera", diagnostics.joint_jarque_bera)
on_panels("g13_mardia", lambda p: diagnostics.mardia(panel.pack(p)))
on_panels("g14_mardia_robust", lambda p: diagnostics.mardia(panel.pack(p), robust=True))
on_panels("g15_autocorrelation_lr", lambda p: diagnostics.autocorrelation_lr(panel.pack(p)))
on_panels("g16_block_lengths", diagnostics.suggest_block_lengths)


def _white(p: DataFrame, residual: bool) -> DataFrame:
    """Whitened residuals (filtered coefficients) or one-step innovations of the fitted panels, as a panel."""
    fitted = model.fit(model.packed_design(p))
    rows = model.predictions(fitted, panel.lagged_design(panel.pack(p)))
    white = matrices.whiten(rows.select("panel_id", "ts", "t", F.col("residual" if residual else "innovation").alias("u"), F.col("s").alias("sigma")))
    long = white.select("panel_id", "ts", "t", F.posexplode("w").alias("_i", "value")).join(model.nodes(p), "panel_id")
    return long.select("panel_id", "ts", "t", F.col("names")[F.col("_i")].alias("series"), (F.col("_i") + 1).alias("pos"), "value")


def _validated(p: DataFrame) -> DataFrame:
    white = _white(p, True)
    joint = diagnostics.mardia(panel.pack(white), robust=True)
    return diagnostics.normality_report(white, 1000).join(joint, "panel_id")


on_panels("g17_validate_normality", _validated)
on_panels("g18_validate_blocks", lambda p: diagnostics.suggest_block_lengths(_white(p, False)))


# matrices
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_id (the label), vec_id, u: all components of every vector."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    return rows.select(F.col("label").cast("string").alias("panel_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("u"))


@query
def m01_positive_definite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second moments of each label's vectors."""
    return rounded(matrices.positive_definite(matrices.second_moments(_vectors(spark, sf_dir), "panel_id")).drop("m"))


def _whole_sigma(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the key that all of them share, and the second moments of all of them under that key."""
    keyed = rows.withColumn("whole", F.lit("all"))
    return keyed, matrices.second_moments(keyed, "whole").withColumnRenamed("m", "sigma")


def _spread(rows: DataFrame, column: str) -> DataFrame:
    """panel_id, vec_id, i and the component."""
    return rounded(rows.select("panel_id", "vec_id", F.posexplode(column).alias("i", column)))


def _whitened(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    rows, sigma = _whole_sigma(_vectors(spark, sf_dir))
    return matrices.whiten(rows, sigmas=sigma, on="whole", **options).drop("whole")


def _label_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two components of every vector, and the second moments of each label: 2 x 2, whose roots have a closed form."""
    rows = _vectors(spark, sf_dir).withColumn("u", F.slice("u", 1, 2))
    return rows, matrices.second_moments(rows, "panel_id").withColumnRenamed("m", "sigma")


@query
def m01_least_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrices.positive_definite(_label_pairs(spark, sf_dir)[1], "sigma").drop("sigma"))


@query
def m02_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_whitened(spark, sf_dir), "w")


@query
def m02_whiten_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of the components: an eigenvector's sign is arbitrary."""
    white = _whitened(spark, sf_dir, method="pca", center=False)
    return _spread(white.withColumn("w", F.transform("w", lambda x: x * x)), "w")


@query
def m02_whiten_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors by the label's own matrix, centred."""
    rows, sigma = _label_pairs(spark, sf_dir)
    return _spread(matrices.whiten(rows, sigmas=sigma), "w")


@query
def m03_whiten_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_whitened(spark, sf_dir, scaled=True), "w")


@query
def m03_whiten_scaled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sigma = _label_pairs(spark, sf_dir)
    return _spread(matrices.whiten(rows, sigmas=sigma, scaled=True, jitter=1e-3, center=False), "w")


@query
def m04_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as they are, coloured by the second moments of all."""
    rows, sigma = _whole_sigma(_vectors(spark, sf_dir))
    return _spread(matrices.colour(rows, "u", sigmas=sigma, on="whole"), "v")


@query
def m04_colour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as they are, coloured by their label's second moments."""
    rows, sigma = _label_pairs(spark, sf_dir)
    return _spread(matrices.colour(rows, "u", sigmas=sigma), "v")


# models
ORDERS = (1, 2)
KAPPAS = (0.94, 0.96, 0.98, 0.99)


def _design(p: DataFrame, lags: int = 1) -> DataFrame:
    return model.packed_design(p, lags)


on_panels("k01_ols_prior", lambda p: model.ols_prior(_design(p)).select("panel_id", F.posexplode("b").alias("i", "b")))
on_panels("k02_filter", lambda p: model.fit(_design(p)).select("panel_id", "ts", "t", "loglik", *[F.aggregate(c, F.lit(0.0), lambda a, v: a + v).alias(c) for c in ("beta", "sigma", "s", "innovation")]))
def _designs(p: DataFrame, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """Packed designs that a search and its diagnosis both read."""
    return stored(model.all_designs(p, orders), "designs")


def _diagnosed(p: DataFrame, continuous: bool = False) -> DataFrame:
    designs = _designs(p)
    grid = stored(model.continuous_search(designs) if continuous else model.grid_search(designs, ORDERS, KAPPAS, KAPPAS), "grid")
    return model.diagnose(grid, designs)


on_panels("k03_loglik", lambda p: model.grid_search(model.all_designs(p, (1,)), (1,), KAPPAS, KAPPAS).select("panel_id", "kappa1", "kappa2", "loglik"))
on_panels("k04_aic", lambda p: model.grid_search(model.all_designs(p, (1,)), (1,), (0.99,), (0.96,)).select("panel_id", "aic", "t_eff"))
on_panels("k05_grid_search", lambda p: model.grid_search(model.all_designs(p, ORDERS), ORDERS, KAPPAS, KAPPAS))
on_panels("k06_continuous_search", lambda p: model.continuous_search(model.all_designs(p, ORDERS)))
on_panels("k07_diagnose", _diagnosed)
on_panels("k08_choose", lambda p: model.choose(_diagnosed(p)))
on_panels("k08_choose_continuous", lambda p: model.choose(_diagnosed(p, continuous=True)))
on_panels("k09_predictions", lambda p: model.predictions(model.fit(_design(p)), panel.lagged_design(panel.pack(p))).select("panel_id", "t", F.posexplode(F.arrays_zip("innovation", "residual")).alias("i", "e")).select("panel_id", "t", "i", "e.innovation", "e.residual"))

# connectedness of fitted panels
on_panels("c01_moving_average", lambda p: model.phi(model.fit(_design(p)), 5).select("panel_id", "ts", "h", F.aggregate("phi", F.lit(0.0), lambda a, v: a + v).alias("total"), F.aggregate("phi", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("size")))
on_panels("c02_gfevd", lambda p: model.connectedness(p))
on_panels("c09_gfevd_same_date", lambda p: model.theta_long(model.theta(model.fit(_design(p)), sigma="sigma"), model.nodes(p)).drop("theta_g"))
on_panels("c12_sigma_before", lambda p: model.fit(_design(p)).select("panel_id", "t", *[F.col(c)[0].alias(c) for c in ("sigma", "sigma_before")]))


on_panels("c08_fitted_sub_network", lambda p: model.connectedness_indices(p, sub_nodes=["1-URGENT", "3-MEDIUM", "5-LOW"]).select("panel_id", "ts", "node", "net_sub", "tci_sub"))
on_panels("c11_connectedness", lambda p: model.connectedness_indices(p).drop("net_sub", "tci_sub"))


@query
def c11_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, diagnosis and choice for each panel, then its connectedness with the p, kappa1 and kappa2 that were chosen."""
    p = stored(panels.nation_panels(spark, sf_dir), "panel")
    chosen = stored(model.choose(_diagnosed(p)).select("panel_id", "p", "kappa1", "kappa2"), "chosen")
    return rounded(model.chosen_indices(p, chosen, orders=ORDERS).drop("net_sub", "tci_sub"))


# bootstrap
def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.draws(panels.shipping_panel(spark, sf_dir), sub_nodes=("AF", "NO", "RF"))


@query
def b01_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.resampled_rows(panel.pack(panels.nation_panels(spark, sf_dir)), 1000, 20)


@query
def b02_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = bootstrap.paths(panels.shipping_panel(spark, sf_dir))
    return rounded(drawn.select("panel_id", "rep", "t", F.posexplode("y").alias("i", "y")))


@query
def b03_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_draws(spark, sf_dir).select("panel_id", "rep", "t", "tci", "tci_sub"))


@query
def b03_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws by batches of replicas that a broken run would find again; here the folder goes with the session."""
    folder = shared_folder(spark, "draws")
    try:
        drawn = bootstrap.resumed_draws(stored(panels.shipping_panel(spark, sf_dir), "panel"), folder, sub_nodes=("AF", "NO", "RF"))
    finally:
        remove_at_end(spark, folder)
    return rounded(drawn.select("panel_id", "rep", "t", "tci", "tci_sub"))


@query
def b05_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.bands(_draws(spark, sf_dir)))


@query
def b05_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the fitted network with their bootstrap bands, named and dated, and whether they are significant."""
    ships = panels.shipping_panel(spark, sf_dir)
    found = stored(bootstrap.named_bands(bootstrap.bands(_draws(spark, sf_dir)), ships), "bands")
    measured = stored(model.measures(model.fit(model.packed_design(ships)), model.nodes(ships)), "measures")
    nodes = network.node_significance(model.node_indices(measured).select("ts", "node", "net_idx"), found.where("metric = 'net'").select("ts", "node", "lo", "hi"))
    theta = model.theta_long(measured.select("panel_id", "ts", "theta", F.col("theta").alias("theta_g")), model.nodes(ships)).select("ts", "to_node", "from_node", "theta")
    edges = network.edge_significance(network.net_edges(theta), found.where("metric = 'pdc'").select("ts", "node", "node2", "lo", "hi"))
    told = nodes.select("ts", F.col("node").alias("source"), F.lit(None).cast("string").alias("target"), F.col("net_idx").alias("value"), "significant")
    return rounded(told.unionByName(edges.select("ts", "source", "target", F.col("weight").alias("value"), "significant")))


@query
def b04_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bands of order prices by week, as bands of draws."""
    rows = table(spark, sf_dir, "orders").select(panels.week("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return rounded(bootstrap.percentile_bands(rows, ["ts"]))
