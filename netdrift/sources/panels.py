"""Panels of series and network tables that Spark derives from the given tables.

A panel is long: panel_id, ts (date), t (ordinal from 1), series, pos (order of the series), value. A theta table
is long too: ts, to_node, from_node, theta, with the rows of a (ts, to_node) summing to 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netdrift.session import table


def week(column: str):
    return F.to_date(F.date_trunc("week", F.col(column)))


def month(column: str):
    return F.to_date(F.date_trunc("month", F.col(column)))


def nation_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One panel per nation: weekly log returns of the order value of each order priority, weeks without orders as 0."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("panel_id"))
    sold = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderpriority").alias("series"), week("o_orderdate").alias("ts"))
        .agg(F.sum("o_totalprice").alias("v"))
    )
    weeks = orders.select(week("o_orderdate").alias("ts")).distinct()  # calendar, priorities, nations: dimensions of fixed size
    series = orders.select(F.col("o_orderpriority").alias("series")).distinct()
    pos = series.withColumn("pos", F.row_number().over(Window.orderBy("series")))
    grid = nation.crossJoin(F.broadcast(pos)).crossJoin(F.broadcast(weeks))
    filled = grid.join(sold, ["n_nationkey", "series", "ts"], "left").withColumn("level", F.log(1 + F.coalesce("v", F.lit(0.0))))
    return returns(filled.select("panel_id", "series", "pos", "ts", "level"))


def returns(levels: DataFrame) -> DataFrame:
    """Differences of ``level`` along each series; the first row of a series goes."""
    along = Window.partitionBy("panel_id", "series").orderBy("ts")
    steps = levels.withColumn("value", F.col("level") - F.lag("level").over(along)).where(F.col("value").isNotNull())
    return steps.select("panel_id", "ts", F.row_number().over(along).cast("long").alias("t"), "series", F.col("pos").cast("int").alias("pos"), "value")


def shipping_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One panel of six series: weekly log returns of the shipped value by return flag and line status."""
    lines = table(spark, sf_dir, "lineitem")
    sold = lines.groupBy(week("l_shipdate").alias("ts"), F.concat("l_returnflag", "l_linestatus").alias("series")).agg(F.sum("l_extendedprice").alias("v"))
    series = sold.select("series").distinct().withColumn("pos", F.row_number().over(Window.orderBy("series")))
    grid = sold.select("ts").distinct().crossJoin(F.broadcast(series))
    filled = grid.join(sold, ["ts", "series"], "left").withColumn("level", F.log(1 + F.coalesce("v", F.lit(0.0))))
    return returns(filled.select(F.lit("all").alias("panel_id"), "series", "pos", "ts", "level"))


def region_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly theta: the share of each customer region in what each supplier region shipped; 0 where nothing was."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return _flows(lines, orders, customer, supplier, places, "r_name", week)


def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly theta between nations, as region_flows."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return _flows(lines, orders, customer, supplier, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", month)


def priority_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly theta between regions as region_flows, one panel for each order priority."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "panel_id")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return _flows(lines, orders, customer, supplier, places, "r_name", month, ["panel_id"])


def _flows(lines, orders, customer, supplier, places: DataFrame, name: str, period, by: list[str] | None = None) -> DataFrame:
    by = by or []
    buyers = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col(name).alias("from_node"))
    sellers = supplier.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col(name).alias("to_node"))
    flow = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(*by, period("l_shipdate").alias("ts"), "to_node", "from_node")
        .agg(F.sum("l_extendedprice").alias("w"))
    )
    nodes = places.select(F.col(name).alias("to_node")).distinct()  # a dimension of fixed size
    grid = flow.select(*by, "ts").distinct().crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(nodes.withColumnRenamed("to_node", "from_node")))
    filled = grid.join(flow, [*by, "ts", "to_node", "from_node"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    row = F.sum("w").over(Window.partitionBy(*by, "ts", "to_node"))
    return filled.select(*by, "ts", "to_node", "from_node", F.when(row > 0, F.col("w") / row).otherwise(F.lit(0.0)).alias("theta"))


def nation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, grp: nations by region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("grp"))


#: Invented intervals inside the years of the given tables: ord, start, end, name.
PERIODS = [
    (1, "1995-03-06", "1995-06-30", "harbour strike"),
    (2, "1995-09-15", "1995-09-15", "price shock"),
    (3, "1996-05-06", "1996-12-02", "credit squeeze"),
    (4, "1998-01-12", "1998-03-30", "currency slide"),
    (5, "1999-11-08", "1999-11-08", "storm week"),
    (6, "2000-02-24", "2001-01-15", "long slump"),
]


def stress_periods(spark: SparkSession) -> DataFrame:
    """ord, start, end, name of PERIODS: a dimension of a few rows."""
    rows = spark.createDataFrame(PERIODS, "ord int, start string, end string, name string")
    return rows.select("ord", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "name")


def write_partitioned(df: DataFrame, path: str, by: str = "panel_id") -> DataFrame:
    """``df`` written as parquet in a folder for each value of ``by``, and read back (draws that outgrow memory)."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)
