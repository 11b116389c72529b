"""Connectedness indices from theta tables (ts, to_node, from_node, theta), all by Spark aggregates.

``to_node`` is the row (it receives), ``from_node`` the column (it sends). Shares are divided by the number of
nodes of the date and given in percent. A panel_id column is carried along where the table has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def keys(theta: DataFrame) -> list[str]:
    return [c for c in ("panel_id", "ts") if c in theta.columns]


def sizes(theta: DataFrame) -> DataFrame:
    return theta.groupBy(*keys(theta)).agg(F.count_distinct("to_node").alias("n"))


def _others(theta: DataFrame, node: str, name: str, scaled: bool) -> DataFrame:
    by = keys(theta)
    off = F.when(F.col("to_node") != F.col("from_node"), F.col("theta")).otherwise(0.0)
    found = theta.groupBy(*by, F.col(node).alias("node")).agg(F.sum(off).alias(name), F.count("*").alias("_n"))
    return found.select(*by, "node", (F.col(name) * (100 / F.col("_n")) if scaled else F.col(name)).alias(name))  # a row or column has one entry per node


def to_others(theta: DataFrame, scaled: bool = True) -> DataFrame:
    """node, to_idx: what each node sends to the others."""
    return _others(theta, "from_node", "to_idx", scaled)


def from_others(theta: DataFrame, scaled: bool = True) -> DataFrame:
    """node, from_idx: what each node receives from the others."""
    return _others(theta, "to_node", "from_idx", scaled)


def net(theta: DataFrame, scaled: bool = True) -> DataFrame:
    """node, to_idx, from_idx, net_idx = to - from. One shuffle: each entry gives a sent and a received share, 0 on the diagonal."""
    by = keys(theta)
    value = F.when(F.col("to_node") != F.col("from_node"), F.col("theta")).otherwise(0.0)
    both = theta.select(*by, F.explode(F.array(
        F.struct(F.col("from_node").alias("node"), value.alias("s"), F.lit(0.0).alias("r")),
        F.struct(F.col("to_node").alias("node"), F.lit(0.0).alias("s"), value.alias("r")))).alias("e"))
    found = both.groupBy(*by, F.col("e.node").alias("node")).agg(F.sum("e.s").alias("s"), F.sum("e.r").alias("r"), (F.count("*") / 2).alias("n"))
    scale = 100 / F.col("n") if scaled else F.lit(1.0)
    return found.select(*by, "node", (F.col("s") * scale).alias("to_idx"), (F.col("r") * scale).alias("from_idx"), ((F.col("s") - F.col("r")) * scale).alias("net_idx"))


def tci(theta: DataFrame) -> DataFrame:
    """tci: the sum of all that is sent to others, in percent of the nodes."""
    by = keys(theta)
    off = F.when(F.col("to_node") != F.col("from_node"), F.col("theta")).otherwise(0.0)
    return theta.groupBy(*by).agg((F.sum(off) * 100 / F.sqrt(F.count("*"))).alias("tci"))


def tci_from_trace(theta: DataFrame) -> DataFrame:
    """tci as 100 (1 - trace / n), equal to tci() where rows sum to 1."""
    by = keys(theta)
    own = F.when(F.col("to_node") == F.col("from_node"), F.col("theta")).otherwise(0.0)
    return theta.groupBy(*by).agg((100 * (1 - F.sum(own) / F.sqrt(F.count("*")))).alias("tci"))


def pairwise(theta: DataFrame) -> DataFrame:
    """to_node, from_node, pdc = theta(to, from) - theta(from, to)."""
    by = keys(theta)
    back = theta.select(*by, F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), F.col("theta").alias("_back"))
    return theta.join(back, [*by, "to_node", "from_node"]).select(*by, "to_node", "from_node", (F.col("theta") - F.col("_back")).alias("pdc"))


def normalized(theta: DataFrame) -> DataFrame:
    """Rows divided by their sums; rows that sum to (nearly) 0 stay."""
    total = F.sum("theta").over(Window.partitionBy(*keys(theta), "to_node"))
    return theta.withColumn("theta", F.col("theta") / F.when(total > FLOOR, total).otherwise(1.0))


def sub_network(theta: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """theta among ``nodes`` alone, rows summing to 1 again. Unknown nodes are an error; no nodes give no rows."""
    known = {r[0] for r in theta.where(F.col("to_node").isin(list(nodes))).select("to_node").distinct().collect()} if nodes else set()
    if missing := set(nodes) - known:
        raise ValueError(f"no such node: {sorted(missing)}")
    return normalized(theta.where(F.col("to_node").isin(list(nodes)) & F.col("from_node").isin(list(nodes))))
