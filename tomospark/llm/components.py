"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregate and a join on the node; the edges of each round are written to the shared
folder, so no lineage grows and nothing is gathered on the driver but one row of sums. Where a node has more than HUB
edges, its edges are dealt to as many tasks as their number asks for, each with a copy of the node's least neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table

HUB = 10_000


def _met(edges: DataFrame, hubs: bool) -> tuple[DataFrame, DataFrame]:
    """edges with _m, the least v of their u; and the table of u and _m."""
    mins = edges.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n"))
    if not hubs:
        return edges.join(mins.drop("_n"), "u"), mins
    mins = write_table(mins, "mins")
    # at most (edges / HUB) rows
    large = write_table(mins.where(F.col("_n") > HUB).select("u", F.ceil(F.col("_n") / HUB).cast("int").alias("_parts")), "hubs")
    parts = edges.join(large, "u", "left").withColumn("_salt", F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = mins.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / HUB).cast("int") - 1)))
    return parts.join(copies.drop("_n"), ["u", "_salt"]).drop("_salt"), mins


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    both, _ = _met(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), hubs)
    return write_table(both.where("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct(), "edges")


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    down, mins = _met(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), hubs)
    moved = down.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return write_table(moved.unionAll(mins.select("u", F.col("_m").alias("v"))).distinct(), "edges")


def _measured(edges: DataFrame) -> tuple[tuple, int]:
    """An order-free digest of the edges, and the largest number of edges of a node. No step of the round gives a node more to join than that."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("x"), "u", "v")
    nodes = ends.groupBy("x").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s"), F.bit_xor(F.xxhash64("v", "u", "x")).alias("b"))
    n, s, b, most = nodes.agg(F.sum("n"), F.sum("s"), F.bit_xor("b"), F.max("n")).first()
    return (n, s, b), most or 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of nodes of an orderable type -> (node, component), component the least node reached.

    Only nodes that are not least in their component are returned. Self links and null ends are left out.
    """
    edges = edges.select("u", "v").where("u <> v")
    table = write_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now, most = _measured(table)
        # stars that both steps leave alone are the components
        if not most or now == seen:
            return table.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
        large = _large_star(table, most > HUB)
        drop_table(table)
        table = _small_star(large, most > HUB)
        drop_table(large)
