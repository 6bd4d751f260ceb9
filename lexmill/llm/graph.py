"""Connected components of an edge table, without the driver ever seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that it is linked with, itself included.

    Each round every node goes over to its smallest neighbour and the edges follow, so that edges vanish and rounds number
    about the logarithm of the longest path. Each round's tables are written, which cuts the lineage; joins read written
    tables on both sides, so that adaptive execution can split a node with very many edges. Self-links and repeated edges
    do no harm. An empty table of edges gives an empty result.
    """
    live = ws.write(edges.select("a", "b").where("a <> b").distinct(), f"{name}-e0")
    both = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    label = ws.write(both.withColumn("comp", F.col("node")), f"{name}-l0")
    n = 0
    while not live.isEmpty():
        n += 1
        ends = live.union(live.select("b", "a"))
        up = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("up"))
        up = ws.write(up, f"{name}-u{n}")
        label = label.join(up, label["comp"] == up["x"], "left").select("node", F.coalesce("up", "comp").alias("comp"))
        label = ws.write(label, f"{name}-l{n}")
        first = live.join(up, live["a"] == up["x"]).select(F.col("up").alias("a"), "b")
        first = ws.write(first, f"{name}-f{n}")
        moved = first.join(up, first["b"] == up["x"]).select("a", F.col("up").alias("b")).where("a <> b")
        live = ws.write(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e{n}")
        ws.drop(f"{name}-e{n - 1}", f"{name}-l{n - 1}", f"{name}-u{n}", f"{name}-f{n}")
    return label
