"""Groups of rows that hang together by shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import Workspace


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, comp): for each end of links (a, b) the smallest node of its component.

    Nodes are compared by a hash (then by themselves), so that a chain in the order of its nodes is none in that of the hashes.
    Every round a node points to the smallest node that it sees, pointers are followed once, and links go over to what their ends
    point to; links within one node go. Paths so shorten by a factor each round: rounds number about the logarithm of the longest.
    """
    mixed = [F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n")).alias(c) for c in ("a", "b")]
    links = links.select(*mixed)
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = ws.write(ends.where("a <> b").distinct(), "links-0")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    point = ws.write(nodes.withColumn("comp", F.col("node")), "nodes-0")
    k = 0
    while not now.isEmpty():
        k += 1
        seen = now.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        to = ws.write(seen.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("y")), f"to-{k}")
        on = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
        to = ws.write(to.join(on, "y").select("x", F.col("z").alias("y")), f"on-{k}")  # what a node points to points on
        point = ws.write(point.join(to, F.col("comp") == F.col("x"), "left").select("node", F.coalesce("y", "comp").alias("comp")), f"nodes-{k}")
        first = now.join(to, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        both = first.join(to, F.col("b") == F.col("x")).select("a", F.col("y").alias("b")).where("a <> b")
        now = ws.write(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"links-{k}")
        ws.drop(f"links-{k - 1}", f"nodes-{k - 1}", f"to-{k}", f"on-{k}")
    least = ws.write(point.groupBy("comp").agg(F.min("node.n").alias("least")), "least")
    return point.join(least, "comp").select(F.col("node.n").alias("node"), F.col("least").alias("comp"))
