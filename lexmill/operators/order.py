"""Ranks and percentiles of values of which nearly every row may have its own, without a window over a group.

Different values are counted, dealt by ranges of group and value, and summed up in their partition; what lies before a group's
rows of a partition follows from a table with a row for each partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import Workspace


def below(counts: DataFrame, by: Sequence[str], value: str, n: str) -> DataFrame:
    """counts (a row for each group and different value, n times) with `below`: how many of the group's values are smaller.

    Null groups are groups of their own; a null value is smaller than all others.
    """
    ws = Workspace(counts.sparkSession, "order")
    names = [f"__g{i}" for i in range(max(1, len(by)))]
    x = counts.withColumns(dict(zip(names, [F.col(c) for c in by] or [F.lit(0)], strict=True)))
    x = x.repartitionByRange(*names, F.col(value)).withColumn("__part", F.spark_partition_id())
    x = ws.write(x, "dealt")
    inside = Window.partitionBy("__part", *names).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)  # within one range
    x = x.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    parts = x.groupBy(*names, "__part").agg(F.sum(n).alias("__n"))
    before = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"{g}_") for g in names], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = F.col("__part") == F.col("__p")
    for g in names:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}_"))
    return x.join(parts, on).withColumn("below", (F.col("__in") + F.col("__before")).cast("long")).select(*counts.columns, "below")


def average_ranks(counts: DataFrame, by: Sequence[str], value: str, n: str) -> DataFrame:
    """counts with rank: the average rank, from 1, of a value among its group's."""
    return below(counts, by, value, n).withColumn("rank", F.col("below") + (F.col(n) + 1) / 2).drop("below")


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, n, largest, p0, p1, …): exact percentiles of a group's values that aren't null, between two neighbours in proportion;
    largest is how many rows have the greatest value. A group without values has no row, an ungrouped table without any one of nulls."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__c"))
    x = below(counts, by, "__v", "__c")
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    if by:
        on = F.lit(True)
        for c in by:
            on = on & x[c].eqNullSafe(F.col(f"__of_{c}"))
        x = x.join(sizes.select(*[F.col(c).alias(f"__of_{c}") for c in by], "__n"), on)
    else:
        x = x.crossJoin(F.broadcast(sizes))  # one row

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("__c")), F.col("__v")))

    made = []
    for k, share in enumerate(shares):
        h = F.lit(share) * (F.col("__n") - 1)
        low, high = at(F.floor(h)), at(F.ceil(h))
        part = F.max(h - F.floor(h))
        made.append((low + (high - low) * part).alias(f"p{k}"))
    top = F.max(F.when(F.col("below") + F.col("__c") == F.col("__n"), F.col("__c")))
    return x.groupBy(*by).agg(F.max("__n").alias("n"), top.alias("largest"), *made)
