"""Joins of half-open intervals [lo, hi) of whole numbers by the lengths they have.

An interval has a level, the power of two that its length doesn't exceed. For each pair of levels that occurs the number line
is cut into cells of a size that suits the longer of the two, so that an interval touches a few cells however long it is, and
a key with very many intervals is spread over its cells. Intervals that are null or hold nothing (hi <= lo) meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import Workspace


def _level(lo: Column, hi: Column) -> Column:
    """The least n with hi - lo <= 2^n."""
    return F.when(hi - lo <= 1, 0).otherwise(F.length(F.bin(hi - lo - 1)))


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur, at most 64."""
    return sorted(r[0] for r in df.select("level").distinct().collect())


def _cells(df: DataFrame, own: str, other: str, others: list[int], finer: int) -> DataFrame:
    """A row for each cell that an interval touches, for each level of the other side: cells have 2^(higher level - finer)."""
    x = df.withColumnRenamed("level", own).withColumn(other, F.explode(F.array(*[F.lit(n) for n in others])))
    x = x.withColumn("e", F.greatest(F.greatest(own, other) - finer, F.lit(0)))
    x = x.withColumn("cell", F.explode(F.sequence(F.expr("shiftright(lo, e)"), F.expr("shiftright(hi - 1, e)"))))
    return x.withColumns({"start": F.expr("shiftleft(cell, e)"), "end": F.expr("shiftleft(cell + 1, e)")})


def _proper(df: DataFrame, key: str, *more: str) -> DataFrame:
    lo, hi = F.col("lo").cast("bigint"), F.col("hi").cast("bigint")
    x = df.select(F.col(key).alias("key"), lo.alias("lo"), hi.alias("hi"), *more).where("key is not null and lo < hi")
    return x.withColumn("level", _level(F.col("lo"), F.col("hi")))


def no_overlap(spans: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Spans [lo, hi) of a key that overlap none of the used ones of the same key.

    No pair is ever made. Cells are a quarter of the longer side's level, so the longer side begins or ends in a cell or covers
    it. What is used in a cell so comes down to four numbers, by a partial aggregation: where it begins and ends, and how far
    what comes from the left and goes to the right covers it. Spans with a null key or bound, or that hold nothing, stay.
    """
    ws = Workspace(spans.sparkSession, "intervals")
    rows = ws.write(spans.withColumn("__id", F.monotonically_increasing_id()), "spans")
    a, b = _proper(rows, key, "__id"), _proper(used, key)
    la, lb = _levels(a), _levels(b)
    if not la or not lb:
        return rows.drop("__id")
    u = _cells(b, "lb", "la", la, 2)
    u = u.withColumns({"lo": F.greatest("lo", "start"), "hi": F.least("hi", "end")})
    u = u.groupBy("key", "la", "lb", "cell").agg(
        F.min("lo").alias("first"), F.max("hi").alias("last"),
        F.max(F.when(F.col("lo") == F.col("start"), F.col("hi"))).alias("upto"), F.min(F.when(F.col("hi") == F.col("end"), F.col("lo"))).alias("since"),
    )
    s = _cells(a, "la", "lb", lb, 2)
    s = s.withColumns({"lo": F.greatest("lo", "start"), "hi": F.least("hi", "end")})
    x = ws.write(s, "cells").join(ws.write(u, "used"), ["key", "la", "lb", "cell"])
    from_left, to_right = F.col("lo") == F.col("start"), F.col("hi") == F.col("end")
    long = F.when(from_left & to_right, True).when(from_left, F.col("first") < F.col("hi")).otherwise(F.col("last") > F.col("lo"))
    short = F.coalesce(F.col("lo") < F.col("upto"), F.lit(False)) | F.coalesce(F.col("hi") > F.col("since"), F.lit(False))
    met = x.where(F.when(F.col("la") >= F.col("lb"), long).otherwise(short)).select("__id").distinct()
    return rows.join(met, "__id", "left_anti").drop("__id")


def overlap_pairs(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str) -> DataFrame:
    """(key, a_id, b_id, lo, hi): all pairs of intervals of a key that overlap, with what they share, each once.

    Both touch at most two cells of the higher level's size; a pair counts in the cell where its common part begins. Rows
    that repeat give pairs that repeat.
    """
    ws = Workspace(a.sparkSession, "pairs")
    x, y = _proper(a, key, F.col(a_id).alias("a")), _proper(b, key, F.col(b_id).alias("b"))
    la, lb = _levels(x), _levels(y)
    if not la or not lb:
        return a.sparkSession.createDataFrame([], "key string").select(F.col("key").cast(dict(a.dtypes)[key]).alias(key), F.lit(None).cast(dict(a.dtypes)[a_id]).alias(a_id), F.lit(None).cast(dict(b.dtypes)[b_id]).alias(b_id), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))
    s = ws.write(_cells(x, "la", "lb", lb, 0).select("key", "la", "lb", "cell", "e", "a", "lo", "hi"), "a")
    u = ws.write(_cells(y, "lb", "la", la, 0).select("key", "la", "lb", "cell", "b", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "b")
    both = s.join(u, ["key", "la", "lb", "cell"]).withColumns({"from": F.greatest("lo", "lo2"), "to": F.least("hi", "hi2")})
    both = both.where((F.col("from") < F.col("to")) & (F.expr("shiftright(`from`, e)") == F.col("cell")))
    return both.select(F.col("key").alias(key), F.col("a").alias(a_id), F.col("b").alias(b_id), F.col("from").alias("lo"), F.col("to").alias("hi"))
