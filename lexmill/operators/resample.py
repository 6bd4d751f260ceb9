"""Resampling by case: all replicates' weights of a case are drawn at once, and sums are made in partitions before the shuffle.

A case has two numbers from a digest of its name and the seed; its draw in replicate r is (a + r * b) mod 2^32, with b odd. Draws
of different cases are independent, and those of one case in two replicates are so pair by pair, which any engine can repeat.
What goes on from a partition is a number for each key and replicate, however many cases there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.relational import place_in_group

#: Draws that a task makes at a time.
BLOCK = 1 << 21


def poisson_steps(most: int = 9) -> list[int]:
    """The distribution function of Poisson(1) at 0, 1, ... in units of 2^-32: a weight is how many of these a draw reaches."""
    out, p, upto = [], math.exp(-1), 0.0
    for k in range(1, most + 1):
        upto += p
        out.append(math.ceil(upto * 2.0**32))
        p /= k
    return out


def numbers(case: Column, seed: int | str) -> list[Column]:
    """The two numbers of a case."""
    d = F.md5(F.concat_ws("|", case.cast("string"), F.lit(str(seed))).cast("binary"))
    part = lambda i: F.conv(F.substring(d, i, 8), 16, 10).cast("bigint")
    return [part(1).alias("__a"), part(9).bitwiseOR(1).alias("__b")]


def replicate_sums(df: DataFrame, keys: Sequence[str], case: str, values: Sequence[str], replicates: int, seed: int, halves: bool = False) -> DataFrame:
    """(keys, r, a sum for each value): values of df's rows, which belong to cases, times the weights of their cases in replicate r.

    Weights are Poisson(1) draws (a bootstrap over cases); with halves they are 0 or 1, and exactly half of the cases have 1 in
    every replicate (one more or less if their number is odd): cases in the order of a digest form pairs, and a draw says which of
    the two it is. A null case is a case; null values count 0. An empty df gives no rows.
    """
    x = df.select(*keys, F.coalesce(F.col(case).cast("string"), F.lit("")).alias("__case"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    if halves:
        order = place_in_group(x.select("__case").distinct().withColumn("__d", F.md5(F.concat_ws("|", "__case", F.lit(f"{seed}order")).cast("binary"))), None, ["__d", "__case"], "__place")
        order = order.select("__case", F.floor(F.col("__place") / 2).alias("__pair"), (F.col("__place") % 2).cast("int").alias("__side"))
        x = x.join(order, "__case").select(*keys, *values, "__side", *numbers(F.col("__pair"), seed))
    else:
        x = x.select(*keys, *values, F.lit(0).alias("__side"), *numbers(F.col("__case"), seed))
    steps = np.array(poisson_steps(), np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.arange(replicates, dtype=np.uint64)
        held: dict[tuple, np.ndarray] = {}
        rows = max(1, BLOCK // replicates)
        for frame in frames:
            for _, g in frame.groupby([*keys], dropna=False, sort=False) if keys else [((), frame)]:
                key = tuple(g[k].iloc[0] for k in keys)
                key = tuple(None if k != k or k is None else k for k in key)
                total = held.setdefault(key, np.zeros((len(values), replicates)))
                a, b, side = (g[c].to_numpy() for c in ("__a", "__b", "__side"))
                v = g[[*values]].to_numpy(float)
                for at in range(0, len(g), rows):
                    part = slice(at, at + rows)
                    u = (a[part, None].astype(np.uint64) + r * b[part, None].astype(np.uint64)) & np.uint64(0xFFFFFFFF)
                    w = ((u >> np.uint64(31)).astype(np.int64) ^ side[part, None]) if halves else np.searchsorted(steps, u, "right")
                    total += v[part].T @ w.astype(float)
        for key, total in held.items():
            yield pd.DataFrame({**{k: [x] for k, x in zip(keys, key, strict=True)}, "sums": [[row.tolist() for row in total]]})

    schema = ", ".join([*(f"`{k}` {x.schema[k].dataType.simpleString()}" for k in keys), "sums array<array<double>>"])
    parts = x.mapInPandas(run, schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip(*[F.get("sums", i).alias(f"s{i}") for i in range(len(values))])).alias("r", "s"))
    return each.groupBy(*keys, "r").agg(*[F.sum(f"s.s{i}").alias(v) for i, v in enumerate(values)])
