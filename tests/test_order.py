"""Ranks and percentiles against numpy, in groups hot and small, with nulls and ties, and without windows over a group."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import order, stats
from lexmill.plans.registry import QUERIES


def rows(n=5000):
    rng = np.random.default_rng(2)
    out = [("hot", float(v)) for v in rng.standard_normal(n)] + [("ties", float(v)) for v in rng.integers(0, 5, 300)]
    return out + [("one", 2.5), (None, 1.0), (None, 3.0), ("hot", None), ("none", None)]


def test_percentiles_and_ranks(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    shares = [0.0, 0.1, 0.25, 0.5, 0.333, 0.99, 1.0]
    got = {r.g: r for r in order.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"hot", "ties", "one", None}
    for g in got:
        v = np.array([x for h, x in data if h == g and x is not None])
        assert got[g].n == len(v) and got[g].largest == (v == v.max()).sum()
        assert np.allclose([got[g][f"p{k}"] for k in range(len(shares))], np.quantile(v, shares), rtol=0, atol=1e-12)
    every = order.percentiles(df, [], "v", [0.5]).collect()
    assert abs(every[0].p0 - np.median([x for _, x in data if x is not None])) < 1e-12
    counts = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    ranks = {(r.g, r.v): r["rank"] for r in order.average_ranks(counts, ["g"], "v", "c").collect()}
    for g in got:
        v = np.array([x for h, x in data if h == g and x is not None])
        for x in v[:200]:
            assert ranks[g, x] == (v < x).sum() + ((v == x).sum() + 1) / 2
    assert order.percentiles(df.limit(0), ["g"], "v", [0.5]).collect() == [] and order.percentiles(df.limit(0), [], "v", [0.5]).collect()[0].p0 is None


def test_no_window_over_a_group(spark):
    df = spark.createDataFrame(rows(500), "g string, v double")
    plans = [order.percentiles(df, ["g"], "v", [0.5]), stats.wilcoxon(df, "v")]
    for p in plans:
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan
    r = stats.wilcoxon(df, "v").first()
    v = np.array([x for _, x in rows(500) if x])
    s = np.abs(v)
    rank = np.array([(s < x).sum() + ((s == x).sum() + 1) / 2 for x in s])
    assert (r.n, r.w) == (len(v), rank[v > 0].sum())


def test_many_differences(spark):
    """The cube of three million is beyond a long's range."""
    n = 3_000_000
    r = stats.wilcoxon(spark.range(n).select((F.col("id") % 10 - F.lit(3.0)).alias("d")), "d").first()
    v = np.array([-3, -2, -1, 1, 2, 3, 4, 5, 6])
    c = n // 10
    below = np.array([(abs(v) < abs(x)).sum() for x in v]) * c
    own = np.array([(abs(v) == abs(x)).sum() for x in v]) * c
    w = float(((below + (own + 1) / 2) * c)[v > 0].sum())
    k, ties = 9 * c, 3 * ((2 * c) ** 3 - 2 * c) + 3 * (c**3 - c)
    z = (w - k * (k + 1) / 4) / (k * (k + 1) * (2 * k + 1) / 24 - ties / 48) ** 0.5
    assert (r.n, r.w) == (k, w) and abs(r.z - z) < 1e-9 * z


def test_the_mean_of_ranked_values_is_exact(spark, tmp_path):
    data = [(9 * 10**18, "a", "x")] + [(k, "a" * k, "xy"[k % 2]) for k in range(1, 21)] + [(-9 * 10**18, "a", "y")]
    spark.createDataFrame(data, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.g: (r.n, r.rank_sum10) for r in QUERIES["continuous_ranks"](spark, str(tmp_path)).collect()}
    v = np.array([len(t) * 0.37 + k * 0.001 for k, t, _ in data])
    m = math.fsum(v) / len(v)
    s = np.abs(v - m)
    rank = np.array([(s < x).sum() + ((s == x).sum() + 1) / 2 for x in s])
    of = np.array([g for *_, g in data])
    assert got == {g: ((of == g).sum(), round(rank[(of == g) & (v > m)].sum() * 10)) for g in "xy"}
