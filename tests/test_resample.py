"""Replicates drawn by case against sums made one by one, even halves, and the tails of a family's effect."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import resample, stats


def weights(case, seed, replicates):
    d = hashlib.md5(f"{case}|{seed}".encode()).hexdigest()
    a, b = int(d[:8], 16), int(d[8:16], 16) | 1
    return [sum(((a + r * b) % 2**32) >= s for s in resample.poisson_steps()) for r in range(replicates)]


def test_sums_of_replicates(spark):
    rows = [(f"k{i % 3}" if i % 7 else None, i % 40, float(i), 1.0 if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, c int, v double, w double").repartition(5)
    got = {(r.k, r.r): (r.v, r.w) for r in resample.replicate_sums(df, ["k"], "c", ["v", "w"], 50, 3).collect()}
    assert len(got) == 4 * 50
    want: dict = {}
    for k, c, v, w in rows:
        for r, x in enumerate(weights(c, 3, 50)):
            s = want.setdefault((k, r), [0.0, 0.0])
            s[0] += x * v
            s[1] += x * (w or 0)
    assert all(np.allclose(got[k], want[k]) for k in want)
    assert resample.replicate_sums(df.limit(0), ["k"], "c", ["v"], 5, 0).collect() == []
    whole = resample.replicate_sums(df, [], "c", ["v"], 2000, 1).agg(F.avg("v")).first()[0]
    assert abs(whole / sum(v for _, _, v, _ in rows) - 1) < 0.03


def test_halves_are_even(spark):
    for cases in (100, 101):
        df = spark.range(cases).select(F.col("id").alias("c"), F.lit(1.0).alias("n"))
        got = [r.n for r in resample.replicate_sums(df, [], "c", ["n"], 40, 5, halves=True).collect()]
        assert len(got) == 40 and all(abs(n - cases / 2) <= 0.5 for n in got)
    one = resample.replicate_sums(spark.createDataFrame([(c, c, 1.0) for c in range(30)], "k int, c int, n double"), ["k"], "c", ["n"], 60, 5, halves=True).collect()
    taken = {k: [r.n for r in sorted(one, key=lambda r: r.r) if r.k == k] for k in range(30)}
    assert all(set(v) == {0.0, 1.0} for v in taken.values()) and 10 < sum(v[0] != v[1] for v in taken.values()) + sum(v[7] != v[30] for v in taken.values()) < 50


def test_family_effects_count_in_one_direction(spark):
    rng = np.random.default_rng(4)
    models = list(range(16))
    fam = spark.createDataFrame([(m, m % 4) for m in models], "model int, family int")
    size = spark.createDataFrame([(m, float(rng.random())) for m in models], "model int, x double")
    for sign, near in ((-1, True), (1, False)):  # kin are nearer, kin are farther
        rows = [(a, b, 0.5 + 0.2 * sign * (a % 4 == b % 4) + 0.05 * float(rng.random())) for a in models for b in models if a < b]
        r = stats.distance_drivers(spark.createDataFrame(rows, "a int, b int, d double"), size, fam, "model", "x", "family", 400).first()
        assert (r.same_family < -0.1 and r.p < 0.01) if near else (r.same_family > 0.1 and r.p > 0.9)
