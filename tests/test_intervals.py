"""Interval joins and matched control spans against brute force, with hot keys, nulls and all lengths."""

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import intervals, sampling


def made(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lo = int(rng.integers(-3000, 3000))
        rows.append((int(rng.integers(0, 3)), i, lo, lo + int(2 ** rng.integers(0, 12) + rng.integers(-3, 4))))
    rows += [(0, n, None, 5), (0, n + 1, 5, None), (None, n + 2, 0, 10), (1, n + 3, 7, 7), (1, n + 4, 9, 3), (0, n + 5, 0, 2**40), (2, n + 6, -(2**40), -(2**39))]
    return rows, spark.createDataFrame(rows, f"k int, {name} int, lo bigint, hi bigint").withColumn("__id", F.lit("own"))


def met(x, y):
    return None not in (x[0], y[0], *x[2:], *y[2:]) and x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]


def test_against_brute_force(spark):
    for seed, n, m in ((1, 150, 40), (2, 40, 300), (3, 60, 3)):
        a, da = made(spark, n, seed, "a")
        b, db = made(spark, m, seed + 10, "b")
        want = sorted((x[0], x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if met(x, y))
        assert sorted(map(tuple, intervals.overlap_pairs(da, db, "k", "a", "b").collect())) == want
        free = intervals.no_overlap(da.drop("__id"), db, "k")
        assert sorted(r.a for r in free.collect()) == sorted(x[1] for x in a if not any(met(x, y) for y in b))
    none = da.limit(0)
    assert intervals.overlap_pairs(none, db, "k", "a", "b").collect() == [] and intervals.no_overlap(none.drop("__id"), db, "k").collect() == []
    assert intervals.no_overlap(db.drop("__id"), none, "k").count() == db.count()


def test_a_user_with_very_many_intervals(spark):
    """100,000 spans of one key that all overlap: no pair is made, and only what lies beyond them is free."""
    used = spark.range(0, 100_000, 1, 8).select(F.lit("u").alias("k"), F.col("id").alias("lo"), (F.col("id") + 5_000).alias("hi"))
    spans = spark.range(0, 100_000, 1, 8).select(F.lit("u").alias("k"), "id", (F.col("id") * 2).alias("lo"), (F.col("id") * 2 + 3).alias("hi"))
    free = intervals.no_overlap(spans, used, "k")
    assert free.agg(F.count("*"), F.min("lo"), F.max("lo")).first()[:] == (100_000 - 52_500, 105_000, 199_998)


def test_matched_controls(spark):
    body = " ".join(f"w{i}" for i in range(400))
    at = lambda i: body.index(f"w{i} ")
    rows = [
        ("a", body, [(at(50), at(62) - 1), (at(200), at(212) - 1)], [(at(300), len(body))]),
        ("b", " ".join(["x"] * 40), [(0, 19)], None),
        ("c", None, [(0, 5)], None),
        ("d", body, None, None),
        ("e", body, [(0, len(body)), (at(5), at(10) - 1)], None),
        ("f", "", [(0, 0)], None),
    ]
    df = spark.createDataFrame(rows, "k string, t string, s array<struct<lo:int,hi:int>>, u array<struct<lo:int,hi:int>>")
    got = {(r.k, r.span): r for r in sampling.matched_controls(df, "k", "t", "s", "u").collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 0), ("e", 0), ("e", 1), ("f", 0)]
    taken = [(50, 62), (200, 212), (300, 400)]
    for i in range(2):
        r = got["a", i]
        assert r.n_words == 12 and len(r.controls) == 3 and 3 <= r.tries <= 90
        for c in r.controls:
            assert len(body[c.lo : c.hi].split()) == 12 and body[c.lo :].startswith(f"w{c.word} ") and 15 <= c.word <= 400 - 12 - 5
            assert not any(c.word < b and c.word + 12 > a for a, b in taken)
            taken.append((c.word, c.word + 12))
    assert (got["b", 0].controls, got["b", 0].tries) == ([], 0)
    assert (got["e", 1].controls, got["e", 1].tries) == ([], 90)  # the whole text is taken: all draws are made
    assert (got["f", 0].n_words, got["f", 0].tries) == (0, 0)


def in_turn(rows):
    used: tuple = (set(), set())
    out = []
    for i, x, y in rows:
        if x == "old" or y == "b-old" or x in used[0] - {None} or y in used[1] - {None}:
            continue
        out.append(i)
        used[0].add(x)
        used[1].add(y)
    return out


def test_layers_of_long_chains(spark):
    """A chain of 10,000 rows that share keys two by two, as if row by row; then random keys, a hot key and nulls, a part at a time."""
    from lexmill.operators import relational

    rng = np.random.default_rng(6)
    old = spark.createDataFrame([("old", "b-old")], "x string, y string")
    chain = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(10_000)]
    mixed = [(i, f"r{rng.integers(200)}" if i % 5 else None, f"s{rng.integers(200)}" if i % 7 else None) for i in range(500)]
    mixed += [(3000 + i, "hot", f"h{i // 3}") for i in range(300)] + [(4000, None, None), (4001, "old", None), (4002, None, "b-old")]
    for rows, together in ((chain, 200_000), (mixed, 250)):
        df = spark.createDataFrame(rows, "id int, x string, y string").repartition(4)
        got = relational.three_layer_dedup(df, old, ["x", "y"], ["id"], together)
        assert got.columns == ["id", "x", "y"] and sorted(r.id for r in got.collect()) == in_turn(rows)
