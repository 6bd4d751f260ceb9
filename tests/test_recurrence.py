"""Recurrence of spans against a plain reading, and what it shuffles at a time."""

import random

from pyspark.sql import functions as F

from lexmill.operators import shingle
from lexmill.plans.registry import QUERIES


def texts(n=60, seed=3):
    rng = random.Random(seed)
    made = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 5, 29, 30, 95, 250]))] for _ in range(n)]
    made[7] = made[3] + made[7]
    made[8] = made[4][20:] + made[8]
    made[11] = made[12] = ["same"] * 200
    made[20] += made[20] + made[21]
    return [" ".join(x) for x in made] + [None]


def test_recurrence_against_plain_reading(spark):
    rows = [(i, t, ("pre", "post", None)[i % 3]) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc bigint, text string, arm string").repartition(5)
    got = {(r.doc, r.start): r[2:] for r in shingle.recurrence_at(df, "doc", "text", "arm", 30, 60).collect()}
    of = {i: [tuple(w[k : k + 8]) for k in range(len(w) - 7)] for i, t, _ in rows if t for w in [t.split()]}
    have = {a: {} for a in ("pre", "post")}
    for i, _, a in rows:
        for s in of.get(i, ()) if a else ():
            have[a].setdefault(s, set()).add(i)
    want = {}
    for i, runs in of.items():
        for start in range(0, len(runs) + 7 - 30 + 1, 60):
            x = set(runs[start : start + 23])
            share = lambda f: sum(map(f, x)) / len(x)  # noqa: B023, E731
            other = [share(lambda s, a=a: bool(have[a].get(s, set()) - {i})) for a in ("post", "pre")]  # noqa: B023
            want[i, start] = (len(x), *other, share(lambda s: runs.index(s) + 8 <= start))  # noqa: B023
    assert got == want and {r[1] for r in want.values()} >= {0.0, 1.0}


def test_recurrence_shuffles_a_part_of_the_shingles_at_a_time(spark, tmp_path):
    words = 400_000
    at = F.concat_ws(" ", F.transform(F.sequence(F.col("id") * 2000, F.col("id") * 2000 + 1999), lambda k: F.hex(k)))
    spark.range(words // 2000).select(F.col("id").alias("doc_id"), at.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        seen = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {seen.apply(k).stageId(): seen.apply(k).shuffleWriteBytes() for k in range(seen.size())}

    before = stages()
    assert QUERIES["recurrence_fractions"](spark, str(tmp_path)).count() == words // 2000 * 33
    assert max(v for k, v in stages().items() if k not in before) < 4 * words
