"""Personal data, prefix tries and whitening against brute force, with nulls, ties, empty and long values and clashing columns."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import pii, prefix_trie, whitening
from lexmill.session import Workspace

# 11

TEXTS = [
    None, "", "a@b.c@d.e", "x.y%z+1@mail-1.example.com, then +1 (743) 555-3824.", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.0.0.255",
    "4111 1111 1111 1111 4111-1111-1111-1112", "+12345678 +1 +1234567 +1((((((((", "@@ a@b @c.d e@f. g@h..i", "é@b.de ü1.1.1.1é", "0" * 50_000,
    "a" * 50_000 + "@b", "1 " * 20_000, "+" * 30_000 + "1", "1.1.1." * 9_000, "mail me at jane (at) example (dot) com",
]


def brute(t):
    t = t or ""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    for t in TEXTS[:9] + TEXTS[14:]:
        assert pii.base_spans(t) == brute(t)
    for _ in range(4000):
        t = "".join(rng.choice(list("0123456789.@+- ()aé:1255"), rng.integers(0, 60)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    began = time.time()
    for t in TEXTS:
        list(pii.candidates(t))
        pii.base_spans(t * 4 if t else t)
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        words = [f"w{x}" if x % 7 else f"{x}" for x in rng.integers(0, 99, 20)]
        words[8] = words[10] = "x"
        d = rng.integers(0, 10, 10)
        number = f"({''.join(map(str, d[:3]))}) 555-{''.join(map(str, d[3:7]))}"
        if i % 3 == 0:
            words[9] = f"+1 {number}" if i % 2 else f"+44 {number}"
        elif i % 60 == 1:
            words[9] = number  # looks alike, but the base pattern misses it
        elif i % 3 == 2:
            words[9] = f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"
        rows.append((i, " ".join(words), "own"))
    return spark.createDataFrame(rows + [(1000 + i, t, "own") for i, t in enumerate(TEXTS)], "doc_id int, text string, __spans string").repartition(3)


def test_trees_add_what_looks_alike(spark, people):
    trees = pii.train(people)
    got = {r.doc_id: r for r in pii.scan(people, trees).collect()}
    assert len(got) == 600 + len(TEXTS)
    for i, t in enumerate(TEXTS):
        found = [(pii.KINDS.index(s.kind), s.start, s.end) for s in got[1000 + i]["__spans"] if s.base]
        assert found == (brute(t) if len(t or "") < 10_000 else pii.base_spans(t))  # the plain patterns are quadratic
    added = {i for i in range(600) if any(not s.base and s.kind == "phone" for s in got[i]["__spans"])}
    want = {i for i in range(600) if i % 60 == 1}
    assert len(added & want) >= 0.9 * len(want) and len(added - want) <= 2
    again = {r.doc_id: r for r in pii.scan(people, pii.train(people)).collect()}
    assert again == got


def test_redaction_and_bounds(spark, people):
    frame = people.select("doc_id", "text", F.lit(0).alias("n")).withColumn("k_0", F.lit("own"))
    got = {r.doc_id: r for r in pii.redact(frame, None, n_chars="n").collect()}
    assert frame.columns == ["doc_id", "text", "n", "k_0"] and got[1000].text is None and got[1001].text == ""
    assert got[1003].text == "<email>, then <phone>." and got[1003].n == len(got[1003].text)
    assert got[1004].text.startswith("<ip>.<ip> and 256.1.1.1 and <ip>")
    none = people.limit(0)
    assert pii.train(none) is None and pii.scan(none, None).collect() == [] and pii.redact(none, None).collect() == []
    assert pii.train(people.where("doc_id >= 1000 and doc_id < 1002")) is None
    pii.train(people, texts=50, most_bytes=1)  # one text at least


# 12


def test_trie_of_a_conversation_in_many_partitions(spark):
    """A conversation with most of all rows, in partitions of which none holds it whole."""
    rows = [(1, k, f"t{k % 5}") for k in range(3000)] + [(c, k, f"t{k % 5}") for c in range(2, 30) for k in range(c)]
    df = spark.createDataFrame(rows, "conv long, k long, text string").withColumn("role", F.lit(None).cast("string"))
    turns = df.select("conv", F.lit(1).alias("o"), "k", *prefix_trie.turn_columns()).union(
        df.select("conv").distinct().select("conv", F.lit(0), F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"))
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.depth: r for r in prefix_trie.trie(turns, Workspace(spark, "test-trie"), [F.col("o"), F.col("k")]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3001
    for d, r in got.items():
        members = [1] + [c for c in range(2, 30) if c >= d]
        assert (r.conv_id, r.n_convs, r.n_children, r.n_leaves) == (1, len(members), int(d < 3000), 1)
        assert r.saved_tokens == sum(len([c for c in range(2, 30) if c >= e]) for e in range(max(d, 1), 30))
        assert r.n_ends == (d in range(2, 30)) + (d == 3000) and r.parent_conv_id == (1 if d else None)


# 13


def whitened(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, __n string").repartition(5)
    return whitening.whiten(df, keep=["vec_id", "__n"], **more).collect()


def test_outer_sums_have_no_error():
    rng = np.random.default_rng(0)
    y = (rng.standard_normal((2500, 5)) * [1, 1e3, 1e6, 1e9, 1e12]).astype(np.int64)
    high, low = whitening.outer_sum(y.astype(float), np.zeros(y.shape))
    exact = y.astype(object).T @ y.astype(object)
    for i in range(5):
        for j in range(5):  # to a double-double's precision, far beyond a double's
            assert abs(int(high[i, j]) + int(low[i, j]) - exact[i, j]) <= abs(y[:, i]).max().item() * abs(y[:, j]).max().item() * 2500 * 2.0**-95


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    c = rng.standard_normal((400, 6)) @ rng.standard_normal((6, 6)) + 5
    c[7] = c[8]
    odd = [None, [], [1.0] * 5 + [None], [float("nan")] * 6, [float("inf")] * 6]
    got = whitened(spark, [(i, v.tolist(), "x") for i, v in enumerate(c)] + [(900 + i, v, "x") for i, v in enumerate(odd)])
    assert len(got) == 400 * 6 and {r["__n"] for r in got} == {400}
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    d = x - x.mean(axis=0)
    values, vecs = np.linalg.eigh(d.T @ d / 400)
    want = (d @ vecs / np.sqrt(values))[:, ::-1]
    mine = np.array([[r["__whitened"] for r in sorted(got, key=lambda r: (r.vec_id, r["__component"])) if r.vec_id == i] for i in range(400)])
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-9
    share = {r["__component"]: r["__explained"] for r in got}
    assert np.allclose([share[k] for k in range(1, 7)], values[::-1] / values.sum(), rtol=1e-9)
    exact = ((400 * x.astype(object) - x.sum(axis=0).astype(object)) ** 2).sum(axis=1)
    assert all(r["__deviation"] == exact[r.vec_id] for r in got) and {r["__identity_error"] < 1e-9 for r in got} == {True}


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, []) == []
    one = whitened(spark, [(1, [1.0, 2.0], None), (None, None, None)])
    assert [(r["__component"], r["__n"], r["__deviation"], r["__whitened"], r["__explained"], r["__identity_error"]) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2)]
    flat = whitened(spark, [(i, [float(i % 4), 3.0, 0.5 * i], None) for i in range(20)] + [(50, [1.0], None), (51, [2.0], None)], components=3)
    three = [r for r in flat if r.vec_id < 50]
    assert {r["__component"]: r["__whitened"] is None for r in three} == {1: False, 2: False, 3: True}
    assert all(r["__n"] == (20 if r.vec_id < 50 else 2) and r["__identity_error"] < 1e-9 for r in flat)
    huge = whitened(spark, [(i, [1e300 * (-1) ** i, 1e12 * i, -3.3e5 * i * i], None) for i in range(12)])
    assert len(huge) == 36 and all(r["__deviation"] is None and (r["__whitened"] is not None or r["__component"] > 1) for r in huge)
