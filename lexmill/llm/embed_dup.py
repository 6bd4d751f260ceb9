"""Near-duplicates of embeddings by spherical-cap filters.

A filter is a direction, and a vector passes it if their inner product is large enough. Directions are the words of random
product codes: a code turns the space at random, cuts it into blocks and has some codewords for each; every choice of one
codeword a block is a direction. List decoding finds all directions of a code that a vector passes without trying each.
Vectors that share a filter are compared exactly. Codes are turned independently, so the chance that a pair shares no filter
of a code depends on its cosine alone, not on where it lies; it is measured, and the number of codes follows from it. Equal
vectors form a class that is looked at once.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_rows
from lexmill.llm.graph import components
from lexmill.session import Workspace

#: A pair at the least similarity shares no filter of any code with a chance of at most e^-SHARED.
SHARED = 14.0
#: Rows of a block within a filter; vectors that pass a filter on average, as far as the dimension allows, but at most this share.
BLOCK, PASSING, WIDEST = 1024, 512, 1 / 8
#: Filters of one code that a vector passes on average (directions of one code depend on each other, so that many codes with few
#: directions each list fewer filters for the same chance of meeting); most codewords of a block, and least dimensions; share of the
#: partners at the least cosine of a filter's vectors that pass it too, at least (narrower caps keep partners apart in few dimensions).
LISTED, MOST_WORDS, DIMENSIONS, FOLLOW = 0.25, 4096, 4, 0.2
#: Pairs, and codes that they are dealt to, from which the chance of meeting in a code is measured.
TRIALS, CODES = 8192, 8


@cache
def _angles(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of the sphere within each of them from a direction."""
    phi = np.linspace(0, np.pi, 200_001)
    with np.errstate(divide="ignore"):
        density = np.exp((dim - 2) * np.log(np.sin(phi))) if dim > 2 else np.ones_like(phi)
    share = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return phi, share / share[-1]


def share_of(dim: int, bound: float) -> float:
    """The share of the sphere with an inner product of at least `bound` with a direction."""
    phi, share = _angles(dim)
    return float(np.interp(np.arccos(bound), phi, share))


def follows(dim: int, bound: float, cosine: float) -> float:
    """Of the partners at that cosine of a cap's vectors, the share that is in the cap too."""
    phi, share = _angles(dim)
    edge = np.arccos(bound)
    inside = np.interp(np.linspace(0, 1, 201)[1:] * np.interp(edge, phi, share), share, phi)  # angles of equally many vectors each
    need = (bound - cosine * np.cos(inside)) / (np.sqrt(1 - cosine * cosine) * np.maximum(np.sin(inside), 1e-12))
    if dim == 2:  # the partner lies to either side
        return float(((need <= -1) + 0.5 * ((need > -1) & (need <= 1))).mean())
    return float(np.interp(np.arccos(np.clip(need, -1, 1)), *_angles(dim - 1)).mean())


class Plan(NamedTuple):
    """Filters for a number of vectors: least inner product, blocks and codewords of a code, codes. Without codes (a least cosine
    that nearly any pair has) there is one bucket."""

    bound: float
    blocks: int
    words: int
    codes: int

    @property
    def filters(self) -> int:
        """Of one code."""
        return self.words**self.blocks


@cache
def plan(n: int, cosine: float, dim: int) -> Plan:
    """Caps that PASSING of n vectors pass on average, as many directions a code that a vector passes LISTED of them, in two blocks or
    more where the dimension allows it, and as many codes as SHARED asks for, by the measured chance of meeting."""
    if cosine <= 0:
        return Plan(-1.0, 1, 1, 0)
    if dim == 1:
        return Plan(0.5, 1, 2, 1)
    phi, share = _angles(dim)
    bound = float(np.cos(np.interp(min(WIDEST, PASSING / n), share, phi)))
    if cosine < 1 and follows(dim, bound, cosine) < FOLLOW:
        low, high = 0.0, bound
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if follows(dim, mid, cosine) >= FOLLOW else (low, mid)
        bound = low
    directions = LISTED / share_of(dim, bound)
    blocks = 2 if 2 * DIMENSIONS <= dim else 1
    while directions ** (1 / blocks) > MOST_WORDS and DIMENSIONS * (blocks + 1) <= dim:
        blocks += 1
    first = Plan(bound, blocks, max(2, int(np.ceil(directions ** (1 / blocks)))), 1)
    p = meets(first, cosine, dim)
    return first._replace(codes=1 if p >= 1 else int(np.ceil(SHARED / -np.log1p(-p))))


def meets(by: Plan, cosine: float, dim: int) -> float:
    """A lower bound (three standard errors) of the chance that two vectors of that cosine share a filter of one code."""
    rng, hits = np.random.default_rng(7), 0
    for c in range(CODES):
        x, z = rng.standard_normal((2, TRIALS // CODES, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (x * z).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z / np.linalg.norm(z, axis=1, keepdims=True)
        (i, f), (j, g) = (decode(v, by, c) for v in (x, y))
        n = by.filters
        hits += len(np.unique(np.intersect1d(i * n + f, j * n + g, assume_unique=True) // n))
    p = hits / TRIALS
    return max(p - 3 * np.sqrt(p * (1 - p) / TRIALS) - 9 / TRIALS, 1 / TRIALS)


@cache
def code(dim: int, blocks: int, words: int, number: int) -> list[np.ndarray]:
    """Each block's codewords as columns, turned back into the space; a direction is a sum of one of each block, at length 1."""
    if dim == 1:
        return [np.array([[1.0, -1.0]], np.float32)]
    rng = np.random.default_rng([64, dim, blocks, words, number])
    turn, out = np.linalg.qr(rng.standard_normal((dim, dim)))[0], []
    for part in np.array_split(np.arange(dim), blocks):
        c = rng.standard_normal((words, len(part)))
        c *= np.sqrt(len(part) / dim) / np.linalg.norm(c, axis=1, keepdims=True)
        out.append((turn[:, part] @ c.T).astype(np.float32))
    return out


def decode(x: np.ndarray, by: Plan, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of a code that unit vectors pass, by row and filter.

    Block by block, a partial direction goes on only if the best words of the other blocks could still lift it to the bound.
    """
    scores = [x.astype(np.float32) @ c for c in code(x.shape[1], by.blocks, by.words, number)]
    rest = np.zeros((len(scores) + 1, len(x)), np.float32)
    for k in range(len(scores) - 1, -1, -1):
        rest[k] = rest[k + 1] + scores[k].max(axis=1)
    row, ids, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    for k, s in enumerate(scores):
        reach = s[row]
        reach += (total + rest[k + 1][row])[:, None]
        at, word = np.nonzero(reach >= np.float32(by.bound))
        total = total[at] + s[row[at], word]
        ids = ids[at] * by.words + word
        row = row[at]
    return row, ids


def filters(x: np.ndarray, by: Plan) -> list[np.ndarray]:
    """The filters of all codes that each unit vector passes, in ascending order; without codes all pass the only one."""
    if not by.codes:
        return [np.zeros(1, np.int64)] * len(x)
    found = [decode(x, by, c) for c in range(by.codes)]
    row = np.concatenate([r for r, _ in found])
    ids = np.concatenate([f + c * by.filters for c, (_, f) in enumerate(found)])
    order = np.argsort(row, kind="stable")
    return np.split(ids[order], np.searchsorted(row[order], np.arange(1, len(x))))


def width(by: Plan) -> type:
    """The narrowest numbers that hold the plan's filters."""
    most = max(1, by.codes) * by.filters
    return np.uint16 if most <= 1 << 16 else np.uint32 if most <= 1 << 32 else np.uint64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled first, so that very large or small vectors keep a finite length."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_only(near: np.ndarray, before: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> None:
    """Clears the pairs (p[i], q[j]) of a filter that have met in an earlier one, so that each counts once."""
    i, j = np.nonzero(near)
    if len(i) <= 4 * (len(p) + len(q)):
        sets = {k: set(before[k].tolist()) for k in {*p[i].tolist(), *q[j].tolist()}}
        met = [not sets[a].isdisjoint(sets[b]) for a, b in zip(p[i].tolist(), q[j].tolist(), strict=True)]
        met = np.array(met, bool)
        near[i[met], j[met]] = False
        return
    # many pairs: filter by filter, all pairs of those that passed it
    rows, cols = (np.unique(k) for k in (i, j))

    def passed(at: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [before[k] for k in side[at]]
        who = np.repeat(at, [len(x) for x in ids])
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        order = np.argsort(ids, kind="stable")
        return ids[order], who[order]

    (f, a), (g, b) = passed(rows, p), passed(cols, q)
    both = np.intersect1d(f, g)
    cuts = [np.searchsorted(f, both), np.searchsorted(f, both, "right"), np.searchsorted(g, both), np.searchsorted(g, both, "right")]
    for fa, fb, ga, gb in zip(*(k.tolist() for k in cuts), strict=True):
        near[np.ix_(a[fa:fb], b[ga:gb])] = False


def roots(n: int, p: np.ndarray, q: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each of n rows the first row of its component under the links near[p, q]: a forest, which is enough for components."""
    i, j = np.nonzero(near)
    top = np.arange(n)
    if not len(i):
        return top
    if len(i) > 16 * n:  # dense: whole neighbourhoods at a time
        full = np.zeros((n, n), bool)
        full[p[i], q[j]] = full[q[j], p[i]] = True
        seen = ~full.any(axis=1)
        for k in range(n):
            if not seen[k]:
                mine, edge = np.zeros(n, bool), np.zeros(n, bool)
                mine[k] = edge[k] = True
                while edge.any():
                    edge = full[edge].any(axis=0) & ~mine
                    mine |= edge
                seen |= mine
                top[mine] = k
        return top
    up = list(range(n))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in zip(p[i].tolist(), q[j].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(n)], int)


def groups(
    df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", keep: list[str] | None = None, cosine: float = 0.9
) -> DataFrame:
    """Every row of df (columns `keep`, all by default) with __n_links, __component and __kept.

    Two rows are linked if their vectors have the same length and their cosine, in double precision, is at least `cosine`. A vector
    that is null, empty, zero, or that holds null or non-finite components is linked with nothing. __n_links counts the
    other rows linked directly, __component is the smallest id reachable, __kept whether that is the row's own. Rows that repeat
    a vector are linked with each other. An empty table gives an empty one.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "embeddings")
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("__n_links", "__component", "__kept")]
    v = F.col(vector)
    single = df.schema[vector].dataType.elementType.typeName() == "float"
    v, raw = (v, np.float32) if single else (F.transform(v, lambda x: x.cast("double")), np.float64)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(finite & (F.size(v) > 0) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], F.col(id_col).cast("long").alias("id"), F.when(ok, v).alias("v"))
    rows = ws.write(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    good = rows.where("v is not null")

    classes = good.groupBy("v").agg(F.min("rid").alias("rep"), F.min("id").alias("id"), F.count("*").alias("c"))
    classes = ws.write(classes, "classes")
    sizes = classes.groupBy(F.size("v").alias("d")).count().collect()  # a row for each length
    plans = {r["d"]: plan(r["count"], cosine, r["d"]) for r in sizes}

    def split():
        def run(r):
            out = {"rep": [], "c": [], "d": [], "u": [], "w": [], "f": []}
            for d in sorted(set(map(len, r["v"]))):
                at = [k for k, v in enumerate(r["v"]) if len(v) == d]
                x = np.array([r["v"][k] for k in at], raw)
                found, wide = filters(unit(x), plans[d]), width(plans[d])
                for name in ("rep", "c"):
                    out[name] += [r[name][k] for k in at]
                out["d"] += [d] * len(at)
                out["u"] += [u.tobytes() for u in x]
                out["w"] += [f.astype(wide).tobytes() for f in found]
                out["f"] += [f.tolist() for f in found]
            return out

        return run

    found = ws.write(map_rows(classes.select("rep", "c", "v"), split, "rep bigint, c bigint, d int, u binary, w binary, f array<bigint>"), "filters")
    passing = found.select("d", F.explode("f").alias("f")).groupBy("d", "f").agg(F.count("*").alias("n"))
    passing = ws.write(passing.where("n > 1"), "sizes")
    # a row for each filter that a vector passes, with those before it; a filter that many pass is cut into blocks, and each
    # pair of blocks is a group of its own
    each = found.select("rep", "c", "d", "u", "w", (F.octet_length("w") / F.size("f")).cast("int").alias("wide"), F.posexplode("f").alias("t", "f"))
    each = each.withColumn("w", F.expr("substring(w, 1, t * wide)")).drop("t", "wide").join(passing, ["d", "f"])
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    each = each.withColumn("b", F.pmod(F.xxhash64("rep"), n_blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    each = each.select("d", "f", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "rep", "c", "u", "w")
    wide = {d: width(p) for d, p in plans.items()}

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, _, lo, hi = (int(k) for k in key)
        rep, c, b = pdf["rep"].to_numpy(), pdf["c"].to_numpy(), pdf["b"].to_numpy()
        x = unit(np.frombuffer(b"".join(pdf["u"]), raw).reshape(len(pdf), dim))
        p = np.flatnonzero(b == lo)
        q = p if lo == hi else np.flatnonzero(b == hi)
        near = x[p] @ x[q].T >= cosine
        if lo == hi:
            near = np.triu(near, 1)
        first_only(near, [np.frombuffer(w, wide[dim]) for w in pdf["w"]], p, q)
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, p, near.astype(np.int64) @ c[q])
        np.add.at(links, q, near.astype(np.int64).T @ c[p])
        top = roots(len(pdf), p, q, near)
        use = (links > 0) | (top != np.arange(len(pdf)))
        return pd.DataFrame({"a": rep[use], "b": rep[top][use], "links": links[use]})

    got = ws.write(each.groupBy("d", "f", "lo", "hi").applyInPandas(compare, "a bigint, b bigint, links bigint"), "compared")
    comps = components(got.select("a", "b"), ws, "cc")
    links = got.groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.select("rep", "id", "c").join(comps, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("a"), "left")
    named = named.select("rep", "id", F.coalesce("comp", "rep").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("links"))
    named = ws.write(named, "named")
    least = ws.write(named.groupBy("comp").agg(F.min("id").alias("component")), "least")
    named = ws.write(named.join(least, "comp").select("rep", "component", "links"), "labels")
    mine = ws.write(good.select("rid", "v").join(classes.select("v", "rep"), "v").select("rid", "rep"), "members")
    mine = ws.write(mine.join(named, "rep").select("rid", "component", "links"), "results")
    out = rows.drop("v").join(mine, "rid", "left")
    component = F.coalesce("component", "id")
    ws.drop("filters", "sizes", "classes", "compared")
    return out.select(
        *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)],
        F.coalesce("links", F.lit(0)).alias("__n_links"),
        component.alias("__component"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("__kept"),
    )
