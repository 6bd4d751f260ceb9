"""Overlap of token arrays: prefix, longest run, longest common subsequence, F1, character ratio."""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import blocks
from lexmill.functions.blocks import Blocks  # noqa: F401
from lexmill.functions.numbers import ratio

#: ASCII characters that no word has become blanks.
ASCII_WORDS = bytes(k if k > 127 or chr(k).isalnum() or chr(k) in "_'" else 32 for k in range(256))


def prefix_tokens(p: Column, g: Column) -> Column:
    """How many first tokens agree."""
    same = F.zip_with(p, g, lambda a, b: a.eqNullSafe(b))  # the shorter one is filled with nulls, which break the run
    n = F.array_position(same, False)
    return F.when(n > 0, n - 1).otherwise(F.least(F.size(p), F.size(g))).cast("long")


def token_f1(p: Column, g: Column) -> Column:
    """F1 of the multisets of tokens, 0 where either is empty: the overlap sums the lesser count of each different token."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    overlap = F.aggregate(F.array_distinct(g), F.lit(0), lambda s, t: s + F.least(count(p, t), count(g, t)))
    return F.coalesce(ratio(2 * overlap, F.size(p) + F.size(g)), F.lit(0.0))


def lcs(p: Column, g: Column) -> Column:
    """Length of the longest common subsequence, row by row of the usual table; for short arrays."""
    zero = F.transform(g, lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        def cell(done: Column, y: Column, j: Column) -> Column:
            diagonal = F.when(j == 1, F.lit(0)).otherwise(F.element_at(prev, F.greatest(j - 1, F.lit(1))))
            left = F.coalesce(F.get(done, F.size(done) - 1), F.lit(0))
            return F.concat(done, F.array(F.when(x == y, diagonal + 1).otherwise(F.greatest(left, F.element_at(prev, j)))))

        pairs = F.transform(g, lambda y, j: F.struct(y.alias("y"), (j + 1).alias("j")))
        return F.aggregate(pairs, F.array().cast("array<int>"), lambda done, z: cell(done, z["y"], z["j"]))

    last = F.aggregate(p, zero, row)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), 0).otherwise(F.element_at(last, -1))


def lcs_length(a: list, b: list) -> int:
    """The same, a row of the table at a time as the bits of one number."""
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    masks = {x: sum(1 << i for i in at) for x, at in where.items()}
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := masks.get(y):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    a, b = a.fillna(""), b.fillna("")
    n = a.str.len() + b.str.len()
    return (2 * pd.Series(blocks.matched(a.tolist(), b.tolist()), a.index) / n.where(n > 0)).fillna(1.0).astype("float64")


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("p", "g", "prefix", "run", "lcs", "shared")]))
def token_overlap(p: pd.Series, g: pd.Series, pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Numbers, common prefix, longest run, common subsequence and common multiset of tokens, for texts of any length.

    p and g are the tokens with blanks between; where they are null, those of pred and gold, which are ASCII.
    """
    a, b, rest = [], [], []
    for *given, x, y in zip(p, g, pred, gold, strict=True):
        x, y = ((s.encode().translate(ASCII_WORDS).decode() if w is None else w).split() for w, s in zip(given, (x, y), strict=True))
        m, n = Counter(x), Counter(y)
        prefix = next((k for k, (v, w) in enumerate(zip(x, y)) if v != w), min(len(x), len(y)))  # noqa: B905
        ids = {w: k for k, w in enumerate(m.keys() & n.keys(), 2)}
        codes = [list(map(ids.get, s, repeat(0))) for s in (x, y)]  # 0: words that only one of them has
        rest.append((len(x), len(y), prefix, lcs_length(*(list(filter(None, s)) for s in codes)), sum(min(m[w], n[w]) for w in ids)))
        x, y = (np.array(s, np.uint16 if len(ids) < 65_000 else np.int64) for s in codes)
        y[y == 0] = 1
        a.append(x), b.append(y)
    out = pd.DataFrame(rest, columns=["p", "g", "prefix", "lcs", "shared"])
    return out.assign(run=blocks.longest(a, b))[["p", "g", "prefix", "run", "lcs", "shared"]].astype("int32")


def longest_runs(pairs: DataFrame, key: str, p: str, g: str) -> DataFrame:
    """(key, longest_run): the longest run of tokens that both arrays have, for each pair.

    Equal tokens at (i, j) are joined within a pair; a common run is a gapless stretch of a diagonal i - j.
    """
    a = pairs.select(key, F.posexplode(p).alias("i", "t"))
    b = pairs.select(key, F.posexplode(g).alias("j", "t"))
    hits = a.join(b, [key, "t"]).select(key, "i", (F.col("i") - F.col("j")).alias("d"))
    island = F.col("i") - F.row_number().over(Window.partitionBy(key, "d").orderBy("i"))
    runs = hits.withColumn("island", island).groupBy(key, "d", "island").agg(F.count("*").alias("n"))
    best = runs.groupBy(key).agg(F.max("n").alias("longest_run"))
    return pairs.select(key).distinct().join(best, key, "left").select(key, F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def scores(df: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """All overlap scores of (pred, gold) texts; rows whose gold text has no token are left out. The key must be unique."""
    from lexmill.functions.text import normalize

    return normalized_scores(df.select(key, *[normalize(F.col(c), compat=True).alias(c) for c in (pred, gold)]), key, pred, gold)


def normalized_scores(df: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """The same of texts that are normalised."""
    from lexmill.functions.text import NO_WORD, is_ascii

    # one step for both functions, so that a task has one Python worker; the tokens stay out of the filter, which would find them again
    words = [F.when(~is_ascii(F.col(c)), F.regexp_replace(c, NO_WORD, " ")) for c in (pred, gold)]
    x = df.select(key, (F.col(pred) == F.col(gold)).cast("int").alias("exact_match"), token_overlap(*words, pred, gold).alias("o"), char_ratio(pred, gold).alias("char_ratio"))
    x = x.select(key, "exact_match", "o.*", "char_ratio").where("g > 0")
    f = lambda n: F.coalesce(ratio(2 * F.col(n), F.col("p") + F.col("g")), F.lit(0.0))
    return x.select(
        key,
        "exact_match",
        F.col("prefix").cast("long").alias("prefix_tokens"),
        ratio("prefix", "g").alias("prefix_frac"),
        F.col("run").cast("long").alias("longest_run"),
        ratio("run", "g").alias("longest_run_frac"),
        f("lcs").alias("rouge_l"),
        f("shared").alias("token_f1"),
        "char_ratio",
        F.col("g").alias("gold_tokens"),
        F.col("p").alias("pred_tokens"),
    )
