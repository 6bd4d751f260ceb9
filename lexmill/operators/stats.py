"""Statistics and resampling. Replicates are drawn by hashes, so that they come out alike on any cluster."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.numbers import ratio
from lexmill.operators.resample import replicate_sums
from lexmill.session import Workspace

#: Models that a pairwise matrix may have on the driver.
MAX_MODELS = 2_000


def divergences(counts: DataFrame, by: Sequence[str], model: str, feature: str, n: str) -> DataFrame:
    """(by, a, b, d): Jensen-Shannon divergence of each pair of models by their counts of features, a < b; 1 without a common feature."""
    from pyspark.sql import Window

    p = counts.where(F.col(n) > 0).select(*by, F.col(model).alias("m"), F.col(feature).alias("f"), ratio(n, F.sum(n).over(Window.partitionBy(*by, model))).alias("p"))
    m = p.select(*by, "m").distinct()
    every = m.withColumnRenamed("m", "a").join(m.withColumnRenamed("m", "b"), list(by)).where("a < b")
    x = p.withColumnRenamed("m", "a").join(p.select(*by, "f", F.col("m").alias("b"), F.col("p").alias("q")), [*by, "f"]).where("a < b")
    h = (F.col("p") + F.col("q")) / 2
    k = F.sum(F.col("p") * F.log2(F.col("p") / h) / 2 + F.col("q") * F.log2(F.col("q") / h) / 2)
    x = x.groupBy(*by, "a", "b").agg((k + (1 - F.sum("p")) / 2 + (1 - F.sum("q")) / 2).alias("d"))
    return every.join(x, [*by, "a", "b"], "left").select(*by, "a", "b", F.coalesce("d", F.lit(1.0)).alias("d"))


@F.pandas_udf(T.DoubleType())
def sign_p(up: pd.Series, down: pd.Series) -> pd.Series:
    """Two-sided binomial p of so many ups and downs; 1 without any."""

    def one(a: int, b: int) -> float:
        n, k = a + b, min(a, b)
        if not n:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        top = max(logs)
        return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))

    return pd.Series([one(int(a), int(b)) for a, b in zip(up, down, strict=True)], dtype="float64")


def sign_test(df: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """(by, up, down, sign_p); ties are dropped."""
    out = df.groupBy(*by).agg(F.count_if(F.col(delta) > 0).alias("up"), F.count_if(F.col(delta) < 0).alias("down"))
    return out.withColumn("sign_p", sign_p("up", "down"))


def student_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([student_tail(float(x), float(k) - 1) if x == x and x is not None and k > 1 else None for x, k in zip(t, n, strict=True)], dtype="float64")


def t_test(df: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """(by, n, t, t_p): one-sample t of the mean against 0."""
    t = F.try_divide(F.avg(delta), F.stddev_samp(delta) / F.sqrt(F.count(delta).cast("double")))
    return df.groupBy(*by).agg(F.count(delta).alias("n"), t.alias("t")).withColumn("t_p", student_p("t", "n"))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore").astype("float64")


def wilcoxon(df: DataFrame, delta: str) -> DataFrame:
    """(n, w, z, p): signed ranks of non-zero differences with average ranks, normal approximation; one row.

    Ranks come from counts of each different size, which are ordered by ranges (see order.below).
    """
    from lexmill.operators.order import average_ranks

    n = df.where(F.col(delta) != 0).groupBy(F.abs(delta).alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col(delta) > 0).alias("up"))
    r = average_ranks(n, [], "size", "c")
    c = F.col("c").cast("decimal(38,0)")  # the cube of a count is beyond a long's range
    out = r.agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(c * c * c - c).cast("double").alias("ties"))
    k = F.col("n").cast("double")
    z = F.try_divide(F.col("w") - k * (k + 1) / 4, F.sqrt(k * (k + 1) * (2 * k + 1) / 24 - F.col("ties") / 48))
    return out.select("n", "w", z.alias("z")).withColumn("p", normal_p("z"))


def _at(values: str, q: float) -> Column:
    """The order statistic of a sorted array at a share of its length."""
    return F.element_at(values, F.least((F.floor(F.lit(q) * F.size(values)) + 1).cast("int"), F.size(values)))


def bootstrap_means(df: DataFrame, by: str, cluster: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(by, r, m): the mean of each replicate, clusters drawn with Poisson weights; replicates that draw nothing are left out.

    Rows are summed by cluster first; see resample.replicate_sums for what a replicate costs.
    """
    c = df.groupBy(by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    m = replicate_sums(c, [by], cluster, ["s", "n"], replicates, seed)
    return m.select(by, "r", F.try_divide("s", "n").alias("m")).where("m is not null")


def bootstrap_ci(df: DataFrame, by: str, cluster: str, value: str, replicates: int = 20_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(by, mean, lo, hi): percentile interval of the mean by bootstrap_means(); its ends are order statistics."""
    m = bootstrap_means(df, by, cluster, value, replicates, seed)
    out = m.groupBy(by).agg(F.array_sort(F.collect_list("m")).alias("m"))  # as many numbers as replicates
    mean = df.groupBy(by).agg((F.sum(value) / F.count(value)).alias("mean"))
    a = (1 - level) / 2
    return out.join(mean, by).select(by, "mean", _at("m", a).alias("lo"), _at("m", 1 - a).alias("hi"))


def ranking(df: DataFrame, model: str, cluster: str, value: str, replicates: int = 2_000, seed: int = 0) -> DataFrame:
    """(model, mean, lo, hi, sd, wins): the interval of a model's mean, the spread of its replicates, and the share of replicates in
    which it has the smallest mean (ties to the smallest model)."""
    m = bootstrap_means(df, model, cluster, value, replicates, seed)
    best = m.groupBy("r").agg(F.min(F.struct("m", model)).alias("x")).select(F.col(f"x.{model}").alias(model)).groupBy(model).agg(F.count("*").alias("won"))
    out = m.groupBy(model).agg(F.array_sort(F.collect_list("m")).alias("m"), F.stddev_samp("m").alias("sd"))
    mean = df.groupBy(model).agg((F.sum(value) / F.count(value)).alias("mean"))
    out = out.join(mean, model).join(best, model, "left")
    return out.select(model, "mean", _at("m", 0.025).alias("lo"), _at("m", 0.975).alias("hi"), "sd", (F.coalesce("won", F.lit(0)) / replicates).alias("wins"))


def permutation_p(pairs: DataFrame, families: DataFrame, model: str, family: str, replicates: int, seed: int, plus_one: bool = True) -> DataFrame:
    """(observed, p): mean divergence across minus within families, against families dealt anew; one row.

    A deal orders models by a hash and gives the families out in order. There are replicates x models rows of deals.
    """
    from pyspark.sql import Window

    f = families.select(F.col(model).alias("m"), F.col(family).alias("fam"))
    ranked = f.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m")))
    deals = f.select("m").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    deals = deals.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(F.md5(F.concat_ws("|", F.col("m").cast("string"), F.col("r").cast("string"), F.lit(str(seed))).cast("binary")), "m")))
    deals = deals.join(ranked.select("k", "fam"), "k").select("r", "m", "fam").union(f.select(F.lit(0).alias("r"), "m", "fam"))
    x = pairs.join(deals.select("r", F.col("m").alias("a"), F.col("fam").alias("fa")), "a").join(deals.select("r", F.col("m").alias("b"), F.col("fam").alias("fb")), ["r", "b"])
    g = x.groupBy("r").agg((F.avg(F.when(F.col("fa") != F.col("fb"), F.col("d"))) - F.avg(F.when(F.col("fa") == F.col("fb"), F.col("d")))).alias("gap"))
    observed = F.max(F.when(F.col("r") == 0, F.col("gap")))
    out = g.agg(observed.alias("observed"), F.collect_list(F.when(F.col("r") > 0, F.col("gap"))).alias("null"))
    hits = F.size(F.filter("null", lambda v: v >= F.col("observed")))
    one = 1 if plus_one else 0
    return out.select("observed", ((hits + one) / (F.size("null") + one)).alias("p"))


def matched_null(df: DataFrame, by: str, label: str, guess: str, trials: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, n, observed, null_mean, lo, hi, p): the share of guesses that hit the label, against guesses drawn from the group's own
    label shares: mean and order statistics of the trials, and (trials at least as good + 1) / (trials + 1).

    In a trial every row draws a guess. The draws of rows with one label hit it independently with its share, so that their hits
    are one binomial draw; only counts of labels are drawn for, whatever the number of rows.
    """
    n = df.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("c"), F.count_if(F.col(guess) == F.col(label)).alias("h"))
    t = n.groupBy(F.col(by).alias("__b")).agg(F.sum("c").alias("n"), F.sum("h").alias("h"), F.array_sort(F.collect_list(F.struct(label, "c"))).alias("__c"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shares(groups: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for g, c in zip(groups, counts, strict=True):
            c = np.array(c, np.int64)
            rng = np.random.default_rng([seed, zlib.crc32(str(g).encode())])
            out.append(np.sort(rng.binomial(c, c / c.sum(), (trials, len(c))).sum(1) / c.sum()))
        return pd.Series(out)

    out = t.withColumn("s", shares(F.col("__b").cast("string"), F.transform("__c", lambda x: x["c"]))).withColumn("observed", ratio("h", "n"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.size("s")
    p = (F.size(F.filter("s", lambda v: v >= F.col("observed"))) + 1) / (F.size("s") + 1)
    return out.select(F.col("__b").alias(by), "n", "observed", mean.alias("null_mean"), _at("s", 0.025).alias("lo"), _at("s", 0.975).alias("hi"), p.alias("p"))


def chance_of_hit(df: DataFrame, by: str, label: str) -> DataFrame:
    """(by, n, expected): how often guesses drawn from a group's label shares hit, in closed form: the sum of squared shares."""
    n = df.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("c"))
    t = n.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return t.select(by, "n", (F.col("q") / (F.col("n") * F.col("n"))).alias("expected"))


def _selections(selected: DataFrame, model: str, case: str, feature: str) -> DataFrame:
    """(m, f, c, n): each different selection once, n being 1."""
    return selected.select(F.col(model).alias("m"), F.col(feature).alias("f"), F.col(case).alias("c")).distinct().withColumn("n", F.lit(1.0))


def split_half(selected: DataFrame, model: str, case: str, feature: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(replicates, r, r05, r95, null_r, null_r95), one row: correlations of the divergences that two even halves of the cases give,
    their mean and order statistics, and the same with the second half's models shuffled."""
    from pyspark.sql import Window

    each = Workspace(selected.sparkSession, "halves").write(replicate_sums(_selections(selected, model, case, feature), ["m", "f"], "c", ["n"], replicates, seed, halves=True), "sums")
    every = _selections(selected, model, case, feature).groupBy("m", "f").agg(F.sum("n").alias("total"))
    c = each.join(every, ["m", "f"]).select("r", "m", "f", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("n").alias("n")), F.struct(F.lit(0).alias("side"), (F.col("total") - F.col("n")).alias("n")))).alias("x")).select("r", "x.side", "m", "f", "x.n")
    d = divergences(c, ["r", "side"], "m", "f", "n")
    first, second = d.where("side = 0").select("r", "a", "b", F.col("d").alias("x")), d.where("side = 1").select("r", "a", "b", F.col("d").alias("y"))
    models = c.select("r", "m").distinct()
    rank = F.row_number().over(Window.partitionBy("r").orderBy("m"))  # as many rows as models
    shuffled = F.row_number().over(Window.partitionBy("r").orderBy(F.md5(F.concat_ws("|", F.col("m").cast("string"), F.col("r").cast("string"), F.lit(f"{seed}null")).cast("binary")), "m"))
    to = models.withColumn("i", rank).join(models.select("r", F.col("m").alias("to"), shuffled.alias("i")), ["r", "i"]).select("r", "m", "to")
    dealt = second.join(to.select("r", F.col("m").alias("a"), F.col("to").alias("ta")), ["r", "a"]).join(to.select("r", F.col("m").alias("b"), F.col("to").alias("tb")), ["r", "b"])
    dealt = dealt.select("r", F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), "y")
    corr = lambda y: first.join(y, ["r", "a", "b"]).groupBy("r").agg(F.corr("x", "y").alias("c"))
    both = corr(second).join(corr(dealt).withColumnRenamed("c", "z"), "r", "left")
    out = both.agg(F.count("c").alias("replicates"), F.avg("c").alias("r"), F.array_sort(F.collect_list("c")).alias("c"), F.avg("z").alias("null_r"), F.array_sort(F.collect_list("z")).alias("z"))
    return out.select("replicates", "r", _at("c", 0.05).alias("r05"), _at("c", 0.95).alias("r95"), "null_r", _at("z", 0.95).alias("null_r95"))


def edge_stability(selected: DataFrame, model: str, case: str, feature: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """(model, nearest, stable): a model's nearest neighbour, and the share of bootstrap replicates over cases in which it is the same."""
    x = _selections(selected, model, case, feature)

    def nearest(counts: DataFrame) -> DataFrame:
        d = divergences(counts, ["r"], "m", "f", "n")
        d = d.union(d.select("r", "b", "a", "d"))
        return d.groupBy("r", "a").agg(F.min(F.struct("d", "b")).alias("x")).select("r", F.col("a").alias("m"), F.col("x.b").alias("nearest"))

    seen = nearest(x.groupBy("m", "f").agg(F.sum("n").alias("n")).withColumn("r", F.lit(-1))).select("m", "nearest")
    drawn = Workspace(selected.sparkSession, "edges").write(replicate_sums(x, ["m", "f"], "c", ["n"], replicates, seed), "sums")
    got = nearest(drawn).join(seen.withColumnRenamed("nearest", "own"), "m")
    share = got.groupBy("m").agg(F.avg((F.col("nearest") == F.col("own")).cast("int")).alias("stable"))
    return seen.join(share, "m", "left").select(F.col("m").alias("model"), "nearest", "stable")


def distance_drivers(pairs: DataFrame, values: DataFrame, families: DataFrame, model: str, value: str, family: str, permutations: int = 20_000) -> DataFrame:
    """(intercept, gap, same_family, r2, r2_gap, p): least squares of d on |difference of a value| and same family; one row. p is how
    often families dealt by chance have a coefficient of same_family as low as the observed one (one-sided: kin are nearer).

    All sums that the normal equations need come from one aggregation; 3 x 3 equations are solved on the driver.
    """
    v, f = values.select(model, value), families.select(model, family)
    x = pairs
    for end in ("a", "b"):
        x = x.join(v.select(F.col(model).alias(end), F.col(value).alias(f"v{end}")), end).join(f.select(F.col(model).alias(end), F.col(family).alias(f"f{end}")), end)
    x = x.select("d", F.abs(F.col("va") - F.col("vb")).alias("g"), (F.col("fa") == F.col("fb")).cast("double").alias("s"))
    r = x.agg(*[F.sum(e).alias(k) for k, e in {"n": F.lit(1.0), "g": F.col("g"), "s": F.col("s"), "d": F.col("d"), "gg": F.col("g") ** 2, "ss": F.col("s") ** 2, "gs": F.col("g") * F.col("s"), "gd": F.col("g") * F.col("d"), "sd": F.col("s") * F.col("d"), "dd": F.col("d") ** 2}.items()]).first()

    def fit(cols: list[str]) -> tuple[np.ndarray, float]:
        name = lambda i, j: "".join(sorted((i, j))) if "1" not in (i, j) else ({i, j} - {"1"} or {"n"}).pop()
        get = lambda i, j: r["n"] if i == j == "1" else r[{"gs": "gs", "dg": "gd", "ds": "sd"}.get(name(i, j), name(i, j))]
        m = np.array([[get(i, j) for j in cols] for i in cols])
        y = np.array([get(i, "d") for i in cols])
        b = np.linalg.lstsq(m, y, rcond=None)[0]
        total = r["dd"] - r["d"] ** 2 / r["n"]
        return b, float(1 - (r["dd"] - b @ y) / total) if total else float("nan")

    b, r2 = fit(["1", "g", "s"])
    _, only = fit(["1", "g"])
    p = _family_p(pairs, values, families, model, value, family, permutations)
    return pairs.sparkSession.createDataFrame([(float(b[0]), float(b[1]), float(b[2]), r2, only, p)], "intercept double, gap double, same_family double, r2 double, r2_gap double, p double")


def _family_p(pairs, values, families, model, value, family, permutations: int) -> float | None:
    """(permutations whose coefficient is at most the observed one + 1) / (permutations + 1), when models get families by chance.

    Pairs of models are a bounded matrix (more than MAX_MODELS models are an error). By the theorem of partial regression the
    coefficient is that of what the gap doesn't explain, so a permutation costs two sums over pairs.
    """
    if not permutations:
        return None
    of = dict(families.select(model, family).limit(MAX_MODELS + 1).collect())
    if len(of) > MAX_MODELS:
        raise ValueError("more models than a matrix of pairs is made for")
    rows = pairs.join(values.select(F.col(model).alias("a"), F.col(value).alias("va")), "a").join(values.select(F.col(model).alias("b"), F.col(value).alias("vb")), "b")
    rows = rows.select("a", "b", "d", F.abs(F.col("va") - F.col("vb")).alias("g")).orderBy("a", "b").collect()
    names = sorted({n for r in rows for n in (r["a"], r["b"])})
    at = {n: i for i, n in enumerate(names)}
    a, b = (np.array([at[r[c]] for r in rows]) for c in ("a", "b"))
    d, g = (np.array([r[c] for r in rows], float) for c in ("d", "g"))
    base = np.linalg.qr(np.column_stack([np.ones(len(d)), g]))[0]
    left = d - base @ (base.T @ d)
    kinds = np.unique([str(of[n]) for n in names], return_inverse=True)[1]

    def coefficient(labels: np.ndarray) -> float:
        s = (labels[a] == labels[b]).astype(float)
        s -= base @ (base.T @ s)
        return float(s @ left / (s @ s)) if s @ s > 1e-12 else 0.0

    observed, rng = coefficient(kinds), np.random.default_rng(0)
    hits = sum(coefficient(kinds[rng.permutation(len(kinds))]) <= observed + 1e-12 for _ in range(permutations))
    return (hits + 1) / (permutations + 1)


def mds(pairs: DataFrame, dims: int = 2, squared: bool = True) -> DataFrame:
    """(model, x1, x2, ...): classical scaling of a matrix of distances, or with squared=False of divergences whose square roots are the
    distances. Models are counted first: the matrix is made on the driver."""
    models = [r[0] for r in pairs.select(F.col("a").alias("m")).union(pairs.select("b")).distinct().orderBy("m").limit(MAX_MODELS + 1).collect()]
    if len(models) > MAX_MODELS:
        raise ValueError("more models than a matrix on the driver is made for")
    at = {m: i for i, m in enumerate(models)}
    d = np.zeros((len(models), len(models)))
    for r in pairs.select("a", "b", "d").collect():
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["d"]
    c = np.eye(len(d)) - 1 / max(len(d), 1)
    w, v = np.linalg.eigh(-0.5 * c @ (d**2 if squared else d) @ c)
    order = np.argsort(-w)[:dims]
    x = v[:, order] * np.sqrt(np.maximum(w[order], 0))
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)  # signs are free: the largest entry is positive
    names = ", ".join(f"x{i + 1} double" for i in range(dims))
    return pairs.sparkSession.createDataFrame([(m, *map(float, row)) for m, row in zip(models, x, strict=True)], f"model {pairs.schema['a'].dataType.simpleString()}, {names}")
