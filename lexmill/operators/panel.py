"""Judge panels and model profiles: agreement, Krippendorff's alpha, coverage, divergence, nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.numbers import ratio
from lexmill.operators.order import average_ranks, percentiles
from lexmill.operators.relational import nearest


def krippendorff_alpha(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """Interval alpha over units with at least two ratings, in closed form: one row (units, ratings, alpha).

    Observed disagreement: mean over ratings of 2 (n q - s^2) / (n - 1) by unit; expected: 2 (N Q - S^2) / (N (N - 1)).
    Null where nothing varies. Missing ratings are null or absent.
    """
    x = F.col(value).cast("double")
    u = ratings.where(x.isNotNull()).groupBy(unit).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("n > 1")
    a = u.agg(
        F.count("*").alias("units"), F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") - 1)).alias("o")
    )
    n, s, q = F.col("N"), F.col("S"), F.col("Q")
    expected = ratio(2 * (n * q - s * s), n * (n - 1))
    return a.select("units", n.alias("ratings"), (1 - F.try_divide(F.col("o") / n, expected)).alias("alpha"))


def judge_pairs(ratings: DataFrame, unit: str, judge: str, value: str) -> DataFrame:
    """(unit, a, b, x, y): two judges' values of the same unit, a < b. A judge's values of a unit are averaged first."""
    r = ratings.groupBy(unit, judge).agg(F.avg(value).alias("v"))
    left, right = r.select(unit, F.col(judge).alias("a"), F.col("v").alias("x")), r.select(unit, F.col(judge).alias("b"), F.col("v").alias("y"))
    return left.join(right, unit).where("a < b")


def pair_agreement(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n, pearson, spearman, mean_diff, mad) for pairs of judges with at least so many common units.

    Spearman is the correlation of average ranks within the pair's common units. Pairs are counted by (a, b, x, y) first, so that
    what goes on has a row for each different pair of values, not for each unit.
    """
    c = pairs.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    for v in ("x", "y"):
        ranks = average_ranks(c.groupBy("a", "b", v).agg(F.sum("n").alias("__n")), ["a", "b"], v, "__n")
        c = c.join(ranks.select("a", "b", v, F.col("rank").alias(f"r{v}")), ["a", "b", v])
    n = F.sum("n")

    def corr(x: str, y: str) -> Column:
        x, y = F.col(x), F.col(y)
        s = lambda e: F.sum(F.col("n") * e)
        return F.try_divide(n * s(x * y) - s(x) * s(y), F.sqrt((n * s(x * x) - s(x) * s(x)) * (n * s(y * y) - s(y) * s(y))))

    mean = lambda e: F.sum(F.col("n") * e) / n
    out = c.groupBy("a", "b").agg(
        n.alias("n"), corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"), mean(F.col("x") - F.col("y")).alias("mean_diff"), mean(F.abs(F.col("x") - F.col("y"))).alias("mad")
    )
    return out.where(F.col("n") >= least)


def anchor_agreement(pairs: DataFrame, levels: Sequence[float]) -> DataFrame:
    """(a, b, n, exact, adjacent): shares of units on the same level, and at most one level apart; other values count as neither."""
    at = lambda v: F.array_position(F.array(*[F.lit(float(x)) for x in levels]), v.cast("double"))
    i, j = at(F.col("x")), at(F.col("y"))
    on = (i > 0) & (j > 0)
    return pairs.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("int")).alias("exact"), F.avg((on & (F.abs(i - j) <= 1)).cast("int")).alias("adjacent")
    )


def judge_usage(ratings: DataFrame, judge: str, value: str) -> DataFrame:
    """(judge, n, mean, sd, median, at_max): at_max is the share of a judge's ratings at its own maximum, of all its rows.

    The median is an exact percentile by ranges, so a judge may have any number of different values. Null judges are one.
    """
    v = F.col(value).cast("double")
    plain = ratings.groupBy(judge).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count("*").alias("__all"))
    middle = percentiles(ratings, [judge], value, [0.5]).select(F.col(judge).alias("__judge"), F.col("p0").alias("median"), "largest")
    out = plain.join(middle, F.col(judge).eqNullSafe(F.col("__judge")), "left")
    return out.select(judge, "n", "mean", "sd", "median", F.try_divide(F.col("largest").cast("double"), F.when(F.col("n") > 0, F.col("__all"))).alias("at_max"))


def spread(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, n, spread) = largest minus smallest rating."""
    return ratings.groupBy(unit).agg(F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("spread"))


def coverage(named: DataFrame, sizes: DataFrame, case: str, model: str, index: str) -> DataFrame:
    """(case, model, found, total, coverage): distinct indices that a model names, of those the case has; null indices count 0."""
    found = named.groupBy(case, model).agg(F.countDistinct(index).alias("found"))
    return found.join(sizes.select(case, "total"), case).select(case, model, "found", "total", ratio("found", "total").alias("coverage"))


def consensus_misses(named: DataFrame, case: str, model: str, slot: str, gold, support: float) -> DataFrame:
    """(case, misses, slots): slots that at least support x models name but the gold answer doesn't; cases without gold are left out."""
    has_gold = named.where(F.col(model) == gold).select(case).distinct()
    models = named.where(F.col(model) != gold).agg(F.countDistinct(model).alias("__m"))
    by = named.where(F.col(model) != gold).groupBy(case, slot).agg(F.countDistinct(model).alias("k"))
    by = by.join(F.broadcast(models), F.col("k") >= support * F.col("__m"))
    missed = by.join(named.where(F.col(model) == gold).select(case, slot).distinct(), [case, slot], "left_anti").join(has_gold, case, "left_semi")
    text = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col(slot).cast("string").alias("s")))), lambda x: F.concat(F.lit("["), (-x["k"]).cast("string"), F.lit("] "), x["s"]))
    return missed.groupBy(case).agg(F.count("*").alias("misses"), F.array_join(text, "; ").alias("slots"))


def profiles(selected: DataFrame, model: str, feature: str, case: str) -> DataFrame:
    """(model, feature, p): shares of a model's distinct (case, feature) selections."""
    n = selected.select(model, feature, case).distinct().groupBy(model, feature).agg(F.count("*").alias("c"))
    return n.select(model, feature, ratio("c", F.sum("c").over(Window.partitionBy(model))).alias("p"))


#: Models of a pairwise matrix: their list goes to every task.
MOST_MODELS = 2_000


def jsd(profile: DataFrame, model: str, feature: str) -> DataFrame:
    """(a, b, d): Jensen-Shannon divergence in bits of each pair of models, a < b; 1 where two have no feature in common.

    Features that only one of two has add p / 2 each: d = 1 - (shared mass) / 2 + what shared features add. Pairs come from the list
    of models, which is counted.
    """
    models = profile.select(model).distinct()
    if models.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError("more models than a matrix of pairs is made for")
    every = models.select(F.col(model).alias("a")).join(F.broadcast(models.select(F.col(model).alias("b"))), F.col("a") < F.col("b"))
    l, r = profile.select(F.col(model).alias("a"), feature, F.col("p")), profile.select(F.col(model).alias("b"), feature, F.col("p").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    shared = l.join(r, feature).where("a < b").groupBy("a", "b").agg(
        F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum(F.col("p") * F.log2(F.col("p") / m) / 2 + F.col("q") * F.log2(F.col("q") / m) / 2).alias("k")
    )
    d = F.col("k") + (1 - F.col("sp")) / 2 + (1 - F.col("sq")) / 2
    return every.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce(d, F.lit(1.0)).alias("d"))


def family_ratio(pairs: DataFrame, families: DataFrame, model: str, family: str) -> DataFrame:
    """(within, across, ratio): mean divergence within and across families, one row."""
    f = families.select(model, family)
    x = pairs.join(f.select(F.col(model).alias("a"), F.col(family).alias("fa")), "a").join(f.select(F.col(model).alias("b"), F.col(family).alias("fb")), "b")
    return x.agg(F.avg(F.when(F.col("fa") == F.col("fb"), F.col("d"))).alias("within"), F.avg(F.when(F.col("fa") != F.col("fb"), F.col("d"))).alias("across")).withColumn("ratio", F.try_divide("within", "across"))


def family_recovery(pairs: DataFrame, families: DataFrame, model: str, family: str) -> DataFrame:
    """(n, hits, chance): how often a model's nearest neighbour is of its family, and how often a random one would be, among the models
    that have pairs."""
    f = families.select(model, family)
    x = nearest(pairs).join(f.select(F.col(model).alias("a"), F.col(family).alias("fa")), "a").join(f.select(F.col(model).alias("nearest"), F.col(family).alias("fb")), "nearest")
    by = x.groupBy("fa").agg(F.count("*").alias("nf"), F.count_if(F.col("fa") == F.col("fb")).alias("hits"))
    n = F.sum("nf")
    return by.agg(n.alias("n"), F.sum("hits").alias("hits"), F.try_divide((F.sum(F.col("nf") * (F.col("nf") - 1))).cast("double"), (n * (n - 1)).cast("double")).alias("chance"))
