"""Evaluation of graded answers: summaries, accuracy, knowledge-free baselines, misses, confusion, dispositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.numbers import ratio


def graded(df: DataFrame, error: str, *scores: str) -> DataFrame:
    """Rows without an error text whose scores are all numbers."""
    ok = F.coalesce(F.trim(F.col(error)), F.lit("")) == ""
    for s in scores:
        ok = ok & F.col(s).cast("string").try_cast("double").isNotNull()
    return df.where(ok)


def means(df: DataFrame, keys: list[str], metrics: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """Means and counts by grouping sets of the keys (each alone and all rows, by default); absent keys are null."""
    sets = sets if sets is not None else [[k] for k in keys] + [[]]
    cols = [[F.col(c) for c in s] for s in sets]
    return df.groupingSets(cols, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics]
    )


def summary(df: DataFrame, by: list[str], score: Column, reasoning: Column, declined: Column, label: Column, claim: Column) -> DataFrame:
    """For each group: rows, mean scores and their gap, share declined, hits among attempts that have a label, extremes."""
    tried = ~declined & label.isNotNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("outcome"),
        F.avg(reasoning).alias("reasoning"),
        (F.avg(score) - F.avg(reasoning)).alias("gap"),
        F.avg(declined.cast("int")).alias("declined"),
        F.count_if(tried).alias("attempted"),
        ratio(F.count_if(tried & (label == claim)), F.count_if(tried)).alias("hit"),
        F.avg((score >= 0.99).cast("int")).alias("full"),
        F.avg((score <= 0.01).cast("int")).alias("none"),
    )


def accuracy(df: DataFrame, condition: str, model: str, attempted: Column, hit: Column) -> DataFrame:
    """A row for each (condition, model) and one POOLED row for each condition; groups without attempts are left out."""
    got = df.select(F.col(condition), F.col(model).cast("string").alias(model), attempted.alias("__t"), hit.alias("__h"))
    out = got.groupingSets([[F.col(condition), F.col(model)], [F.col(condition)]], F.col(condition), F.col(model)).agg(
        F.grouping(model).alias("__g"), F.count("*").alias("n"), F.count_if("__t").alias("attempted"), F.count_if(F.col("__t") & F.col("__h")).alias("hits")
    )
    return out.where("attempted > 0").select(
        condition, F.when(F.col("__g") == 1, "POOLED").otherwise(F.col(model)).alias(model), "n", "attempted", "hits", ratio("hits", "attempted").alias("accuracy")
    )


def baselines(df: DataFrame, by: list[str], label: str, always: str) -> DataFrame:
    """What needs no knowledge: uniform 1/k, prior-matched sum of squares, the commonest label (ties to the smaller), a fixed one."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("c"))
    p = n.withColumn("p", ratio("c", F.sum("c").over(Window.partitionBy(*by))))
    out = p.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("p") * F.col("p")).alias("matched"),
        F.max("p").alias("mode_share"),
        F.min(F.struct((-F.col("c")).alias("c"), F.col(label).alias("v"))).getField("v").alias("mode"),
        F.coalesce(F.max(F.when(F.col(label) == always, F.col("p"))), F.lit(0.0)).alias("always"),
    )
    out = out.withColumn("uniform", 1 / F.col("k"))
    return out.withColumn("strongest", F.greatest("uniform", "matched", "mode_share", "always"))


def misses(df: DataFrame, case: str, score: str, label: str, declined: Column, most: float) -> DataFrame:
    """Cases by how many answers missed: (case, misses, mean over all graded, missed labels sorted and joined), worst first."""
    miss = (F.col(score) <= most) & ~declined
    out = df.groupBy(case).agg(
        F.count_if(miss).alias("misses"),
        F.avg(score).alias("mean_score"),
        F.array_join(F.array_sort(F.collect_list(F.when(miss, F.col(label)))), ",").alias("labels"),
    )
    return out.where("misses > 0").orderBy(F.desc("misses"), "mean_score", case)


def confusion(df: DataFrame, truth: str, claim: str) -> DataFrame:
    """(truth, claim, n, share of the truth's rows); pairs that never occur have no row."""
    n = df.where(F.col(truth).isNotNull() & F.col(claim).isNotNull()).groupBy(truth, claim).agg(F.count("*").alias("n"))
    return n.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy(truth))))


def hit_rates(df: DataFrame, model: str, truth: str, declined: Column, hit: Column, thin: int = 5) -> DataFrame:
    """(model, truth, n, attempted, hits, rate, note): thin below `thin` attempts, declined where there was none."""
    out = df.groupBy(model, truth).agg(F.count("*").alias("n"), F.count_if(~declined).alias("attempted"), F.count_if(~declined & hit).alias("hits"))
    note = F.when(F.col("attempted") == 0, F.concat(F.lit("declined all "), F.col("n").cast("string"))).when(F.col("attempted") < thin, "thin").otherwise("")
    return out.select(model, truth, "n", "attempted", "hits", ratio("hits", "attempted").alias("rate"), note.alias("note"))


def shares(df: DataFrame, by: list[str], category: str, values: Sequence[str]) -> DataFrame:
    """The share of each given category in each group, in per cent."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[(F.avg(F.when(F.col(category) == v, 1.0).otherwise(0.0)) * 100).alias(f"pct_{v}") for v in values])


def conditional_means(df: DataFrame, by: str, score: str, attempt: Column) -> DataFrame:
    """The mean over attempts, and over all rows with others counted as 0."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(attempt).alias("attempts"), F.avg(F.when(attempt, F.col(score))).alias("conditional"), F.avg(F.when(attempt, F.col(score)).otherwise(0.0)).alias("unconditional")
    )


def histogram(df: DataFrame, by: str, value: str, edges: Sequence[float]) -> DataFrame:
    """(by, bin, n, share): bin i holds edges[i] <= value < edges[i + 1], the last one all above; lower values are left out."""
    b = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        b = F.when(F.col(value) >= e, i).otherwise(b)
    n = df.select(F.col(by), b.alias("bin")).where("bin is not null").groupBy(by, "bin").agg(F.count("*").alias("n"))
    return n.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy(by))))


def cluster_means(df: DataFrame, group: str, cluster: str, score: str) -> DataFrame:
    """(group, clusters, mean of the clusters' means), so that large clusters don't weigh more."""
    per = df.groupBy(group, cluster).agg(F.avg(score).alias("m"))
    return per.groupBy(group).agg(F.count("*").alias("clusters"), F.avg("m").alias("mean_of_means"))


def threshold_curve(df: DataFrame, by: str, log_p: str, most: int = 12) -> DataFrame:
    """(by, e, n, pct): the share of rows with a probability of at least 10^-e, for e from 1 to `most`."""
    e = F.explode(F.sequence(F.lit(1), F.lit(most)))
    got = df.groupBy(by).agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col(log_p) >= F.lit(-k) * F.log(F.lit(10.0))) for k in range(1, most + 1)]).alias("c"))
    return got.select(by, "n", "c", e.alias("e")).select(by, "e", "n", (ratio(F.element_at("c", F.col("e")), F.col("n")) * 100).alias("pct"))


def extremes_vs_mean(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Each item's share in its group minus the item's mean share over groups, in points."""
    n = df.groupBy(group, item).agg(F.sum(value).alias("s"))
    n = n.withColumn("share", ratio("s", F.sum("s").over(Window.partitionBy(group))))
    return n.select(group, item, "share", ((F.col("share") - F.avg("share").over(Window.partitionBy(item))) * 100).alias("tilt"))
