"""Predicates, projections and look-ups on evaluation records: what counts, what is left out and why."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.numbers import ratio

# Tiers that recall statistics admit, and the question that states its own answer.
SCORED_TIERS, SELF_ANSWERING = ("D",), ("Q03",)
#: Verdicts of a case that is the right one.
VERIFIED = ("exact", "match", "fetched_by_id")


def blank(c: Column) -> Column:
    """Null or nothing but blanks."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def eligible(tier: Column, qid: Column) -> Column:
    """Questions that a recall statistic admits; a missing tier counts as scored."""
    return F.coalesce(tier, F.lit(SCORED_TIERS[0])).isin(*SCORED_TIERS) & ~F.coalesce(qid, F.lit("")).isin(*SELF_ANSWERING)


def scoring_pairs(qa: DataFrame, qids: Sequence[str] | None = None) -> DataFrame:
    """(case_id, qid, work, prefix, suffix) of the rows whose answer was found, that are eligible and have both texts.

    work is the case id up to its last "_ch", the whole id where it has none.
    """
    keep = (F.col("found") == "1") & eligible(F.col("tier"), F.col("qid"))
    keep = keep & F.col("qid").isin(*qids) if qids else keep
    prefix, suffix = F.trim("prompt"), F.trim("answer")
    stem = F.regexp_extract("case_id", "^(.*)_ch", 1)
    work = F.when(F.col("case_id").contains("_ch"), stem).otherwise(F.col("case_id"))
    return qa.where(keep & ~blank(F.col("prompt")) & ~blank(F.col("answer"))).select("case_id", "qid", work.alias("work"), prefix.alias("prefix"), suffix.alias("suffix"))


def attempts(df: DataFrame) -> DataFrame:
    """Eligible rows that are attempts: by the taxonomy's column where there is one, else those not flagged as unknown, refused or errored."""
    rows = df.where(eligible(F.col("tier"), F.col("qid")))
    if "nonanswer" in df.columns:
        return rows.where(F.col("nonanswer") == "attempt")
    flags = [c for c in ("unknown", "refusal", "errored") if c in df.columns]
    return rows.where(reduce(lambda a, c: a & (F.coalesce(F.col(c).cast("int"), F.lit(0)) == 0), flags, F.lit(True)))


def matching(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows that equal all the given values."""
    return df.where(reduce(lambda a, kv: a & (F.col(kv[0]) == F.lit(kv[1])), wanted.items(), F.lit(True)))


def without_bad_matches(rows: DataFrame, matches: DataFrame, key: str, verdict: str) -> DataFrame:
    """Rows of the cases that no match calls wrong; cases without a match stay."""
    bad = matches.where(F.col(verdict).isNotNull() & ~F.col(verdict).isin(*VERIFIED)).select(key).distinct()
    return rows.join(bad, key, "left_anti")


def generation_state(df: DataFrame, dataset: str, model: str, known: DataFrame, excluded: Sequence[str], wanted: Column | None = None) -> DataFrame:
    """df with state: kept, excluded_model, unknown_dataset or unwanted, so that what is left out can be reported."""
    k = known.select(F.col(dataset).alias("__d"), F.lit(True).alias("__k")).distinct()
    state = F.when(F.col(model).isin(*excluded), "excluded_model").when(F.col("__k").isNull(), "unknown_dataset")
    state = state.when(~F.coalesce(wanted, F.lit(False)), "unwanted") if wanted is not None else state
    return df.join(k, F.col(dataset) == F.col("__d"), "left").withColumn("state", state.otherwise("kept")).drop("__d", "__k")


def drop_class(df: DataFrame, label: str, gone: str) -> tuple[DataFrame, DataFrame]:
    """(rows without a class, one row of what that did: before, after, no_op), whatever the label's case and margins."""
    other = ~F.coalesce(F.lower(F.trim(label)) == gone, F.lit(False))
    told = df.agg(F.count("*").alias("before"), F.count_if(other).alias("after")).withColumn("no_op", F.col("before") == F.col("after"))
    return df.where(other), told


def flat_summary(df: DataFrame, keys: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Nested values as flat columns: name -> path; a path through a null is null."""
    return df.select(*keys, *[F.col(path).alias(name) for name, path in fields.items()])


def text_leaves(value: Column, kind: T.DataType) -> Column:
    """All strings of a nested value in order, as an array without nulls; map values follow their keys' order."""
    return F.filter(_leaves(value, kind), lambda x: x.isNotNull())


def _leaves(v: Column, kind: T.DataType) -> Column:
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array(v)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(v, lambda x: _leaves(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        items = F.transform(F.array_sort(F.map_entries(v)), lambda e: e["value"])
        return F.coalesce(F.flatten(F.transform(items, lambda x: _leaves(x, kind.valueType))), none)
    if isinstance(kind, T.StructType):
        parts = [_leaves(v[f.name], f.dataType) for f in kind.fields]
        return F.coalesce(F.concat(*parts), none) if parts else none
    return none


def map_strings(value: Column, kind: T.DataType, f) -> Column:
    """The nested value with f applied to every string in it."""
    if isinstance(kind, T.StringType):
        return f(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: map_strings(x, kind.elementType, f))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: map_strings(x, kind.valueType, f))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[map_strings(value[x.name], x.dataType, f).alias(x.name) for x in kind.fields]))
    return value


def unique_match(needles: DataFrame, needle: str, names: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """(needle, hits, match, problem): the only name that contains a needle, whatever the case; `none` or `several` where there isn't
    just one. names is a short list, which is checked, as every needle is held against all of them."""
    if names.limit(most + 1).count() > most:
        raise ValueError("more names than needles can be held against")
    x = needles.select(needle).distinct().join(F.broadcast(names.select(F.col(name).alias("__n")).distinct()), F.contains(F.lower("__n"), F.lower(needle)), "left")
    g = x.groupBy(needle).agg(F.count("__n").alias("hits"), F.min("__n").alias("__m"))
    return g.select(needle, "hits", F.when(F.col("hits") == 1, F.col("__m")).alias("match"), F.when(F.col("hits") == 0, "none").when(F.col("hits") > 1, "several").alias("problem"))


def single_model(df: DataFrame, model: str) -> DataFrame:
    """df, with an error in every row if it holds more than one model."""
    n = df.agg(F.count_distinct(model).alias("__models"))
    ok = F.when(F.col("__models") > 1, F.raise_error(F.lit("more than one model"))).otherwise(F.lit(True))
    return df.join(F.broadcast(n)).where(ok).drop("__models")


def moved_labels(new: DataFrame, base: DataFrame, keys: Sequence[str], label: str, declined: Column) -> DataFrame:
    """(keys, old, new) of the rows whose label differs from the baseline's, nulls included; declined rows don't count."""
    b = base.select(*keys, F.col(label).alias("old"))
    n = new.where(~F.coalesce(declined, F.lit(False))).select(*keys, F.col(label).alias("new"))
    return n.join(b, list(keys)).where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "old", "new")


def first_filled(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, value): each key's first value in order that isn't blank."""
    x = df.where(~blank(F.col(value)))
    return x.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def contrast(df: DataFrame, case: str, model: str, value: str, first, second) -> DataFrame:
    """(case, a, b, gap) summed values of two models in the cases where either has some; a row's missing value counts as 0."""
    v = F.coalesce(F.col(value), F.lit(0))
    s = lambda m: F.sum(F.when(F.col(model) == m, v).otherwise(0))
    x = df.where(F.col(model).isin(first, second)).groupBy(case).agg(s(first).alias("a"), s(second).alias("b"))
    return x.where("a <> 0 or b <> 0").withColumn("gap", F.abs(F.col("a") - F.col("b")))


def when_named(df: DataFrame, case: str, model: str, value: str) -> DataFrame:
    """(model, cases, mean): in how many cases a model names something, and its mean total there."""
    x = df.groupBy(case, model).agg(F.sum(value).alias("s")).where("s <> 0")
    return x.groupBy(model).agg(F.count("*").alias("cases"), F.avg("s").alias("mean"))


def identity(items: DataFrame, candidates: DataFrame, key: str, text: str, cand_key: str, cand_text: str, scores: DataFrame, least: float = 0.5) -> DataFrame:
    """(key, cand_key, method, score): the candidate with the same SHA-1 (smallest id of several), else the one with the best score of
    at least `least` (ties to the smallest id); items without either are left out. scores: (key, cand_key, share)."""
    i = items.select(key, F.sha1(F.col(text).cast("binary")).alias("__h"))
    c = candidates.groupBy(F.sha1(F.col(cand_text).cast("binary")).alias("__h")).agg(F.min(cand_key).alias(cand_key))
    exact = i.join(c, "__h").select(key, cand_key, F.lit("sha1").alias("method"), F.lit(1.0).alias("score"))
    rest = scores.where(F.col("share") >= least).join(exact.select(key), key, "left_anti")
    best = rest.groupBy(key).agg(F.min(F.struct((-F.col("share")).alias("s"), F.col(cand_key).alias("c"))).alias("m"))
    return exact.unionByName(best.select(key, F.col("m.c").alias(cand_key), F.lit("text_overlap").alias("method"), (-F.col("m.s")).alias("score")))


def case_date(fetched: Column, year: Column) -> tuple[Column, Column]:
    """(date, source): the fetched date, else the middle of the year where that is one, else nothing."""
    y = F.when(year.rlike("^[0-9]{4}$"), F.concat(year, F.lit("-07-01")).try_cast("date"))
    return F.coalesce(fetched.cast("date"), y), F.when(fetched.isNotNull(), "fetched").when(y.isNotNull(), "year").otherwise("unknown")


def judge_aggregate(df: DataFrame, keys: Sequence[str], numbers: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """(keys, n, a mean for each column): rows without a value don't count for it, flags count as 0 and 1."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in numbers], *[F.avg(F.col(c).cast("int")).alias(c) for c in flags])


def presence_rates(df: DataFrame, model: str, case: str, criterion: str, present: Column) -> DataFrame:
    """(model, criterion, rate): the share of a model's cases that meet a criterion, of the cases that were scored for it."""
    x = df.groupBy(model, criterion, case).agg(F.max(present.cast("int")).alias("p"))
    return x.groupBy(model, criterion).agg(F.avg("p").alias("rate"))


def importance(df: DataFrame, model: str, case: str, feature: str, weight: str) -> DataFrame:
    """(model, mass, named, verbosity): summed weights, how many selections have a positive one, and mean different features in the
    cases where a model names any."""
    per = df.groupBy(model, case).agg(F.sum(weight).alias("m"), F.count_if(F.col(weight) > 0).alias("k"), F.count_distinct(F.when(F.col(weight) > 0, F.col(feature))).alias("f"))
    return per.groupBy(model).agg(F.sum("m").alias("mass"), F.sum("k").alias("named"), F.avg(F.when(F.col("f") > 0, F.col("f"))).alias("verbosity"))


def binomial_check(df: DataFrame, p: str, hits: str, samples: str) -> DataFrame:
    """df with empirical, tolerance (four standard errors and 0.01), powered (p is beyond it) and ok (within it, and powered)."""
    n, pr = F.col(samples).cast("double"), F.col(p)
    tol = 4 * F.sqrt(F.greatest(pr * (1 - pr), F.lit(1e-12)) / n) + 0.01
    emp = ratio(F.col(hits), n)
    out = df.withColumn("empirical", emp).withColumn("tolerance", tol).withColumn("powered", pr > F.col("tolerance"))
    return out.withColumn("ok", (F.abs(F.col("empirical") - pr) <= F.col("tolerance")) & F.col("powered"))


def emit_spans(df: DataFrame, text: str, start: str, end: str, prefix_words: int = 50, least_share: float = 0.6, least_words: int = 8) -> DataFrame:
    """df with prompt (the last prefix_words words before a span) and answer (the span), without spans too near the text's beginning
    or too short."""
    from lexmill.functions.text import last_words, squeeze

    prompt = last_words(F.substring(F.col(text), F.lit(1), F.col(start)), prefix_words)
    answer = squeeze(F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)))
    words = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))
    out = df.withColumn("prompt", prompt).withColumn("answer", answer)
    return out.where((words(F.col("prompt")) >= prefix_words * least_share) & (words(F.col("answer")) >= least_words))


def length_batches(df: DataFrame, key: str, length: Column, size: int) -> DataFrame:
    """df with batch: rows of like length together. Batches are made within powers of two of the length, by a hash, so that no order
    over all rows is needed; on average they hold `size` rows."""
    rung = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    n = df.groupBy(rung.alias("rung")).agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("__n"))  # a row for each power of two
    x = df.withColumn("rung", rung).join(F.broadcast(n), "rung")
    return x.withColumn("batch", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.col("__n"))).drop("__n")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Records of different kinds in one table; what a kind lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def crosstab_by_total(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """(rows, a count for each value, total), to be put in order of the total."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(f"n_{v}") for v in values], F.count_if(F.col(columns).isin(*values)).alias("total"))
