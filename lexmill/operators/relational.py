"""Joins, resume, de-duplication, set and window operators over keyed records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import Workspace


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the given order. The order's columns must tell rows of a key apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def todo(items: DataFrame, done: DataFrame, keys: Sequence[str], failed: Column | None = None) -> DataFrame:
    """Items whose keys aren't done yet; failed rows of done don't count as done."""
    finished = done.where(~F.coalesce(failed, F.lit(False))) if failed is not None else done
    return items.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def overwrite(df: DataFrame, truth: DataFrame, key: str, column: str, new: str) -> DataFrame:
    """df with `column` taken from truth's `new` where truth has the key, and what happened: changed, same or unmatched."""
    t = truth.select(F.col(key), F.col(new).alias("__new"), F.lit(True).alias("__there"))
    out = df.join(t, key, "left")
    state = F.when(F.col("__there").isNull(), "unmatched").when(F.col("__new").eqNullSafe(F.col(column)), "same").otherwise("changed")
    return out.withColumn("state", state).withColumn(column, F.coalesce("__new", column)).drop("__new", "__there")


def paired(df: DataFrame, keys: Sequence[str], arm: str, value: str, first, second) -> DataFrame:
    """(keys, a, b, delta) of keys that have both arms; values of a key and arm are averaged first."""
    a, b = (F.avg(F.when(F.col(arm) == v, F.col(value))) for v in (first, second))
    return df.where(F.col(arm).isin(first, second)).groupBy(*keys).agg(a.alias("a"), b.alias("b")).where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


def delta_summary(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, sd, t, up, down) of a delta column; t is null where sd is."""
    sd = F.stddev_samp("delta")
    t = F.try_divide(F.avg("delta"), sd / F.sqrt(F.count("*").cast("double")))
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), sd.alias("sd"), t.alias("t"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"))


def complete_cases(df: DataFrame, case: str, model: str) -> DataFrame:
    """Rows of the cases that have every model which occurs anywhere (relational division)."""
    every = df.agg(F.countDistinct(model).alias("__all"))
    full = df.groupBy(case).agg(F.countDistinct(model).alias("__n")).join(F.broadcast(every), F.col("__n") == F.col("__all")).select(case)
    return df.join(full, case, "left_semi")


def both_arms(df: DataFrame, key: str, arm: str, first, second) -> DataFrame:
    """Rows of the keys that occur in both arms."""
    keys = df.where(F.col(arm) == first).select(key).intersect(df.where(F.col(arm) == second).select(key))
    return df.where(F.col(arm).isin(first, second)).join(keys, key, "left_semi")


def nearest(distances: DataFrame) -> DataFrame:
    """(a, nearest, d) from unordered pairs (a, b, d): each end's closest partner, ties to the smaller one."""
    both = distances.select("a", "b", "d").union(distances.select("b", "a", "d"))
    best = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"))
    return best.select("a", F.col("m.b").alias("nearest"), F.col("m.d").alias("d"))


class By(NamedTuple):
    """What rows are ordered by: a column, whether it falls, and where nulls go (by default first, or last if it falls)."""

    column: str | Column
    falling: bool = False
    nulls_last: bool | None = None

    def of(self, c: str) -> Column:
        """The order of a column of that name."""
        last = self.falling if self.nulls_last is None else self.nulls_last
        if self.falling:
            return F.desc_nulls_last(c) if last else F.desc_nulls_first(c)
        return F.asc_nulls_last(c) if last else F.asc_nulls_first(c)


def place_in_group(df: DataFrame, group: str | None, order: Sequence[str | By], out: str) -> DataFrame:
    """Adds out: a row's place in its group, from 0, in an order that tells the group's rows apart; without a group, among all rows.

    A window over a group would put it into one task. Instead rows are dealt by ranges of group and order, and written with their
    place in their partition; where a group's rows of a partition begin follows from a table with a row for each (partition, group).
    Null groups are a group of their own. Of rows that the order doesn't tell apart any may come first.
    """
    ws = Workspace(df.sparkSession, "places")
    by = [By(c) if isinstance(c, str) else c for c in order]
    keys = [f"__o{i}" for i in range(len(by))]
    x = df.withColumns({k: F.col(c.column) if isinstance(c.column, str) else c.column for k, c in zip(keys, by, strict=True)})
    x = x.withColumn("__g", F.col(group) if group else F.lit(0))
    ways = [F.col("__g"), *[c.of(k) for k, c in zip(keys, by, strict=True)]]
    x = x.repartitionByRange(*ways).sortWithinPartitions(*ways).drop(*keys)
    row = F.monotonically_increasing_id()
    x = ws.write(x.withColumn("__part", F.shiftright(row, 33)).withColumn("__at", row.bitwiseAND((1 << 33) - 1)), "placed")
    parts = x.groupBy("__g", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("__g").alias("__h"), F.col("__part").alias("__p"), (before - F.col("__first")).alias("__base"))
    x = x.join(parts, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__p")))
    return x.withColumn(out, F.col("__at") + F.col("__base")).drop("__part", "__at", "__g", "__h", "__p", "__base")


def collision_suffix(df: DataFrame, name: str, order: str, out: str = "uid") -> DataFrame:
    """A unique name: the name itself, or name__k in order where several rows have it. A null name stays null.

    Names are counted first; only rows whose name comes again are numbered, by place_in_group, so that a name that very many
    rows have is dealt over many tasks.
    """
    ws = Workspace(df.sparkSession, "names")
    again = ws.write(df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).count().where("count > 1").select("__name"), "again")
    once = df.join(again, F.col(name) == F.col("__name"), "left_anti").withColumn(out, F.col(name))
    many = place_in_group(df.join(again, F.col(name) == F.col("__name"), "left_semi"), name, [order], "__k")
    return once.unionByName(many.withColumn(out, F.concat_ws("__", F.col(name), (F.col("__k") + 1).cast("string"))).drop("__k"))


def grow_vocabulary(df: DataFrame, value: str, order: Sequence[str | By], known: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, vocabulary): df with entry and place of each value in a vocabulary that grows as rows come in order.

    A value that is a whole number means the entry of that place, if there is one when its row comes; other texts, trimmed, are
    entries, new ones being added at the end; null and blank values, and numbers out of range, have neither entry nor place.
    `known` are the entries at the start. vocabulary has (place, entry, first), first being the row that added it, -1 for known.

    When an entry is added depends on texts alone, so nothing is resolved row by row: texts are reduced to their first rows,
    which are numbered by ranges, and a number finds its entry if that was added by a row before its own.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "vocabulary")
    text = F.trim(F.col(value))
    number = text.rlike(r"^-*[0-9]+$")
    x = place_in_group(df, None, order, "__n")
    index = F.when(number, F.coalesce(F.expr(f"try_cast(trim(`{value}`) as bigint)"), F.lit(-1)))
    x = ws.write(x.withColumn("__i", index).withColumn("__t", F.when(~number & (text != ""), text)), "rows")
    start = [(i, e, -1) for i, e in enumerate(dict.fromkeys(known))]
    old = spark.createDataFrame(start, "place bigint, entry string, first bigint")
    new = x.where("__t is not null").groupBy(F.col("__t").alias("entry")).agg(F.min("__n").alias("first")).join(F.broadcast(old.select("entry")), "entry", "left_anti")
    new = place_in_group(new, None, ["first"], "__k").select((F.col("__k") + len(start)).alias("place"), "entry", "first")
    every = ws.write(old.union(new), "entries")
    by_text = x.where("__t is not null").join(every.select(F.col("entry").alias("__t"), "entry", "place"), "__t", "left")
    there = every.select(F.col("place").alias("__p"), "entry", "place", "first")
    by_index = x.where("__i is not null").join(there, (F.col("__i") == F.col("__p")) & (F.col("first") < F.col("__n")), "left")
    none = x.where("__t is null and __i is null").withColumns({"entry": F.lit(None).cast("string"), "place": F.lit(None).cast("bigint")})
    cols = [*df.columns, "entry", "place"]
    return by_text.select(cols).union(by_index.select(cols)).union(none.select(cols)), every


def round_robin(df: DataFrame, bucket: str, order: Sequence[str | By], turn: int = 1) -> DataFrame:
    """`turn` rows of each bucket in rotation: adds round and slot, from 0, in the interleaved order (bucket by bucket name)."""
    out = place_in_group(df, bucket, order, "__rn").withColumn("round", F.floor(F.col("__rn") / turn).cast("long"))
    return out.withColumn("slot", F.pmod("__rn", F.lit(turn)).cast("long")).drop("__rn")


def half_year(date: Column) -> Column:
    """2024H1, 2024H2, ..."""
    return F.concat(F.year(date).cast("string"), F.when(F.month(date) <= 6, "H1").otherwise("H2"))


def half_year_windows(df: DataFrame, start: str, end: str) -> DataFrame:
    """The half-years that [start, end] touches, cut to it: (…, lo, hi), a row each."""
    first = F.make_date(F.year(start), F.when(F.month(start) <= 6, 1).otherwise(7), F.lit(1))
    out = df.withColumn("__h", F.explode(F.sequence(first, F.col(end).cast("date"), F.expr("interval 6 months"))))
    return out.select(*df.columns, F.greatest("__h", F.col(start).cast("date")).alias("lo"), F.least(F.date_sub(F.add_months("__h", 6), 1), F.col(end).cast("date")).alias("hi"))


def arm_of(date: Column, cutoff: Column) -> Column:
    """pre up to a model's cutoff, post after it, unknown without a date."""
    return F.when(date.isNull() | cutoff.isNull(), "unknown").when(date <= cutoff, "pre").otherwise("post")


def common_arm(date: Column, cutoffs: Sequence[str]) -> Column:
    """pre if not after the earliest cutoff, post if after the latest, else null: what all models agree on."""
    d = date.cast("date")
    return F.when(d <= F.lit(min(cutoffs)).cast("date"), "pre").when(d > F.lit(max(cutoffs)).cast("date"), "post")


#: Rows that a task settles one after the other.
MOST_TOGETHER = 200_000


def three_layer_dedup(new: DataFrame, old: DataFrame, keys: Sequence[str], order: Sequence[str] = (), together: int = MOST_TOGETHER) -> DataFrame:
    """Rows of new that share none of the keys with old; null keys share nothing.

    With an order, whose columns tell rows apart, a row is also left out if it shares a key with an earlier row that is kept.
    Rows that share keys, by others if need be, form components, which don't matter to each other: a component of at most
    `together` rows is settled in order within one task. A larger one is settled so many rows at a time, from the first on, and
    what shares a key with what was kept goes before the next rows are taken. The number of jobs doesn't grow with chains.
    """
    out = new
    for k in keys:
        out = out.join(old.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    out = out.select(new.columns)
    if not order:
        return out
    from lexmill.operators.graph import components

    ws = Workspace(new.sparkSession, "layers")
    out = ws.write(place_in_group(out, None, list(order), "__n"), "rows")
    names = [f"k{i}" for i in range(len(keys))]
    named = out.select("__n", *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)])
    each = named.select("__n", F.posexplode(F.array(*names)).alias("i", "v")).where("v is not null")
    shared = ws.write(each.groupBy("i", "v").agg(F.min("__n").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "shared")
    links = each.join(shared, ["i", "v"]).select(F.col("first").alias("a"), F.col("__n").alias("b"))
    comps = ws.write(components(ws.write(links, "links"), ws), "components")
    sizes = comps.groupBy("comp").agg(F.count("*").alias("c"))
    rows = ws.write(named.join(comps, F.col("__n") == F.col("node")).join(sizes, "comp").select("comp", "c", "__n", *names), "members")

    def settle(g):
        """The rows of a group that share no key with an earlier kept one of it."""
        g = g.sort_values("__n")
        kept, used = [], [set() for _ in names]
        for row in g[["__n", *names]].itertuples(index=False, name=None):
            if not any(v is not None and v in u for v, u in zip(row[1:], used, strict=True)):
                kept.append(row[0])
                for v, u in zip(row[1:], used, strict=True):
                    if v is not None:
                        u.add(v)
        return g[g["__n"].isin(kept)][["__n", *names]]

    schema = ", ".join(["__n long", *(f"{n} string" for n in names)])
    kept = [ws.write(rows.where(F.col("c") <= together).groupBy("comp").applyInPandas(settle, schema), "kept")]
    left, k = ws.write(rows.where(F.col("c") > together).select("__n", *names), "left-0"), 0
    while not left.isEmpty():
        k += 1
        last = left.orderBy("__n").limit(together).agg(F.max("__n")).first()[0]
        kept.append(ws.write(left.where(F.col("__n") <= last).withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(settle, schema), f"kept-{k}"))
        left = left.where(F.col("__n") > last)
        for n in names:
            left = left.join(kept[-1].where(F.col(n).isNotNull()).select(n).distinct(), n, "left_anti")
        left = ws.write(left.select("__n", *names), f"left-{k}")
        ws.drop(f"left-{k - 1}")
    gone = rows.select("__n").join(reduce(DataFrame.union, kept).select("__n"), "__n", "left_anti")
    return out.join(gone, "__n", "left_anti").select(new.columns)


def multiset_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, item, n_a, n_b) where the counts differ, in either direction."""
    on = [*keys, item]
    both = a.select(*on, F.lit(1).alias("__a"), F.lit(0).alias("__b")).union(b.select(*on, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    return both.groupBy(*on).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b")).where("n_a <> n_b")


def first_text(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds text and text_field: the first of the fields that isn't blank, and its name."""
    value = [F.nullif(F.trim(F.col(f)), F.lit("")) for f in fields]
    name = F.lit(None).cast("string")
    for f, v in reversed(list(zip(fields, value, strict=True))):
        name = F.when(v.isNotNull(), f).otherwise(name)
    return df.withColumn("text", F.coalesce(*value)).withColumn("text_field", name)


def work_grid(cases: DataFrame, models: DataFrame, done: DataFrame, case: str, model: str, most_models: int = 1000) -> DataFrame:
    """Every (case, model) that isn't done. models is a short list, which is checked, so that it can go to every task."""
    if models.limit(most_models + 1).count() > most_models:
        raise ValueError("more models than a work grid is made for")
    names = [r[0] for r in models.select(model).distinct().collect()]
    grid = cases.select(case).distinct().withColumn(model, F.explode(F.array(*[F.lit(x) for x in names])))
    return grid.join(done.select(case, model).distinct(), [case, model], "left_anti")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most n rows of each group, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def funnel(df: DataFrame, by: str, survives: Column, bucket: Column, values: Sequence[str]) -> DataFrame:
    """(by, n, survivors, a count for each bucket among the survivors)."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(survives).alias("survivors"), *[F.count_if(survives & (bucket == v)).alias(f"n_{v}") for v in values])
