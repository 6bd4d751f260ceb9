"""Ordered operators: windows over token positions, chunk spans, running cut-offs, sections, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.numbers import ratio


def chunk_spans(df: DataFrame, n: str, chunk: int, overlap: int, warm_up: int) -> DataFrame:
    """The chunks of sequences of length n: (…, k, start, end, score_from), a row each.

    Chunks follow each other at chunk - overlap; what a chunk scores begins warm_up after its start, but for the first one.
    """
    step = chunk - overlap
    last = F.when(F.col(n) <= chunk, 0).otherwise(F.ceil((F.col(n) - chunk) / step)).cast("int")
    out = df.where(F.col(n) > 0).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("k") * step
    return out.withColumn("start", start).withColumn("end", F.least(start + chunk, F.col(n))).withColumn("score_from", start + F.when(F.col("k") == 0, 0).otherwise(warm_up))


def first_writer(df: DataFrame, keys: Sequence[str], value: str, writer: str) -> DataFrame:
    """The value of the smallest writer for each key, where several wrote it."""
    return df.groupBy(*keys).agg(F.min_by(value, writer).alias(value))


def sliding_windows(df: DataFrame, key: str, values: str, size: int, step: int, low: float, least_known: float = 0.8) -> DataFrame:
    """(key, start, n, mean, min, frac_low) of windows of an array; windows with too many nulls are left out."""
    n = F.size(values)
    at = F.explode(F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step))).otherwise(F.array().cast("array<int>")))
    w = df.select(key, values, at.alias("start")).select(key, "start", F.filter(F.slice(values, F.col("start") + 1, F.lit(size)), lambda x: x.isNotNull()).alias("w"))
    w = w.select(key, "start", F.explode(F.array("w")).alias("w")).where(F.size("w") >= least_known * size)
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return w.select(key, "start", F.size("w").alias("n"), (total / F.size("w")).alias("mean"), F.array_min("w").alias("min"), ratio(F.size(F.filter("w", lambda x: x < low)), F.size("w")).alias("frac_low"))


def truncations(df: DataFrame, key: str, values: str, lengths: Sequence[int], low: float) -> DataFrame:
    """(key, trunc, n, total, mean, p, min, n_low, first_break) of the first `trunc` values, and of all (0)."""
    at = F.explode(F.array(*[F.lit(x) for x in (*lengths, 0)])).alias("trunc")
    x = df.select(key, values, at).select(key, "trunc", F.explode(F.array(F.when(F.col("trunc") > 0, F.slice(values, F.lit(1), F.greatest("trunc", F.lit(1)))).otherwise(F.col(values)))).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, v: s + v)
    n = F.size("w")
    return x.where(n > 0).select(key, "trunc", n.alias("n"), total.alias("total"), (total / n).alias("mean"), F.exp(total / n).alias("p"), F.array_min("w").alias("min"), F.size(F.filter("w", lambda v: v < low)).alias("n_low"), (F.array_position("w", F.array_min("w")) - 1).alias("first_break"))


def running_cutoff(df: DataFrame, key: str, pos: str, value: str, low: float, high: float, least: int = 2) -> DataFrame:
    """(key, n): the longest prefix whose running probability lies in [low, high], before it first falls below low; null if none."""
    p = F.exp(F.sum(value).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    x = df.select(key, p.alias("p"), n.alias("n"))
    return x.groupBy(key).agg(F.max(F.when((F.col("p") >= low) & (F.col("p") <= high) & (F.col("n") >= least), F.col("n"))).alias("n"))


def sections(lines: DataFrame, doc: str, pos: str, text: str, heading: Column, first: str = "preamble") -> DataFrame:
    """(doc, section_no, heading, body, n_lines): lines belong to the last heading before them; heading lines aren't body."""
    head = F.coalesce(heading, F.lit(False))
    w = Window.partitionBy(doc).orderBy(pos)
    x = lines.select(doc, pos, text, head.alias("__h")).withColumn("section_no", F.sum(F.col("__h").cast("int")).over(w))
    out = x.groupBy(doc, "section_no").agg(
        F.coalesce(F.max(F.when(F.col("__h"), F.trim(text))), F.lit(first)).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("__h"), F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))).alias("b")
    )
    return out.select(doc, "section_no", "heading", F.array_join(F.transform("b", lambda r: r["t"]), "\n").alias("body"), F.size("b").alias("n_lines"))


def repeated_lines(lines: DataFrame, doc: str, page: str, text: str, share: float = 0.4, longest: int = 90) -> DataFrame:
    """(doc, line, pages): short lines that stand on at least max(2, share) of a document's pages."""
    l = F.trim(text)
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("__n"))
    n = lines.where((l != "") & (F.length(l) < longest)).groupBy(doc, l.alias("line")).agg(F.countDistinct(page).alias("pages"))
    return n.join(pages, doc).where(F.col("pages") >= F.greatest(F.lit(2), F.floor(share * F.col("__n")))).select(doc, "line", "pages")


def unbroken_run(df: DataFrame, key: str, n: str, pos: str) -> DataFrame:
    """(key, run): how far numbers 1, 2, 3, ... go without a gap and at ascending positions."""
    one = df.groupBy(key, n).agg(F.min(pos).alias("__p"))
    w = Window.partitionBy(key).orderBy(n)
    ok = (F.col(n) == F.row_number().over(w)) & (F.coalesce(F.lag("__p").over(w), F.lit(-1)) <= F.col("__p"))
    x = one.withColumn("__ok", ok).withColumn("__all", F.min(F.col("__ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key).agg(F.sum("__all").alias("run"))


def nested_prefixes(words: Column, at: Column, lengths: Sequence[int], target: int) -> Column:
    """An array of (n, prompt, answer): the n words before a break, and the same `target` words after it; what doesn't fit is left out."""
    made = [F.struct(F.lit(n).alias("n"), F.array_join(F.slice(words, F.greatest(at - n + 1, F.lit(1)), F.lit(n)), " ").alias("prompt"), F.array_join(F.slice(words, at + 1, F.lit(target)), " ").alias("answer")) for n in lengths]
    return F.filter(F.array(*made), lambda x: (at >= x["n"]) & (F.size(words) >= at + target))


def nearest_usable(items: DataFrame, key: str, pos: str, depth: int, usable: Column, value: str) -> DataFrame:
    """(key, pos, value): the first usable item from depth on, else the last one before it."""
    behind = F.col(pos) < depth
    rank = F.struct(behind.alias("b"), F.abs(F.col(pos) - depth).alias("d"))
    return items.where(usable).groupBy(key).agg(F.min_by(F.struct(pos, value), rank).alias("m")).select(key, f"m.{pos}", f"m.{value}")


def blocks(words: Column, size: int, least: int) -> Column:
    """Words cut into blocks of `size`; a shorter last block is dropped unless it has at least `least` words."""
    n = F.size(words)
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(words, i * size + 1, F.lit(size)))
    return F.filter(every, lambda b: F.size(b) >= least)
