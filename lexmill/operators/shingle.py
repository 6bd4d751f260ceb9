"""Shingle tables, containment and recurrence."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numbers import ratio
from lexmill.functions.text import shingle_words
from lexmill.session import Workspace


def words_once(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, w): the words as an array of their own row, so that no later expression makes them again for each element."""
    return df.select(*keys, F.explode(F.array(shingle_words(F.col(text)))).alias("w"))


#: Different shingles of the smaller side that are broadcast as longs; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of the different shingles of an array of words.

    Shingles go on as these longs: of ten billion different ones two fall together with a probability of some percent.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    return F.array_distinct(F.when(n >= size, runs).otherwise(F.array().cast("array<bigint>")))


def shingle_table(df: DataFrame, key: str, text: str, size: int = 8) -> DataFrame:
    """(key, shingle), each once for a text."""
    return words_once(df, [key], text).select(key, F.explode(shingle_hashes(F.col("w"), size)).alias("shingle"))


def _among(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of df whose shingle is one of wanted (different ones), before anything is shuffled if these are few."""
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return df.join(F.broadcast(wanted) if few else wanted, "shingle", "left_semi")


def containment(queries: DataFrame, corpus: DataFrame, key: str, text: str, corpus_key: str, corpus_text: str, size: int = 8) -> DataFrame:
    """(key, corpus_key, shared, share) of the corpus texts that share a shingle with a query text.

    Corpus shingles that no query has are dropped where they are made; a shingle that very many texts have is one row for each text
    and query that has it.
    """
    ws = Workspace(queries.sparkSession, "containment")
    q = ws.write(shingle_table(queries, key, text, size), "queries")
    c = _among(shingle_table(corpus, corpus_key, corpus_text, size), q.select("shingle").distinct())
    n = q.groupBy(key).agg(F.count("*").alias("n"))
    hits = q.join(c, "shingle").groupBy(key, corpus_key).agg(F.count("*").alias("shared"))
    return hits.join(n, key).select(key, corpus_key, "shared", ratio("shared", "n").alias("share"))


def recurrence(spans: DataFrame, corpus: DataFrame, doc: str, text: str, arm: str, words: str = "words", start: str = "start", size: int = 8) -> DataFrame:
    """spans (doc, start, words) with shingles, in_post, in_other_pre and in_own: the shares of a span's different shingles that another
    document of the post arm has, that another one of the pre arm has, and that its own document has wholly before the span.

    start is the number of words before a span. corpus: (doc, text, arm). Of each shingle only two documents of each arm are kept, the
    first and the last, so that a frequent one stays one row. A span without shingles is left out; a null arm is in neither.
    """
    ws = Workspace(spans.sparkSession, "recurrence")
    s = spans.select(doc, start, F.explode(shingle_hashes(F.col(words), size)).alias("shingle"))
    s = ws.write(s, "spans")
    w = words_once(corpus, [doc, arm], text)
    n = F.size("w")
    runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.struct(F.xxhash64(F.array_join(F.slice("w", i, size), " ")).alias("shingle"), (i - 1).alias("at")))
    each = w.where(n >= size).select(doc, arm, F.explode(runs).alias("x")).select(doc, arm, "x.*")
    each = ws.write(_among(each, s.select("shingle").distinct()).groupBy("shingle", doc, arm).agg(F.min("at").alias("at")), "corpus")
    ends = [f(F.when(F.col(arm) == a, F.col(doc))).alias(f"{a}_{k}") for a in ("post", "pre") for k, f in (("lo", F.min), ("hi", F.max))]
    c = each.groupBy("shingle").agg(*ends)
    own = each.select("shingle", doc, F.col("at").alias("__at"))
    x = s.join(c, "shingle", "left").join(own, ["shingle", doc], "left")
    other = lambda a: F.coalesce((F.col(f"{a}_lo") != F.col(doc)) | (F.col(f"{a}_hi") != F.col(doc)), F.lit(False))
    share = lambda c: ratio(F.count_if(c), F.count("*"))
    return x.groupBy(doc, start).agg(
        F.count("*").alias("shingles"), share(other("post")).alias("in_post"), share(other("pre")).alias("in_other_pre"),
        share(F.coalesce(F.col("__at") + size <= F.col(start), F.lit(False))).alias("in_own"),
    )


#: Parts of all hashes that recurrence_at() compares one after the other; disk holds the shuffle of one of them.
PARTS = 8

#: Rows beyond which a worker passes on what it has.
ROWS = 200_000


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, which are given as hashes."""
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _in_spans(words: np.ndarray, length: int, every: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, starts, own) of a text, each pair of a different shingle and a span once, start -1 where it is in no span; own: it is
    wholly before the span, too."""
    found, first, of = np.unique(_rolled(words, size), return_index=True, return_inverse=True)
    at = np.arange(len(of))
    start = at - at % every
    inside = (at % every <= length - size) & (start + length <= len(words))
    pairs = np.unique(of[inside] * np.int64(len(words)) + start[inside])
    of, start = np.divmod(pairs, len(words))
    rest = np.setdiff1d(np.arange(len(found)), of)
    none = np.full(len(rest), -1)
    return found[np.concatenate([of, rest])].view(np.int64), np.concatenate([start, none]), np.concatenate([first[of] + size <= start, none > 0])


def _rows(doc: str, arm: str, length: int, every: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc, arm, shingle, start, own) from (doc, arm, h), h being hashes of a text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count = [], 0
            for i, h in enumerate(batch.column("h")):
                x = _in_spans(h.values.to_numpy().view(np.uint64), length, every, size)
                held.append((np.full(len(x[0]), i), *x))
                count += len(x[0])
                if count > ROWS or i + 1 == batch.num_rows:
                    row, shingle, start, own = (np.concatenate(c) for c in zip(*held, strict=True))
                    given = [batch.column(c).take(pa.array(row)) for c in (doc, arm)]
                    made = [pa.array(shingle), pa.array(start.astype(np.int32), mask=start < 0), pa.array(own)]
                    yield pa.RecordBatch.from_arrays([*given, *made], names=[doc, arm, "shingle", "start", "own"])
                    held, count = [], 0

    return run


def recurrence_at(corpus: DataFrame, doc: str, text: str, arm: str, length: int, every: int, size: int = 8) -> DataFrame:
    """What recurrence() gives, for the spans of `length` words that begin at every `every`th word of the corpus's own texts.

    What a text itself says of its spans is found where the text is. Shingles are written once, 8 bytes each, and compared a part of
    their hashes at a time; only those of more than one document meet the spans.
    """
    spark = corpus.sparkSession
    ws = Workspace(spark, "recurrence")
    w = words_once(corpus, [doc, arm], text).where(F.size("w") >= size)
    h = w.select(doc, arm, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    schema = h.select(doc, arm, F.lit(0).cast("long").alias("shingle"), F.lit(0).alias("start"), F.lit(True).alias("own")).schema
    for f in schema:
        f.nullable = True
    each = ws.write(h.mapInArrow(_rows(doc, arm, length, every, size), schema), "each")
    inside = F.col("start").isNotNull()
    spans = ws.write(each.where(inside).groupBy(doc, "start").agg(F.count("*").alias("n"), F.count_if("own").alias("own")), "spans")
    ends = [f(F.when(F.col(arm) == a, F.col(doc))).alias(f"{a}_{k}") for a in ("post", "pre") for k, f in (("lo", F.min), ("hi", F.max))]
    other = {a: F.coalesce((F.col(f"{a}_lo") != F.col(doc)) | (F.col(f"{a}_hi") != F.col(doc)), F.lit(False)) for a in ("post", "pre")}
    hits = None
    for k in range(PARTS):
        part = each.where(F.pmod("shingle", F.lit(PARTS)) == k)
        common = part.groupBy("shingle").agg(*ends, F.min(doc).alias("lo"), F.max(doc).alias("hi")).where("lo <> hi").drop("lo", "hi")
        common = ws.write(common, f"common{k}")
        few = common.count() <= MOST_BROADCAST
        met = part.where(inside).join(F.broadcast(common) if few else common, "shingle")
        met = ws.write(met.groupBy(doc, "start").agg(*[F.count_if(x).alias(a) for a, x in other.items()]), f"hits{k}")
        ws.drop(f"common{k}")
        hits = met if hits is None else hits.unionAll(met)
        del part, common, met
        gc.collect()  # a shuffle's files go when nothing refers to it, neither here nor in the JVM
        spark._jvm.System.gc()
    ws.drop("each")
    hits = hits.groupBy(doc, "start").agg(F.sum("post").alias("post"), F.sum("pre").alias("pre"))
    share = lambda c: ratio(F.coalesce(c, F.lit(0)), F.col("n"))
    return spans.join(hits, [doc, "start"], "left").select(
        doc, "start", F.col("n").alias("shingles"), share(F.col("post")).alias("in_post"), share(F.col("pre")).alias("in_other_pre"),
        share(F.col("own")).alias("in_own"),
    )
