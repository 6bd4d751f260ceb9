"""Samples that come out alike in any engine: every draw is by the order of md5(key|seed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(key: Column | str, seed: int | str) -> Column:
    """The order key of a row."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows."""
    return df.orderBy(draw(key, seed), key).limit(n)


def band(score: Column, edges: list[float]) -> Column:
    """The index of the band [edges[i], edges[i + 1]), the last one closed; null outside."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(edges[:-1]):
        out = F.when(score >= e, i).otherwise(out)
    return F.when(score <= edges[-1], out)


def stratified(df: DataFrame, key: str, score: str, edges: list[float], total: int, seed: int = 0) -> DataFrame:
    """total rows over score bands: an equal quota each, what a band lacks goes to the next, what is left to any band.

    Rows outside the bands are left out. With fewer rows than total all are taken.
    """
    k = len(edges) - 1
    rows = df.withColumn("band", band(F.col(score), edges)).where("band is not null")
    size = {r["band"]: r["count"] for r in rows.groupBy("band").count().collect()}  # a row for each band
    take, carry = [0] * k, 0
    for i in range(k):
        quota = total // k + (i < total % k) + carry
        take[i] = min(size.get(i, 0), quota)
        carry = quota - take[i]
    for i in range(k):  # top-up
        more = min(size.get(i, 0) - take[i], carry)
        take[i] += more
        carry -= more
    parts = [rows.where(F.col("band") == i).orderBy(draw(key, seed), key).limit(n) for i, n in enumerate(take) if n]
    return reduce(DataFrame.union, parts) if parts else rows.limit(0)


def three_strata(df: DataFrame, key: str, spread: str, score: str, n: int, seed: int = 0) -> DataFrame:
    """n rows with a stratum: 40 % with the widest spread, 25 % of the rest with the lowest score, the others by draw."""
    a, b = round(0.4 * n), round(0.25 * n)
    widest = df.orderBy(F.desc(spread), key).limit(a)
    rest = df.join(widest.select(key), key, "left_anti")
    lowest = rest.orderBy(score, key).limit(b)
    rest = rest.join(lowest.select(key), key, "left_anti")
    drawn = rest.orderBy(draw(key, seed), key).limit(n - a - b)
    parts = ((widest, "widest"), (lowest, "lowest"), (drawn, "random"))
    out = None
    for p, name in parts:
        p = p.select(df.columns).withColumn("stratum", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def scramble(words: Column, window: int, seed: Column | str) -> Column:
    """The words, shuffled within consecutive windows of so many: the multiset of each window stays."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    tagged = F.transform(
        words,
        lambda w, i: F.struct(F.floor(i / window).alias("b"), F.md5(F.concat_ws("|", seed.cast("string"), i.cast("string")).cast("binary")).alias("h"), w.alias("w")),
    )
    return F.transform(F.array_sort(tagged), lambda x: x["w"])


def assign_names(df: DataFrame, index: str, pool: list[str], offset: int = 0, avoid: str | None = None) -> DataFrame:
    """Adds name: pool[(index + offset) mod n], or the next one in the pool that isn't in the array column `avoid`."""
    n = len(pool)
    at = F.sequence(F.lit(0), F.lit(n - 1))
    names = F.array(*[F.lit(x) for x in pool])
    turn = F.transform(at, lambda k: F.element_at(names, (F.pmod(F.col(index) + offset + k, F.lit(n)) + 1).cast("int")))
    if avoid:
        turn = F.filter(turn, lambda x: ~F.array_contains(F.coalesce(F.col(avoid), F.array().cast("array<string>")), x))
    return df.withColumn("name", F.get(turn, 0))


CONTROLS = "array<struct<word:int,lo:int,hi:int,text:string>>"


def matched_controls(df: DataFrame, key: str, text: str, spans: str, taken: str | None = None, tries: int = 30, want: int = 3, prefix: int = 10, margin: int = 5, room: int = 40, in_words: bool = False) -> DataFrame:
    """(key, span, n_words, tries, controls) of each target span of a text: up to `want` other spans of as many words.

    spans is an array of (lo, hi) in characters (in_words: in words), taken one of what must be kept clear besides. Targets are served in order, by
    at most tries * want draws each: a draw is the start, by a digest of key, span and draw, of words from prefix + margin on,
    and is kept if it overlaps no target, nothing taken, and no control before it. controls have the first word's number,
    the place in characters, and the words with single blanks between them. A text with fewer than prefix + span + room words has no controls and no draws; a null text, or one
    without spans, has no rows. A text and its spans are one row, so a task holds one text's spans at a time.
    """
    t = dict(df.dtypes)[key]

    def run(frames):
        import hashlib
        import re
        from bisect import bisect_left, insort

        import pandas as pd

        for f in (part for frame in frames for part in _parts(frame)):
            out = []
            for k, body, targets, other in zip(f["k"], f["t"], f["s"], f["u"], strict=True):
                if body is None or targets is None:
                    continue
                words = [m.span() for m in re.finditer(r"\S+", body)]
                ends = [b for _, b in words]
                # what is taken, in words: those that a span touches
                place = (lambda x: (x["lo"], min(x["hi"], len(words)))) if in_words else (lambda x: _words_of(words, ends, x["lo"], x["hi"]))  # noqa: B023
                used = [place(x) for x in [*targets, *(other if other is not None else ())]]
                used = sorted(x for x in used if x[0] < x[1])
                widest = max((b - a for a, b in used), default=0)
                for i, x in enumerate(targets):
                    a, b = place(x)
                    size, made, found = b - a, 0, []
                    last = len(words) - size - margin
                    if size > 0 and len(words) >= prefix + size + room and last >= prefix + margin:
                        while len(found) < want and made < tries * want:
                            h = int(hashlib.md5(f"{k}|{i}|{made}".encode()).hexdigest()[:8], 16)
                            w, made = prefix + margin + h % (last - prefix - margin + 1), made + 1
                            at = bisect_left(used, (w - widest, 0))
                            while at < len(used) and used[at][0] < w + size and used[at][1] <= w:
                                at += 1
                            if at == len(used) or used[at][0] >= w + size:
                                insort(used, (w, w + size))
                                widest = max(widest, size)
                                lo, hi = words[w][0], words[w + size - 1][1]
                                found.append({"word": w, "lo": lo, "hi": hi, "text": " ".join(body[lo:hi].split())})
                    out.append((k, i, size, made, found))
            yield pd.DataFrame(out, columns=["k", "span", "n_words", "tries", "controls"])

    none = F.array().cast("array<struct<lo:int,hi:int>>")
    x = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(spans).alias("s"), (F.col(taken) if taken else none).alias("u"))
    out = x.mapInPandas(run, f"k {t}, span int, n_words int, tries int, controls {CONTROLS}")
    return out.withColumnRenamed("k", key)


def _parts(frame, rows: int = 256):
    """A frame a few rows at a time, so that few texts' words are held at once."""
    for at in range(0, len(frame), rows):
        yield frame.iloc[at : at + rows]


def _words_of(words: list[tuple[int, int]], ends: list[int], lo: int, hi: int) -> tuple[int, int]:
    """The words that a stretch of characters touches, as a range."""
    from bisect import bisect_left, bisect_right

    return bisect_right(ends, lo), bisect_left(words, (hi, 0))
