"""Minimax contiguous partition of atomic groups into shards.

Equal texts form a group, groups are ordered by a hash of the text, and shards are runs of groups. The smallest capacity that
fits into the given number of shards is found by binary search, each capacity being checked greedily. The driver never sees
the groups: it works on sums over ranges of the hash, and has a range split further only where a step of the search ends inside
it. When every step ends at a range that is a single group, the outcome is that of the whole sequence.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import Workspace

#: Bits of the hash in the first summary, and bits more in each refinement.
FIRST_BITS, MORE_BITS = 12, 8


class Ranges:
    """Consecutive ranges of the ordered groups: start of the range, its bits, sum of sizes, number of groups."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows = sorted(rows)
        self.start = [r[0] for r in rows]
        self.bits = [r[1] for r in rows]
        self.count = [r[3] for r in rows]
        self.sums = [0, *np.cumsum([r[2] for r in rows], dtype=object).tolist()]
        self.coarse: set[int] = set()  # ranges of several groups in which a step ended

    def upto(self, at: int, most: int) -> int:
        """The last boundary whose sum is at most `most`, from boundary `at` on."""
        i = bisect_right(self.sums, most, lo=at) - 1
        if i < len(self.count) and self.sums[i] < most and self.count[i] > 1:
            self.coarse.add(i)
        return max(i, at)

    def downto(self, at: int, least: int) -> int:
        """The first boundary whose sum is at least `least`, up to boundary `at`."""
        i = bisect_left(self.sums, least, hi=at + 1)
        i = min(i, at)
        if i and self.sums[i] > least and self.count[i - 1] > 1:
            self.coarse.add(i - 1)
        return i

    def fits(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.upto(at, self.sums[at] + capacity)
        return at == len(self.count)

    def cuts(self, shards: int) -> tuple[int, list[int]]:
        """The least capacity, and the boundaries after each shard but the last.

        Under the least capacity there is room for choice; each cut goes next to an equal share of what is left, as far as the
        capacity allows it and the rest still fits.
        """
        end = len(self.count)
        low, high = -(-self.sums[end] // shards), self.sums[end]
        while low < high:
            mid = (low + high) // 2
            if self.fits(mid, shards):
                high = mid
            else:
                low = mid + 1
        latest = [end]  # from where on the last 0, 1, 2, ... shards hold the rest
        for _ in range(shards - 1):
            latest.append(self.downto(latest[-1], self.sums[latest[-1]] - low))
        out, at = [], 0
        for left in range(shards, 1, -1):
            most = self.upto(at, self.sums[at] + low)
            least = max(at, latest[left - 1])
            share = self.sums[at] + (self.sums[end] - self.sums[at]) // left
            below = self.upto(at, share)
            above = min(below + 1, end)
            if below < end and self.count[below] > 1:
                self.coarse.add(below)
            cut = below if share - self.sums[below] <= self.sums[above] - share else above
            at = min(max(cut, least), most)
            out.append(at)
        return low, out


def _prefix(bits: int):
    """The hash's leading bits, with zeros behind, as a signed long; order stays."""
    return F.shiftleft(F.shiftright("key", 64 - bits), 64 - bits) if bits < 64 else F.col("key")


def boundaries(groups: DataFrame, shards: int) -> tuple[int, list[int | None]]:
    """The least capacity and the key at which each shard after the first begins (None: past all groups).

    groups: key (distinct longs) and size (long), read as often as ranges are refined, so a written table is best.
    """

    def summed(df: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        rows = df.groupBy(_prefix(bits).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        return [(r["p"], bits, r["s"], r["n"]) for r in rows]

    held = summed(groups, FIRST_BITS)
    while True:
        r = Ranges(held)
        capacity, cuts = r.cuts(shards)
        if not r.coarse:
            return capacity, [r.start[c] if c < len(r.start) else None for c in cuts]
        fine = [x for i, x in enumerate(sorted(held)) if i not in r.coarse]
        by_bits: dict[int, list[int]] = {}
        for i in r.coarse:
            by_bits.setdefault(r.bits[i], []).append(r.start[i])
        for bits, starts in by_bits.items():  # some hundreds of ranges at most: two for each step of the search
            wanted = df_of(groups.sparkSession, starts)
            inside = groups.withColumn("p0", _prefix(bits)).join(F.broadcast(wanted), "p0")
            fine += summed(inside, min(64, bits + MORE_BITS))
        held = fine


def df_of(spark, starts: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in starts], "p0 bigint")


def shard(
    df: DataFrame, text: str = "text", order: str = "doc_id", shards: int = 16, keep: list[str] | None = None
) -> DataFrame:
    """Every row of df (columns `keep`, all by default) with __size, __crc32, __shard and __slot.

    A row's size is its text's UTF-8 bytes plus 1 (null: 1). Rows of equal texts share a shard; shards are 0 to shards - 1, and
    no partition of the ordered groups into as many runs has a smaller largest shard. Slots count a shard's rows from 0 by the
    order column; rows that repeat get slots of their own. Null texts are a group, as empty ones are. With fewer groups than
    shards some shards stay empty; an empty table gives an empty one.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "shards")
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("__size", "__crc32", "__shard", "__slot")]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        *[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)],
        F.col(order).alias("o"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("crc"),
        F.xxhash64(F.col(text), F.col(text).isNull()).alias("key"),
    )
    rows = ws.write(rows, "rows")
    groups = ws.write(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, starts = boundaries(groups, shards)
    of_key = F.lit(0)
    for s in starts:
        of_key = of_key + (F.lit(0) if s is None else (F.col("key") >= F.lit(s)).cast("int"))
    # a range partition by shard and order, written with each row's place in its partition; counts of (partition, shard) then
    # give where a shard's rows of a partition begin
    placed = rows.withColumn("shard", of_key).repartitionByRange("shard", "o", "key").sortWithinPartitions("shard", "o", "key", "crc")
    at = F.monotonically_increasing_id()
    placed = placed.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND((1 << 33) - 1))
    placed = ws.write(placed, "placed")
    begin: dict[int, int] = {}
    base = []
    for r in placed.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("part", "shard").collect():
        base.append((r["part"], r["shard"], begin.get(r["shard"], 0) - r["first"]))
        begin[r["shard"]] = begin.get(r["shard"], 0) + r["n"]
    offsets = F.broadcast(spark.createDataFrame(base, "part bigint, shard int, base bigint"))  # partitions + shards rows
    ws.drop("rows", "groups")
    out = placed.join(offsets, ["part", "shard"])
    return out.select(
        *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)],
        F.col("size").alias("__size"),
        F.col("crc").alias("__crc32"),
        F.col("shard").alias("__shard"),
        (F.col("at") + F.col("base")).alias("__slot"),
    )
