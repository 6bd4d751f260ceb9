"""MinHash near-duplicates with sequential Bayesian verification.

Texts that are equal form one class and are looked at once. Signatures are banded; texts that share a band are candidates.
A bucket's members are compared with its smallest one first, which joins most of a large group. Where a bucket still holds
members of different components, these are compared in blocks: a large bucket is cut into blocks, each pair of blocks is a
task's business, and only links that join components leave the task. A pair is compared batch by batch: first one bit of every
hash, then whole hashes. It is dropped as soon as the posterior probability of reaching the threshold falls below the chosen
miss probability. Survivors are verified on full shingle sets.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_rows, text_key
from lexmill.llm.graph import components
from lexmill.session import Workspace

BANDS, ROWS = 40, 6  # a pair at similarity 0.75 shares a band with probability 0.9996
#: Hashes compared at a time, and the probability at which a pair at the threshold may be dropped.
BATCH, MISS = 32, 1e-6
#: A bucket is cut into at most 32 blocks, as far as these hold from LEAST_BLOCK to MOST_BLOCK members.
LEAST_BLOCK, MOST_BLOCK = 256, 4096
#: Classes of texts in surviving pairs whose keys are broadcast, at 16 bytes each; more are joined by a shuffle.
MAX_BROADCAST_KEYS = 500_000

#: Maps A-Z to a-z; words end at a space or at \\x09-\\x0d.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words than size are one shingle, none give none.

    Sets are compared by these hashes: two different shingles of a pair of texts of 20,000 words each fall on one hash with a
    probability of 2e-11.
    """
    words = text.encode().translate(_LOWER).split() if text else []  # bytes.split() cuts at \\x20 and \\x09-\\x0d only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            s = (s ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
    return np.unique(s)


@cache
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """MinHash values of a non-empty shingle set, 32 bits each."""
    a, b = _family(n)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 512):
            np.minimum(out, (s[at : at + 512, None] * a + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bits(g: np.ndarray) -> list[int]:
    """The lowest bit of each hash, as longs of 64 bits; what is left of the last one is 0."""
    b = np.packbits((g & 1).astype(np.uint8))
    return np.frombuffer(b.tobytes() + bytes(-len(b) % 8), "<i8").tolist()


@cache
def most_differing(n_hashes: int, threshold: float, miss: float) -> int:
    """Most differing bits to go on: bits agree with probability (1 + similarity) / 2, similarities being equally likely."""
    p = np.linspace(0.5, 1, 20001)[1:-1]
    for d in range(n_hashes, -1, -1):
        log = (n_hashes - d) * np.log(p) + d * np.log(1 - p)
        w = np.exp(log - log.max())
        if w[p >= (1 + threshold) / 2].sum() >= miss * w.sum():
            return d
    return 0


@cache
def least_matches(n_hashes: int, batch: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(hashes seen, least matches to go on): with a uniform prior, P(similarity >= threshold | matches) >= miss."""

    def tail(m: int, n: int) -> float:  # of Beta(m + 1, n - m + 1) above the threshold = P(Binomial(n + 1, t) <= m)
        return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    seen = [*range(batch, n_hashes, batch), n_hashes]
    return tuple((n, next(m for m in range(n + 1) if tail(m, n) >= miss)) for n in seen)


def plausible(x: np.ndarray, y: np.ndarray, threshold: float, batch: int = BATCH, miss: float = MISS) -> np.ndarray:
    """Which rows of two signature matrices may still be similar, batch by batch."""
    alive = np.arange(len(x))
    matches = np.zeros(len(x), np.int64)
    at = 0
    for n, least in least_matches(x.shape[1], batch, threshold, miss):
        matches[alive] += (x[alive, at:n] == y[alive, at:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        at = n
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def groups(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, size: int = 5,
    similarity: tuple[int, int] = (75, 100), bands: int = BANDS, rows: int = ROWS, miss: float = MISS,
) -> DataFrame:
    """Every row of df (columns `keep`, all but the text by default) with its group of near-duplicates.

    Adds __n_shingles, __component (smallest id of the rows it is linked with directly or over others, itself included) and
    __kept (one row of each group: the smallest id, and of rows that repeat it the first). Two rows are linked if their
    shingle sets have similarity[1] * intersection >= similarity[0] * union. A row without words has no shingles and is
    linked with nothing. A row without id takes part; a group that has no id at all has a null component, and one row of it
    is kept. An empty table gives an empty one. Columns in `keep` are carried through two shuffles, so long ones had better
    stay out; deduplicate() gives whole rows.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("__n_shingles", "__component", "__kept")]
    out = _labelled(df, text, id_col, keep, size, similarity, bands, rows, miss)
    return out.select(
        *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)],
        F.col("n").alias("__n_shingles"),
        F.col("component").alias("__component"),
        F.col("kept").alias("__kept"),
    )


def deduplicate(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 5, similarity: tuple[int, int] = (75, 100),
    bands: int = BANDS, rows: int = ROWS, miss: float = MISS,
) -> DataFrame:
    """df's own columns; of each group that groups() finds one row, the one with the smallest id.

    Texts aren't carried along: the rows to leave out are known by hashes of id and text, and df is read again without them.
    These hashes are broadcast if they are few (counted first), else joined by a shuffle. Of rows that repeat both id and text
    one stays. Rows without words all stay, null texts among them. An empty table gives an empty one.
    """
    ws = Workspace(df.sparkSession, "neardup-rows")
    found = _labelled(df, text, id_col, [], size, similarity, bands, rows, miss)

    def row_key(id_: Column, k2: Column) -> Column:
        return F.xxhash64(F.lit(2), id_, id_.isNull(), k2)

    each = found.select("k1", row_key(F.col("id"), F.col("k2")).alias("k3"), F.col("kept").cast("int").alias("kept"))
    each = each.groupBy("k1", "k3").agg(F.sum("kept").alias("kept"), F.count("*").alias("c")).where("kept < c")
    each = ws.write(each, "gone")
    again = each.where("kept > 0").select("k1", "k3")
    n, n_again = each.count(), again.count()
    if not n:
        return df
    names = df.columns
    a, b = f"__a{ws.path[-12:]}", f"__b{ws.path[-12:]}"  # no column of df has such a name
    k1, k2 = text_key(text)
    tagged = df.select("*", k1.alias(a), row_key(F.col(id_col).cast("long"), k2).alias(b))

    def listed(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("k1").alias(a), F.col("k3").alias(b))
        return F.broadcast(keys) if n <= MAX_BROADCAST_KEYS else keys

    out = tagged.join(listed(each), [a, b], "left_anti")
    if n_again:
        out = out.unionByName(tagged.join(listed(again), [a, b], "left_semi").dropDuplicates([a, b]))
    return out.select(names)


def _labelled(df, text, id_col, keep, size, similarity, bands, rows, miss) -> DataFrame:
    """(k_0, ..., id, k1, k2, n, component, kept) of every row: the columns `keep`, keys, shingles, group, whether it stays."""
    spark = df.sparkSession
    ws = Workspace(spark, "neardup")
    n_hashes = bands * rows
    need, of = similarity

    # 1. one pass over the texts: shingle counts, band keys and signatures
    base = df.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], F.col(id_col).cast("long").alias("id"), *text_key(text), F.col(text).alias("t"))
    carried = [f"k_{i}" for i in range(len(keep))] + ["id", "k1", "k2"]
    schema = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in carried) + ", n bigint, bands array<bigint>, bits array<bigint>, sig binary"

    def sign():
        def run(r):
            out = {c: r[c] for c in carried} | {"n": [], "bands": [], "bits": [], "sig": []}
            for t in r["t"]:
                s = shingles(t, size)
                out["n"].append(len(s))
                if len(s):
                    g = signature(s, n_hashes)
                    keys = [xxhash.xxh3_64_intdigest(g[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)]
                    out["bands"].append(np.array(keys, np.uint64).astype(np.int64).tolist())
                    out["bits"].append(bits(g))
                    out["sig"].append(g.tobytes())
                else:
                    out["bands"].append(None)
                    out["bits"].append(None)
                    out["sig"].append(None)
            return out

        return run

    docs = ws.write(map_rows(base, sign, schema).withColumn("rid", F.monotonically_increasing_id()), "docs")

    # 2. classes of equal texts, each known by its smallest row
    rep = ws.write(docs.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.min("id").alias("id"), F.count("*").alias("c")), "classes")
    mine = docs.select("rid", "n", "bands", "bits").join(rep.select("rep"), F.col("rid") == F.col("rep"), "left_semi")
    mine = ws.write(mine.withColumnRenamed("rid", "x"), "mine")
    every = mine.select(F.explode("bands").alias("bucket"), "x")
    shared = every.groupBy("bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("bucket")
    members = ws.write(every.join(shared, "bucket", "left_semi").select("bucket", "x"), "members")
    taking = ws.write(members.select("x").distinct(), "taking")
    about = ws.write(mine.join(taking, "x", "left_semi").select("x", "n", "bits"), "about")
    signed = ws.write(docs.select("rid", "sig").join(taking, F.col("rid") == F.col("x"), "left_semi"), "signed")
    members = ws.write(members.join(about, "x").select("bucket", "x", F.col("x").alias("comp"), "n", "bits"), "members0")
    ws.drop("mine", "members", "taking", "about")

    # 3. each bucket's smallest member against the others
    differ = sum((F.bit_count(F.get("bits", i).bitwiseXOR(F.get("hub_bits", i))) for i in range(-(-n_hashes // 64))), F.lit(0))
    alike = (of * F.least("n", "hub_n") >= need * F.greatest("n", "hub_n")) & (differ <= most_differing(n_hashes, need / of, miss))
    comps = None
    if not members.isEmpty():
        first = members.groupBy("bucket").agg(F.min("x").alias("x"))
        hubs = members.join(ws.write(first, "first"), ["bucket", "x"], "left_semi")
        hubs = ws.write(hubs.select("bucket", F.col("x").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits")), "hubs")
        pairs = members.join(hubs, "bucket").where((F.col("x") != F.col("hub")) & alike)
        pairs = ws.write(pairs.select(F.col("hub").alias("a"), F.col("x").alias("b")).distinct(), "pairs")
        edges = _verify(df, ws, pairs, signed, rep, text, size, need, of, miss, n_hashes)
        comps = components(edges, ws, "cc1")
        left = members.select("bucket", "x", "n").join(hubs.select("bucket", F.col("hub").alias("x")), ["bucket", "x"], "left_anti")
        left = left.join(comps, left["x"] == comps["node"], "left").select("bucket", "x", F.coalesce("comp", "x").alias("comp"), "n")
        left = ws.write(left, "left")
        open_ = left.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
        members = ws.write(left.join(open_.where("lo <> hi").select("bucket", "m"), "bucket"), "open")
        ws.drop("members0", "first", "hubs", "pairs", "left")
        if not members.isEmpty():
            edges = edges.union(_in_blocks(df, ws, members, signed, rep, text, size, need, of, miss, n_hashes))
            comps = components(edges, ws, "cc2")
    ws.drop("signed", "open")

    # 4. back to rows
    if comps is None:
        named = rep.select("k1", "k2", "rep", F.col("rep").alias("comp"), "id")
    else:
        comps = comps.select("node", "comp")
        named = rep.join(comps, rep["rep"] == comps["node"], "left").select("k1", "k2", "rep", F.coalesce("comp", "rep").alias("comp"), "id")
    named = ws.write(named, "named")
    least = ws.write(named.groupBy("comp").agg(F.min("id").alias("component")), "least")
    named = ws.write(named.join(least, "comp").select("k1", "k2", "comp", "component"), "labels")
    narrow = docs.select(*carried, "n", "rid")
    out = narrow.join(named, ["k1", "k2"], "left")
    first = out.where("n > 0 and id <=> component").groupBy("comp").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    first = ws.write(first, "kept")
    out = out.join(first, "rid", "left")
    return out.select(
        *carried,
        "n",
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"),
        ((F.col("n") == 0) | F.coalesce("first", F.lit(False))).alias("kept"),
    )


def _sets(df, ws, name, members, rep, text, size) -> DataFrame:
    """(rep, s): the shingle sets of the classes that members (rep) lists, made from their texts again."""
    wanted = ws.write(members.distinct().join(rep, "rep").select("rep", "k1", "k2"), f"{name}-wanted")
    texts = df.select(*text_key(text), F.col(text).alias("t"))
    few = wanted.count() <= MAX_BROADCAST_KEYS
    texts = texts.join(F.broadcast(wanted) if few else wanted, ["k1", "k2"]).select("rep", "t")

    def sets():
        def run(r):
            return {"rep": r["rep"], "s": [shingles(t, size).tobytes() for t in r["t"]]}

        return run

    full = map_rows(texts, sets, "rep bigint, s binary")
    full = ws.write(full.groupBy("rep").agg(F.first("s").alias("s")), f"{name}-sets")
    ws.drop(f"{name}-wanted")
    return full


def similar(p: bytes, q: bytes, need: int, of: int) -> bool:
    x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return of * both >= need * (len(x) + len(y) - both)


def _in_blocks(df, ws, members, signed, rep, text, size, need, of, miss, n_hashes) -> DataFrame:
    """Links (a, b) between members (bucket, x, comp, n, m) of a bucket that are of different components."""
    full = _sets(df, ws, "blocks", members.select(F.col("x").alias("rep")), rep, text, size)
    full = ws.write(full.join(signed.select(F.col("rid").alias("rep"), "sig"), "rep").withColumnRenamed("rep", "x"), "full")
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("m") / 32)))
    n = F.ceil(F.col("m") / block).cast("int")
    each = members.withColumn("b", F.pmod(F.xxhash64("x"), n).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), n - 1)))
    each = each.select("bucket", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "x", "comp", "n")
    each = ws.write(each, "each").join(full, "x")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label, b, n = (pdf[c].to_numpy().copy() for c in ("comp", "b", "n"))
        out: list[tuple[int, int]] = []
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), n_hashes)
        sets, x = pdf["s"].tolist(), pdf["x"].tolist()
        for i in range(len(pdf) - 1):
            if (label == label[0]).all():
                break
            j = np.arange(i + 1, len(pdf))
            j = j[(label[j] != label[i]) & (of * np.minimum(n[j], n[i]) >= need * np.maximum(n[j], n[i]))]
            if key[1] != key[2]:
                j = j[b[j] != b[i]]
            if len(j):
                j = j[plausible(np.broadcast_to(sig[i], (len(j), n_hashes)), sig[j], need / of, BATCH, miss)]
            for k in j.tolist():
                if label[k] != label[i] and similar(sets[i], sets[k], need, of):
                    out.append((x[i], x[k]))
                    label[label == label[k]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = ws.write(each.groupBy("bucket", "lo", "hi").applyInPandas(compare, "a bigint, b bigint"), "block-links")
    ws.drop("blocks-sets", "full", "each")
    return links


def _verify(df, ws, pairs, signed, rep, text, size, need, of, miss, n_hashes) -> DataFrame:
    """The pairs (a, b) that are similar: first by signatures, then by full shingle sets."""
    threshold = need / of
    s = signed.select("rid", "sig")
    one = pairs.join(s.select(F.col("rid").alias("a"), F.col("sig").alias("sa")), "a")
    one = ws.write(one, "sa")
    two = one.join(s.select(F.col("rid").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def compare():
        def run(r):
            if not r["a"]:
                return {"a": [], "b": []}
            x, y = (np.frombuffer(b"".join(r[c]), np.uint32).reshape(-1, n_hashes) for c in ("sa", "sb"))
            ok = plausible(x, y, threshold, BATCH, miss).tolist()
            return {c: [v for v, k in zip(r[c], ok, strict=True) if k] for c in ("a", "b")}

        return run

    alive = ws.write(map_rows(two, compare, "a bigint, b bigint"), "alive")
    ws.drop("sa")
    full = _sets(df, ws, "pairs", alive.select(F.col("a").alias("rep")).union(alive.select(F.col("b").alias("rep"))), rep, text, size)
    one = ws.write(alive.join(full.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a"), "fa")
    two = one.join(full.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def confirm():
        def run(r):
            ok = [similar(p, q, need, of) for p, q in zip(r["sa"], r["sb"], strict=True)]
            return {c: [v for v, k in zip(r[c], ok, strict=True) if k] for c in ("a", "b")}

        return run

    links = ws.write(map_rows(two, confirm, "a bigint, b bigint"), "links")
    ws.drop("alive", "pairs-sets", "fa")
    return links
