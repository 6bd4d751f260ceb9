"""Prefix trie of conversations from mergeable partial tries.

Turns are dealt out by ranges of (conversation, place), so that a conversation of any length may lie in several partitions.
A node is known by a hash of the turns that lead to it. The hash is a polynomial in the turns' digests, modulo 2^61 - 1 and
at two bases: hashes of neighbouring stretches combine, so that each partition hashes what it has and a table with a row for
each partition gives the rest. Every partition combines its stretch to a partial trie: a table of nodes with members counted
and a list of the conversations that end there. Partial tries are merged by node in a tree of fixed fan-in. Sums over subtrees
are rolled up from the bottom by doubled distances: after round k a node holds the sum of what is less than 2^k below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import Workspace

#: Fixed for the life of a table: the modulus and two bases of the path hashes.
MOD, BASES = (1 << 61) - 1, (0x1B873593CC9E2D51, 0x0A54F53A5F1D36F1)
#: Partial tries merged at a time; nodes, or ends, that a task holds before it gives them out.
FAN_IN, MOST_HELD = 64, 200_000

#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"


def turn_columns(role: str = "role", text: str = "text") -> list[Column]:
    """digest (16 bytes of role and text) and words (of the text) of a turn; a null role or text counts as an empty one."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    return [digest.alias("digest"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words")]


_LOCAL = "part int, seq long, conv long, d long, p1 long, p2 long, q1 long, q2 long, digest binary, words long, last boolean"


def _stretches(df: DataFrame, ws: Workspace, name: str, order: list[Column]) -> tuple[DataFrame, dict[int, tuple]]:
    """Rows (conv, digest, words) in the given order within conv, written by ranges with what each partition knows alone.

    d counts a conversation's rows within a partition, p1 and p2 hash them, q1 and q2 without the last; a row without a digest
    is hashed as nothing. last tells whether no other row of the conversation follows in the partition. The second result has
    for a partition what comes before it of the conversation that it begins with, and whether its last one goes on after it:
    {part: (conv, d, p1, p2, goes on)}.
    """
    salted = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))  # it only deals out rows that are equal
    dealt = salted.repartitionByRange(F.col("conv"), *order, F.col("__salt")).sortWithinPartitions(F.col("conv"), *order).select("conv", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, (b1, b2) = TaskContext.get().partitionId(), 0, BASES
        conv, d, p1, p2, held = None, 0, 0, 0, None
        for batch in batches:
            out = []
            for c, t, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held is not None:
                    out.append((*held, c != conv))
                if c != conv:
                    conv, d, p1, p2 = c, 0, 0, 0
                q1, q2 = p1, p2
                if t is not None:
                    x = int.from_bytes(t, "little")
                    p1, p2, d = (p1 * b1 + x + 1) % MOD, (p2 * b2 + (x >> 61) + 1) % MOD, d + 1
                held = (part, seq, c, d, p1, p2, q1, q2, t, w)
                seq += 1
            if out:
                yield _batch(out)
        if held is not None:
            yield _batch([(*held, True)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = [x.split()[0] for x in _LOCAL.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in _LOCAL.split(", ")]
    rows = ws.write(dealt.mapInArrow(run, _LOCAL), name)
    at_end = F.max_by(F.struct("conv", "d", "p1", "p2"), "seq").alias("end")
    ends = sorted(rows.groupBy("part").agg(F.min_by("conv", "seq").alias("first"), at_end).collect(), key=lambda r: r["part"])
    before: dict[int, tuple] = {}
    carried = (None, 0, 0, 0)
    for i, r in enumerate(ends):
        conv, d, p1, p2 = r["end"]
        had = carried if carried[0] == r["first"] else (None, 0, 0, 0)
        goes_on = i + 1 < len(ends) and ends[i + 1]["first"] == conv
        before[r["part"]] = (*had, goes_on)
        carried = (conv, *_joined(had[1:], d, p1, p2)) if had[0] == conv else (conv, d, p1, p2)
    return rows, before


def _joined(had: tuple[int, int, int], d: int, p1: int, p2: int) -> tuple[int, int, int]:
    """Length and hashes of a stretch that follows another."""
    n, h1, h2 = had
    return n + d, (h1 * pow(BASES[0], d, MOD) + p1) % MOD, (h2 * pow(BASES[1], d, MOD) + p2) % MOD


def placed(df: DataFrame, ws: Workspace, name: str, order: list[Column]) -> DataFrame:
    """(conv, place, digest, words): the rows of df numbered from 1 in the given order within conv. A conversation may be
    larger than a task: it is numbered by stretches."""
    rows, before = _stretches(df, ws, name, order)
    some = [(k, v[0], v[1]) for k, v in before.items() if v[0] is not None]
    had = df.sparkSession.createDataFrame(some, "part int, __c long, __n long")
    more = F.when(F.col("conv") == F.col("__c"), F.col("__n")).otherwise(0)
    return rows.join(F.broadcast(had), "part", "left").select("conv", (F.col("d") + more).alias("place"), "digest", "words")


_PARTIAL = "part int, kind int, k1 long, k2 long, depth long, q1 long, q2 long, n long, conv long, words long, ids binary"


def _partial(rows: DataFrame, before: dict[int, tuple]) -> DataFrame:
    """Partial tries: of each partition its nodes (kind 0) with members counted, and lists of ends (kind 1) in order."""
    sent = rows.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, had = sent.value, None, (None, 0, 0, 0, False)
        nodes: dict[tuple, list] = {}
        ends: dict[tuple, list] = {}
        n_ends = 0
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for p, c, d, p1, p2, q1, q2, t, w, last, at_end in zip(
                *(cols[x] for x in ("part", "conv", "d", "p1", "p2", "q1", "q2", "digest", "words", "last", "at_end")), strict=True
            ):
                if p != part or len(nodes) >= MOST_HELD or n_ends >= MOST_HELD:
                    yield from given(part, nodes, ends)
                    nodes, ends, n_ends, part, had = {}, {}, 0, p, known[p]
                if had[0] == c:
                    q = _joined(had[1:4], d - 1, q1, q2)[1:] if t is not None else None
                    d, p1, p2 = _joined(had[1:4], d, p1, p2)
                    q1, q2 = q or (p1, p2)
                node = nodes.get((p1, p2))
                if node is None:
                    nodes[p1, p2] = [d, q1 if d else None, q2 if d else None, 1, c, w]
                else:
                    node[3] += 1
                    node[4] = min(node[4], c)
                if last and not (at_end and had[4]):
                    ends.setdefault((p1, p2), []).append(c)
                    n_ends += 1
        yield from given(part, nodes, ends)

    def given(part: int | None, nodes: dict, ends: dict) -> Iterator[pa.RecordBatch]:
        if nodes:
            k, v = list(zip(*nodes, strict=True)), list(zip(*nodes.values(), strict=True))
            none = [None] * len(nodes)
            yield _arrow([[part] * len(nodes), [0] * len(nodes), k[0], k[1], *v, none])
        if ends:
            k, ids = list(zip(*ends, strict=True)), [sorted(x) for x in ends.values()]
            none = [None] * len(ends)
            text = [",".join(map(str, x)).encode() for x in ids]
            yield _arrow([[part] * len(ends), [1] * len(ends), k[0], k[1], none, none, none, none, [x[0] for x in ids], none, text])

    def _arrow(cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, types, strict=True)], names)

    names = [x.split()[0] for x in _PARTIAL.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _PARTIAL.split(", ")]
    final = rows.groupBy("part").agg(F.max("seq").alias("__top"))
    return rows.join(F.broadcast(final), "part").withColumn("at_end", F.col("seq") == F.col("__top")).mapInArrow(run, _PARTIAL)


def _merged(partial: DataFrame, parts: int) -> DataFrame:
    """The nodes of all partial tries: FAN_IN of them are merged by node at a time, then what came of it, until one is left."""
    level = partial.where("kind = 0").withColumn("part", F.col("part").cast("long"))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        group = F.floor(F.col("part") / FAN_IN).alias("part") if parts > 1 else F.lit(0).cast("long").alias("part")
        same = [F.first(x).alias(x) for x in ("depth", "q1", "q2", "words")]
        level = level.groupBy("k1", "k2", group).agg(*same, F.sum("n").alias("n"), F.min("conv").alias("conv"))
    if "kind" in level.columns:  # a single task may have given a node out more than once
        same = [F.first(x).alias(x) for x in ("depth", "q1", "q2", "words")]
        level = level.groupBy("k1", "k2").agg(*same, F.sum("n").alias("n"), F.min("conv").alias("conv"))
    return level.select("k1", "k2", "depth", "q1", "q2", "n", "conv", "words")


def _end_hashes(partial: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256, n_ends): SHA-256 of the conversations that end at a node, ascending, comma-joined.

    The lists come in order a piece at a time, so that a node where any number of conversations ends costs no memory.
    """
    pieces = partial.where("kind = 1").select("k1", "k2", "conv", "ids")
    pieces = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, n = None, None, 0
        for batch in batches:
            out = []
            for k1, k2, _, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (k1, k2) == at:
                    h.update(b",")
                else:
                    if at:
                        out.append((*at, h.hexdigest(), n))
                    at, h, n = (k1, k2), hashlib.sha256(), 0
                h.update(ids)
                n += ids.count(b",") + 1
            if out:
                yield _rows(out)
        if at:
            yield _rows([(*at, h.hexdigest(), n)])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), types, strict=True)], ["k1", "k2", "ends_sha256", "n_ends"])

    return pieces.mapInArrow(run, "k1 long, k2 long, ends_sha256 string, n_ends long")


def _rolled_up(shared: DataFrame, ws: Workspace) -> DataFrame:
    """(k1, k2, leaves, saved) summed over the subtrees of nodes (k1, k2, depth, q1, q2, leaves, saved), parents among them.

    Rounds number about the logarithm of the depth. Round k adds to each node the sums of those 2^k below it and doubles the
    distance to the ancestor that a node knows. Sums meet by a partial aggregation, so that a node with very many children is
    no burden.
    """
    now = ws.write(shared.select("k1", "k2", "depth", F.col("q1").alias("a1"), F.col("q2").alias("a2"), "leaves", "saved"), "up0")
    deepest = now.agg(F.max("depth")).first()[0] or 0
    reach, k = 1, 0
    while reach <= deepest:
        up = now.where("a1 is not null").groupBy("a1", "a2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        up = up.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "leaves", "saved")
        of = now.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        far = now.where(F.col("depth") >= 2 * reach).select("k1", "k2", "a1", "a2").join(of, ["a1", "a2"])
        far = far.select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"))
        own = now.select("k1", "k2", "depth", "leaves", "saved")
        every = own.unionByName(up, allowMissingColumns=True).unionByName(far, allowMissingColumns=True)
        sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("leaves", "saved")]
        now = ws.write(every.groupBy("k1", "k2").agg(F.max("depth").alias("depth"), F.max("a1").alias("a1"), F.max("a2").alias("a2"), *sums), f"up{k + 1}")
        ws.drop(f"up{k}")
        reach, k = 2 * reach, k + 1
    return now.select("k1", "k2", "leaves", "saved")


def trie(df: DataFrame, ws: Workspace, order: list[Column]) -> DataFrame:
    """A row for each node of the trie of conversations.

    df has (conv long, digest, words) for each turn, in the given order within conv, and for every conversation one row without
    a digest that comes first: it stands for the root, so that conversations without turns are members of it. Other columns
    of df may be part of the order. Rows that repeat are turns that repeat. An empty df has no nodes, not even a root.

    Columns: k1, k2 (the node), depth, conv_id (smallest member), parent_conv_id (null at the root), n_convs, n_children,
    n_leaves (nodes without children in the subtree, itself included), saved_tokens (over the subtree, members beyond the first
    times the words of the last turn), n_ends and ends_sha256 (conversations that end there, ascending, comma-joined).
    """
    rows, before = _stretches(df, ws, "rows", order)
    partial = ws.write(_partial(rows, before), "partial")
    nodes = ws.write(_merged(partial, max(before, default=0) + 1), "nodes")
    least = nodes.agg(F.min("conv")).first()[0]
    single = F.sum((F.col("n") == 1).cast("long"))
    kids = nodes.where("depth > 0").groupBy("q1", "q2").agg(F.count("*").alias("n_children"), single.alias("single"))
    kids = ws.write(kids.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), "n_children", "single"), "kids")
    # a node with one member has one leaf below it and nothing to save, so only nodes with more are rolled up
    shared = nodes.where("n > 1").join(kids, ["k1", "k2"], "left")
    leaves = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("single")).cast("long")
    saved = ((F.col("n") - 1) * F.col("words")).cast("long")
    sums = _rolled_up(shared.select("k1", "k2", "depth", "q1", "q2", leaves.alias("leaves"), saved.alias("saved")), ws)
    # the parent of depth 1 is the root, which needs no join; other hot parents are split by adaptive execution
    deep = nodes.where("depth > 1").select("k1", "k2", "q1", "q2")
    parents = deep.join(nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv").alias("up")), ["q1", "q2"]).select("k1", "k2", "up")
    out = nodes.join(kids.select("k1", "k2", "n_children"), ["k1", "k2"], "left").join(sums, ["k1", "k2"], "left")
    out = out.join(_end_hashes(partial), ["k1", "k2"], "left").join(parents, ["k1", "k2"], "left")
    return out.select(
        "k1", "k2", "depth",
        F.col("conv").alias("conv_id"),
        F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("up")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
