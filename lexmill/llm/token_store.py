"""Content-addressed store of token ids.

A document's id stream is cut into chunks where a rolling hash of its last ids meets a condition, so that equal passages give
equal chunks wherever they stand. A chunk is stored once, under the digest of its ids. A document's recipe lists its chunks; a
Merkle tree over them gives the document's root, and one over the roots of each recipe part stands in the manifest. Chunks,
recipes and manifest are Parquet tables below one path.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import pretokenize
from lexmill.llm.common import blocks, held, map_rows
from lexmill.llm.piece_ids import PieceIds
from lexmill.session import Workspace

#: Least and largest chunk in ids, and the mean distance of cuts beyond the least; ids that the rolling hash covers, a power of 2.
MIN_CHUNK, MAX_CHUNK, MEAN_CHUNK, WINDOW = 128, 2048, 512, 16
#: Pre-tokens that the library gets at a time, with an added token between them.
TOGETHER = 500


class Encoder:
    """A tokenizer of the tokenizers library, with the ids of pre-tokens seen lately.

    Pre-tokens are encoded independently of each other by a byte-level BPE, so a text's ids are those of its pre-tokens in a
    row; the library encodes each pre-token. The library gets whole texts where another pattern than the known one is given, and those that hold an added
    token or characters of uncertain class.
    """

    def __init__(self, path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)).search if added else lambda t: None
        plain = [(k, x.content) for k, x in self.tokenizer.get_added_tokens_decoder().items() if not (x.single_word or x.lstrip or x.rstrip or x.normalized)]
        self.between = plain[0] if plain else None
        self.known = pattern == pretokenize.PATTERN
        self.by_pieces = PieceIds(self._pieces) if self.known else None

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of pieces without added tokens: many go to the library as one text, with an added token between them."""
        if not self.between or len(pieces) < 2:
            return self._library(pieces)
        mark, text = self.between
        out = []
        for at in range(0, len(pieces), TOGETHER):
            [ids] = self._library([text.join(pieces[at : at + TOGETHER])])
            begin = 0
            for end in [*np.flatnonzero(ids == mark).tolist(), len(ids)]:
                out.append(ids[begin:end])
                begin = end + 1
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        unsure = pretokenize.unsure().search
        whole = [k for k, t in enumerate(texts) if t and (not self.known or self.added(t) or unsure(t))]
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        for k, ids in zip(whole, self._library([texts[k] for k in whole]), strict=True):
            out[k] = ids
        aside = set(whole)
        mine = [k for k, t in enumerate(texts) if t and k not in aside]
        if mine:
            for k, ids in zip(mine, self.by_pieces.encode_all([texts[k] for k in mine]), strict=True):
                out[k] = ids
        return out


def encoder(path: str, pattern: str | None) -> Encoder:
    """The encoder of a file, one for each Python worker."""
    return held(("tokens", path, pattern), lambda: Encoder(path, pattern))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    with np.errstate(over="ignore"):
        h, p, reach = ids.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
        while reach < WINDOW:  # of `reach` ids each, then of twice as many
            h = h[:-reach] * np.uint64(p) + h[reach:]
            p, reach = p * p & (1 << 64) - 1, 2 * reach
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    ends = np.flatnonzero(h >> np.uint64(64 - MEAN_CHUNK.bit_length() + 1) == 0) + WINDOW
    out, at = [], 0
    for e in ends.tolist():
        while e - at > MAX_CHUNK:
            at += MAX_CHUNK
            out.append(at)
        if e - at >= MIN_CHUNK:
            at = e
            out.append(at)
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        out.append(at)
    if at < n:
        out.append(n)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.sha256(b"\0" + data).digest()[:16]


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree over leaves; an odd node goes up as it is. No leaves have a root of their own."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest()[:16] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def pack(ids: np.ndarray) -> bytes:
    """Ids as little-endian numbers of two bytes where they fit, else four, compressed; the first byte tells which."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if small else b"\4") + _zstd()[0](ids.astype("<u2" if small else "<u4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1](data[1:]), "<u2" if data[:1] == b"\2" else "<u4").astype("<u4")


@cache
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress


class Store:
    """A written store: tables chunks, recipes and manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks", "d binary, n int, data binary")

    @property
    def recipes(self) -> DataFrame:
        return self._read("recipes", "id bigint, part bigint, at bigint, start bigint, n bigint, root binary, chunks array<struct<d:binary,n:int>>")

    @property
    def manifest(self) -> DataFrame:
        return self._read("manifest", "part bigint, first bigint, rows bigint, tokens bigint, root binary")


def write(
    df: DataFrame, path: str, tokenizer: str, pattern: str | None, text: str = "text", id_col: str = "doc_id", end_id: int | None = 2
) -> Store:
    """Encodes a text column and writes a store below path; documents stand in ascending order of the id column.

    Each document's ids end with end_id, unless that is None. A null or empty text has no other ids. Rows that repeat an id
    follow each other in an order that their chunks fix; null ids come first. Texts count whole.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "tokens")
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    schema = "id bigint, n bigint, chunks array<struct<d:binary,n:int>>, data array<binary>"

    def make():
        enc = encoder(tokenizer, pattern)
        seen: set[bytes] = set()  # a task's chunks go out once; a split bounds their number

        def run(r):
            out = {"id": r["id"], "n": [], "chunks": [], "data": []}
            for a in enc.encode_all(r["t"]):
                if end_id is not None:
                    a = np.append(a, np.uint32(end_id))
                at, recipe, data = 0, [], []
                for e in cuts(a):
                    part = a[at:e]
                    d = digest(part.astype("<u4", copy=False).tobytes())
                    recipe.append({"d": d, "n": e - at})
                    data.append(None if d in seen else pack(part))
                    seen.add(d)
                    at = e
                out["n"].append(len(a))
                out["chunks"].append(recipe)
                out["data"].append(data)
            return out

        return run

    staged = ws.write(map_rows(narrow, make, schema), "staged", "none")
    each = staged.select(F.explode(F.arrays_zip("chunks", "data")).alias("c")).select("c.chunks.d", "c.chunks.n", "c.data").where("data is not null")
    each.dropDuplicates(["d"]).write.option("compression", "none").parquet(f"{path}/chunks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for b in batches:
            for part in blocks(b):
                n = part.column("n").to_numpy()
                ends = start + np.cumsum(n)
                roots = [merkle([c["d"] for c in x]) for x in part.column("chunks").to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "start": pa.array(ends - n), "n": part.column("n"), "root": pa.array(roots, pa.binary()), "chunks": part.column("chunks")})
                start = int(ends[-1])

    ordered = staged.select("id", "n", "chunks").repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("chunks"))
    placed = ordered.mapInArrow(place, "id bigint, start bigint, n bigint, root binary, chunks array<struct<d:binary,n:int>>")
    row = F.monotonically_increasing_id()
    placed = placed.select("id", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("at"), "start", "n", "root", "chunks")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    ws.drop("staged")
    store = Store(spark, path)
    _part_roots(store.recipes).write.parquet(f"{path}/manifest")
    return store


def _part_roots(recipes: DataFrame) -> DataFrame:
    """A row for each part of the recipes: tokens before it, its rows and tokens, and the Merkle root over its documents' roots in order.

    Files hold whole parts in order, or runs of a part; runs are summed up by tree nodes of 1,024 documents each.
    """
    nodes = recipes.select("part", F.floor(F.col("at") / 1024).alias("k"), "at", "root", "n")
    nodes = nodes.groupBy("part", "k").agg(F.array_sort(F.collect_list(F.struct("at", "root"))).alias("r"), F.sum("n").alias("n"), F.count("*").alias("c"))
    nodes = nodes.select("part", "k", "n", "c", F.sha2(F.aggregate("r", F.lit(b""), lambda s, x: F.concat(s, x["root"])), 256).alias("h"))
    parts = nodes.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("h"), F.sum("c").alias("rows"), F.sum("n").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    return parts.select("part", before.cast("long").alias("first"), "rows", "tokens", F.unhex(F.sha2(F.array_join("h.h", ""), 256)).alias("root"))


# crc32 of joined data from crc32s of its parts: multiplication by x^(8 n) modulo the polynomial
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


@cache
def _shift(n: int) -> int:
    """x^(8 n) modulo the polynomial."""
    out, base, n = 0x80000000, 0x00800000, n
    while n:
        if n & 1:
            out = _times(base, out)
        base = _times(base, base)
        n >>= 1
    return out


def crc_joined(first: int, second: int, second_bytes: int) -> int:
    return _times(_shift(second_bytes), first) ^ second


def read_back(store: Store) -> DataFrame:
    """(id, start, n, crc) of every document, from the store's files; raises where they don't fit together.

    Every chunk is unpacked and held against its digest; every document's root is made again from its chunks' digests; every
    part's root is held against the manifest. start counts the ids of all documents before it; crc is the crc32 of the
    document's ids as little-endian numbers of four bytes, joined from those of its chunks.
    """
    spark = store.spark
    ws = Workspace(spark, "tokens-read")
    told = {r["part"]: r for r in store.manifest.collect()}  # a row for each part
    found = _part_roots(store.recipes).collect()
    if {r["part"]: (r["rows"], r["tokens"], r["root"]) for r in found} != {k: (r["rows"], r["tokens"], r["root"]) for k, r in told.items()}:
        raise ValueError("the recipes differ from the manifest")
    total, base = 0, []
    for part in sorted(told):
        base.append((part, total))
        total += told[part]["tokens"]

    def check():
        def run(r):
            crc = []
            for d, n, data in zip(r["d"], r["n"], r["data"], strict=True):
                raw = unpack(data).tobytes()
                if digest(raw) != d or len(raw) != 4 * n:
                    raise ValueError(f"chunk {d.hex()} doesn't match its digest")
                crc.append(zlib.crc32(raw))
            return {"d": r["d"], "crc": crc}

        return run

    sums = ws.write(map_rows(store.chunks, check, "d binary, crc bigint"), "sums")
    recipes = store.recipes
    each = recipes.select("part", "at", F.posexplode("chunks").alias("k", "c")).select("part", "at", "k", "c.d", "c.n")
    got = ws.write(each.join(sums, "d", "left").select("part", "at", "k", "n", "crc", "d"), "found")
    got = got.groupBy("part", "at").agg(F.array_sort(F.collect_list(F.struct("k", "n", "crc", "d"))).alias("c"))

    def join():
        def run(r):
            crcs, roots = [], []
            for c in r["c"]:
                crc = 0
                for x in c:
                    if x["crc"] is None:
                        raise ValueError(f"chunk {x['d'].hex()} is missing")
                    crc = crc_joined(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
                roots.append(merkle([x["d"] for x in c]))
            return {"part": r["part"], "at": r["at"], "crc": crcs, "made": roots}

        return run

    got = map_rows(got, join, "part bigint, at bigint, crc bigint, made binary")
    offsets = F.broadcast(spark.createDataFrame(base, "part bigint, base bigint"))
    out = recipes.select("id", "part", "at", "start", "n", "root").join(offsets, "part").join(got, ["part", "at"], "left")
    crc = F.coalesce("crc", F.when(F.col("n") == 0, F.lit(0)))
    fits = (F.col("n") == 0) | F.coalesce(F.col("made") == F.col("root"), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("document doesn't match its root: "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return out.select("id", (F.col("start") + F.col("base")).alias("start"), "n", F.when(fits, crc).otherwise(bad).alias("crc"))


def reconstruct(store: Store, wanted: DataFrame) -> DataFrame:
    """(id, ids) of the documents whose ids `wanted` (column id) lists, put together from chunks.

    Every chunk is held against its digest and every document's chunks against its root; a chunk that is missing or altered is
    an error, never a shorter document. A document without ids has none; an id that the store lacks has no row.
    """
    each = store.recipes.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "part", "at", "root", F.posexplode_outer("chunks").alias("k", "c"))
    got = each.select("id", "part", "at", "root", "k", "c.d").join(store.chunks.select("d", "data"), "d", "left")
    got = got.groupBy("id", "part", "at").agg(F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("k", "d", "data"))).alias("c"))

    def make():
        def whole(k, root: bytes, chunks: list) -> list[int]:
            parts, digests = [np.empty(0, "<u4")], []
            for x in chunks:
                if x["d"] is None:  # a document without ids
                    continue
                if x["data"] is None:
                    raise ValueError(f"chunk {x['d'].hex()} of document {k} is missing")
                ids = unpack(x["data"])
                if digest(ids.tobytes()) != x["d"]:
                    raise ValueError(f"chunk {x['d'].hex()} of document {k} doesn't match its digest")
                parts.append(ids)
                digests.append(x["d"])
            if digests and merkle(digests) != root:
                raise ValueError(f"document {k} doesn't match its root")
            return np.concatenate(parts).astype(np.int64).tolist()

        return lambda r: {"id": r["id"], "ids": [whole(*x) for x in zip(r["id"], r["root"], r["c"], strict=True)]}

    return map_rows(got.select("id", "root", "c"), make, "id bigint, ids array<bigint>")
