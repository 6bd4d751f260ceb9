"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

The parts of all pre-tokens at hand form linked lists over one run of bytes. Every adjacent pair that has a merge rank
waits in the bucket of that rank; a two-level bitmap (a word of 2^k bits for each 2^k ranks, and one word that marks the
words in use) marks the buckets that hold something, so that find-first-set on two words names the lowest waiting rank. A
bucket's positions are merged from the left; one whose pair has changed meanwhile is stale and skipped. A pre-token of n
bytes takes n log n steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from lexmill.llm import pretokenize
from lexmill.llm.common import held, map_rows
from lexmill.llm.piece_ids import PieceIds
from lexmill.llm.pretokenize import pretokenizer


class BytePairCodec:
    """Encodes and decodes by a file of base64 tokens and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, pretokenizer(pattern)
        self.shift = max(1, (max(ranks.values(), default=0).bit_length() + 1) // 2)
        self.mask = (1 << self.shift) - 1
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.byte_rank = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self.pair_rank = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.by_pieces = PieceIds(self._arrays) if pattern == pretokenize.PATTERN else None

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each non-empty pre-token: lowest rank first, leftmost first among equal ranks."""
        get, shift, mask = self.ranks.get, self.shift, self.mask
        data = b"".join(pieces)
        n = len(data)
        starts = np.cumsum([0] + [len(p) for p in pieces])
        first = np.zeros(n + 1, bool)
        first[starts] = True
        codes = np.frombuffer(data, np.uint8).astype(np.int64)
        pair = np.full(n, -1, np.int64)  # rank of the pair that starts at a position
        pair[:-1] = self.pair_rank[codes[:-1] << 8 | codes[1:]]
        pair[first[1:]] = -1
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        values, at = np.unique(pair[order], return_index=True)
        buckets = {r: part.tolist() for r, part in zip(values.tolist(), np.split(order, at[1:]), strict=True)} if len(order) else {}
        words: dict[int, int] = {}
        for r in buckets:
            words[r >> shift] = words.get(r >> shift, 0) | 1 << (r & mask)
        top = sum(1 << a for a in words)
        token, waiting = self.byte_rank[codes].tolist(), pair.tolist()
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in starts[:-1].tolist():
            before[i] = -1
        edge = first.tolist()
        while top:
            a = (top & -top).bit_length() - 1
            word = words[a]
            rank = a << shift | (word & -word).bit_length() - 1
            words[a] = word = word & (word - 1)
            if not word:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            for at, i in enumerate(bucket):
                if waiting[i] != rank:
                    continue  # stale
                j = end[i]
                token[i] = rank
                waiting[j] = -1
                end[i] = k = end[j]
                low = rank
                if edge[k]:
                    waiting[i] = -1
                else:
                    before[k] = i
                    waiting[i] = r = get(data[i : end[k]], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            words[r >> shift] = words.get(r >> shift, 0) | 1 << (r & mask)
                            top |= 1 << (r >> shift)
                        low = min(low, r)
                h = before[i]
                if h >= 0:
                    waiting[h] = r = get(data[h:k], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            buckets[r] = [h]
                            words[r >> shift] = words.get(r >> shift, 0) | 1 << (r & mask)
                            top |= 1 << (r >> shift)
                        low = min(low, r)
                if low < rank and at + 1 < len(bucket):  # the rest waits until the lower rank is done
                    buckets[rank] = bucket[at + 1 :]
                    words[rank >> shift] = words.get(rank >> shift, 0) | 1 << (rank & mask)
                    top |= 1 << (rank >> shift)
                    break
        out, bounds = [], starts.tolist()
        for p, i, stop in zip(pieces, bounds, bounds[1:], strict=False):
            if (r := get(p)) is not None:
                out.append((r,))
                continue
            ids = []
            while i < stop:
                ids.append(token[i])
                i = end[i]
            out.append(tuple(ids))
        return out

    def _arrays(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.encode_pieces([p.encode() for p in pieces])]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; pre-tokens not seen lately are encoded together."""
        unsure = pretokenize.unsure().search
        plain = [k for k, t in enumerate(texts) if t and self.by_pieces and not unsure(t)]
        out: list[list[int]] = [[] for _ in texts]
        if plain:
            for k, ids in zip(plain, self.by_pieces.encode_all([texts[k] for k in plain]), strict=True):
                out[k] = ids.tolist()
        aside = set(plain)
        rest = [k for k, t in enumerate(texts) if t and k not in aside]
        found = [self.find(texts[k]) for k in rest]
        pieces = list(set(chain.from_iterable(found)))
        known = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces]), strict=True))
        for k, x in zip(rest, found, strict=True):
            out[k] = list(chain.from_iterable(map(known.__getitem__, x)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a file, one for each Python worker."""
    return held(("bpe", path, pattern), lambda: BytePairCodec.load(path, pattern))


#: Outputs of roundtrip(), with their types.
OUTPUTS = {
    "ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string",
}


def roundtrip(
    df: DataFrame,
    vocab: str,
    pattern: str,
    keys: list[str],
    text: str = "text",
    outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded"),
) -> DataFrame:
    """Encodes a text column and decodes the ids again, row by row and without a shuffle.

    Returns the key columns and the outputs asked for (see OUTPUTS). A null or empty text has no ids; rows that repeat stay
    as many; an empty table gives an empty one. Texts of any length are encoded whole. Columns of df that aren't named
    don't matter.
    """
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"{o} {OUTPUTS[o]}" for o in outputs])
    narrow = df.select(*keys, df[text].alias("__text"))

    def make():
        c = codec(vocab, pattern)
        decimal = c.decimal

        def run(rows):
            out = {k: rows[k] for k in keys} | {o: [] for o in outputs}
            for ids in c.encode_all(rows["__text"]):
                if "ids" in out:
                    out["ids"].append(ids)
                if "n_tokens" in out:
                    out["n_tokens"].append(len(ids))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                if "decoded" in out or "decoded_sha256" in out:
                    back = c.decode(ids)
                    if "decoded" in out:
                        out["decoded"].append(back)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            return out

        return run

    return map_rows(narrow, make, schema)
