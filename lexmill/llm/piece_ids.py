"""Ids of a text by those of its pre-tokens, which a worker remembers in flat arrays.

Pre-tokens are found and looked up for a block of texts at a time, without a Python object for each; only new ones are handed to
an encoder. Equal ones are known by a hash, their length, and their first and last characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

from lexmill.llm import pretokenize

#: Pre-tokens whose ids a worker remembers, their ids in all, the longest pre-token, and code points that are looked up at a time.
MEMO_SIZE, MEMO_IDS, MEMO_CHARS, SPAN = 1_500_000, 1 << 23, 64, 1 << 20


class Memo:
    """Ids of pre-tokens by a 64-bit hash, in flat arrays: open addressing with room for MEMO_SIZE entries and a span's more."""

    def __init__(self, bits: int = 22):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.room = MEMO_SIZE + SPAN
        self.key, self.slot = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.start, self.count, self.mark = np.zeros(self.room, np.int64), np.zeros(self.room, np.int32), np.zeros(self.room, np.uint64)
        self.ids, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0

    def clear(self) -> None:
        self.key[:] = 0
        self.used = self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        at = (h >> self.shift).astype(np.int64)
        while len(left):
            k = self.key[at]
            hit = k == h[left]
            out[left[hit]] = self.slot[at[hit]]
            go = ~hit & (k != 0)
            left, at = left[go], (at[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, mark: np.ndarray, made: list[np.ndarray], keyed: bool = True) -> np.ndarray:
        """Entries for hashes that differ and have none; without a key they won't be found again."""
        counts, ids = np.array([len(x) for x in made], np.int64), np.concatenate(made)
        new = np.arange(self.n, self.n + len(h), dtype=np.int32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, 2 * len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[new] = self.used + np.cumsum(counts) - counts
        self.count[new], self.mark[new] = counts, mark
        self.used += len(ids)
        self.n += len(h)
        left = np.arange(len(h) if keyed else 0)
        at = (h[left] >> self.shift).astype(np.int64)
        while len(left):
            free = self.key[at] == 0
            self.key[at[free]] = h[left[free]]  # of several that go to one place the last stays
            mine = free & (self.key[at] == h[left])
            self.slot[at[mine]] = new[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & self.mask
        return new


@cache
def _mixers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each character, and powers of an odd number and of its inverse."""
    base = 0x9E3779B97F4A7C15
    rng = np.random.default_rng(4)
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.full(SPAN + MEMO_CHARS + 1, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
    return rng.integers(1, 1 << 64, 0x10000, np.uint64), up, down


def hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash other than 0 of each piece codes[start:end]; equal pieces have equal ones."""
    table, up, down = _mixers()
    with np.errstate(over="ignore"):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[codes] * up[: len(codes)])])
        h = (upto[end] - upto[start]) * down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h | np.uint64(1)


class PieceIds:
    """Encodes texts by pretokenize.PATTERN; encode gives the ids of pre-tokens that aren't remembered."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]]):
        self.encode, self.memo = encode, Memo()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; none is empty, none has characters of uncertain class."""
        joined = "\0".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        start = pretokenize.starts(codes, ends)
        end = np.append(start[1:], len(codes))
        mark = np.zeros(len(codes), bool)
        mark[ends] = True
        piece = ~mark[start]
        start, end = start[piece], end[piece]
        got: list[np.ndarray] = []
        counts = np.zeros(len(start), np.int64)
        at = 0
        while at < len(start):  # spans of bounded length, a longer piece alone
            to = max(at + 1, int(np.searchsorted(end, start[at] + SPAN, "right")))
            n, ids = self._span(joined, codes, start[at:to], end[at:to])
            counts[at:to] = n
            got.append(ids)
            at = to
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = np.concatenate([np.empty(0, np.uint32), *got]).astype("<u4", copy=False)
        first = upto[np.searchsorted(start, np.concatenate([[0], ends[:-1] + 1]))].tolist()
        return [ids[a:b] for a, b in zip(first, [*first[1:], len(ids)], strict=True)]

    def _span(self, joined: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids."""
        size = end - start
        if len(start) == 1 and size[0] > MEMO_CHARS:
            return self._plainly(joined, start, end)
        base = int(start[0])
        h = hashes(codes[base : int(end[-1])], start - base, end - base)
        mark = codes[start].astype(np.uint64) << np.uint64(32) | codes[end - 1].astype(np.uint64) << np.uint64(16) | size.astype(np.uint64)
        memo = self.memo
        if memo.n > MEMO_SIZE or memo.used > MEMO_IDS:
            memo.clear()

        def made(at: np.ndarray) -> list[np.ndarray]:
            return self.encode([joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])

        slot = memo.find(h)
        long = size > MEMO_CHARS
        holes = np.flatnonzero((slot < 0) & ~long)
        if len(holes):
            _, first, which = np.unique(h[holes], return_index=True, return_inverse=True)
            new = holes[first]
            slot[holes] = memo.add(h[new], mark[new], made(new))[which]
        if long.any():
            at = np.flatnonzero(long)
            slot[at] = memo.add(h[at], mark[at], made(at), keyed=False)
        if (memo.mark[slot] != mark).any():  # two pieces with one hash
            return self._plainly(joined, start, end)
        n = memo.count[slot].astype(np.int64)
        upto = np.cumsum(n)
        place = np.arange(int(upto[-1])) + np.repeat(memo.start[slot] - (upto - n), n)
        return n, memo.ids[place]

    def _plainly(self, joined: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = [joined[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        different = list(dict.fromkeys(pieces))
        made = dict(zip(different, self.encode(different), strict=True))
        return np.array([len(made[p]) for p in pieces], np.int64), np.concatenate([made[p] for p in pieces])
