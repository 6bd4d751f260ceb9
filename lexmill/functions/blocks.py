"""Common blocks of two sequences: of one pair, and of many pairs at once."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np


class Blocks:
    """Longest common blocks of two sequences, with difflib's choice among equal ones: first in a, then first in b.

    Every stretch of 2^k items has a number, the same for equal stretches (prefix doubling); a stretch of any length is told by
    the numbers of its first and its last 2^k items. So a block is found by bisecting its length, without a table of all pairs.
    """

    #: Pairs of items up to which difflib's own way is quicker.
    SMALL = 20_000

    def __init__(self, a, b):
        self.a, self.b = a, b
        ids: dict = {}
        self.levels = [[np.array([ids.setdefault(x, len(ids)) for x in s], np.int64) for s in (a, b)]]
        self.width = len(ids) + 1

    def level(self, k: int) -> list[np.ndarray]:
        while len(self.levels) <= k:
            half = 1 << len(self.levels) - 1
            keys = [s[: max(len(s) - half, 0)] * self.width + s[half:] for s in self.levels[-1]]
            of = np.unique(np.concatenate(keys), return_inverse=True)[1]
            self.width = max(self.width, int(of.max(initial=0)) + 1)
            self.levels.append([of[: len(keys[0])], of[len(keys[0]) :]])
        return self.levels[k]

    def stretches(self, size: int, alo: int, ahi: int, blo: int, bhi: int) -> list[np.ndarray]:
        """A number for each stretch of that size in both ranges."""
        k = size.bit_length() - 1
        rest = size - (1 << k)
        return [s[lo : hi - size + 1] * self.width + s[lo + rest : hi - size + 1 + rest] for s, lo, hi in zip(self.level(k), (alo, blo), (ahi, bhi), strict=True)]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int]:
        """(i, j, size) of the longest common block of a[alo:ahi] and b[blo:bhi], which has at most `most` items."""
        low, high = 0, min(most, ahi - alo, bhi - blo)
        probe = 1
        while low < high:
            size = min(probe, high) if probe else (low + high + 1) // 2
            if np.isin(*self.stretches(size, alo, ahi, blo, bhi)).any():
                low, probe = size, probe * 2
            else:
                high, probe = size - 1, 0
        if not low:
            return alo, blo, 0
        x, y = self.stretches(low, alo, ahi, blo, bhi)
        i = int(np.isin(x, y).argmax())
        return alo + i, blo + int((y == x[i]).argmax()), low

    def matched(self) -> int:
        """Items in the blocks of Ratcliff and Obershelp: the longest one, and so on left and right of it."""
        total, todo = 0, [(0, len(self.a), 0, len(self.b), len(self.a))]
        while todo:
            alo, ahi, blo, bhi, most = todo.pop()
            if (ahi - alo) * (bhi - blo) <= self.SMALL:
                if alo < ahi and blo < bhi:
                    m = difflib.SequenceMatcher(None, self.a[alo:ahi], self.b[blo:bhi], autojunk=False)
                    total += sum(x.size for x in m.get_matching_blocks())
                continue
            i, j, size = self.longest(alo, ahi, blo, bhi, most)
            if size:
                total += size
                todo += [(alo, i, blo, j, size), (i + size, ahi, j + size, bhi, size)]
        return total


class ManyBlocks:
    """The same for many pairs at once: whole arrays take the place of a loop over pairs and blocks.

    Sequences are codes of a byte (or of two); eight (or four) items make one number, a gram. A range is a row (pair, alo, ahi,
    blo, bhi). Equal grams of k items within a range are joined and grow into segments, common stretches that can't be longer
    within the range. The longest block of a range is its longest segment; segments are then cut to what lies left and right of
    it, and so on until no segment has k items. What is left is looked at with a smaller k.
    """

    #: Least sizes of segments, one after the other; a range with too many segments begins with LONG.
    SIZES = (8, 4, 2, 1)
    LONG = 32
    #: Equal grams that are held at once; a range with more of them goes to Blocks.
    MOST = 1 << 20
    #: Places in a key of (size, place in a, place in b).
    BITS = 21

    def __init__(self, a: Sequence[np.ndarray], b: Sequence[np.ndarray]):
        """The sequences of each pair: arrays of uint8, or all of uint16."""
        self.bits = 8 * a[0].dtype.itemsize
        self.width = 64 // self.bits
        ends = [np.cumsum([len(x) for x in s]) for s in (a, b)]
        self.codes = [np.concatenate([*s, np.zeros(self.LONG + self.width, s[0].dtype)]) for s in (a, b)]
        self.grams = [self._grams(c) for c in self.codes]
        self.pairs = len(a)
        self.sizes = [k for k in self.SIZES if k <= self.width]
        lo = [np.concatenate([[0], e[:-1]]) for e in ends]
        self.ranges = np.stack([np.arange(self.pairs), lo[0], ends[0], lo[1], ends[1]]).astype(np.int64)

    def _grams(self, codes: np.ndarray) -> np.ndarray:
        g, n = codes.astype(np.uint64), self.bits
        while n < 64:
            h = g.copy()
            h[: -(n // self.bits)] |= g[n // self.bits :] << np.uint64(n)
            g, n = h, 2 * n
        return g

    def _hashes(self, side: int, places: np.ndarray, k: int) -> np.ndarray:
        """A number of the k items from each place on, the same for equal ones."""
        g = self.grams[side][places]
        if k < self.width:
            g &= np.uint64((1 << k * self.bits) - 1)
        for d in range(self.width, k, self.width):
            g ^= g >> np.uint64(32)
            g = g * np.uint64(0x9E3779B97F4A7C15) + self.grams[side][places + min(d, k - self.width)]
        return g

    def segments(self, ranges: np.ndarray, k: int) -> tuple[np.ndarray, ...] | None:
        """(range, i, j, size) of the segments of k items or more; None if too many grams are equal."""
        places, of, hashes = [], [], []
        for side, (lo, hi) in enumerate((ranges[1:3], ranges[3:5])):
            n = np.maximum(hi - lo - (k - 1), 0)
            n[(ranges[2] - ranges[1] < k) | (ranges[4] - ranges[3] < k)] = 0
            r = np.repeat(np.arange(len(n), dtype=np.int32), n)
            p = np.arange(len(r)) + np.repeat(lo - (np.cumsum(n) - n), n)
            h = self._hashes(side, p, k)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += np.repeat(np.arange(len(n), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), n)
            places.append(p), of.append(r), hashes.append(h)
        # most grams have none of their kind on the other side, and are left out before anything is sorted
        bits = min(max(len(hashes[1]).bit_length() + 3, 12), 24)
        slots = [(h >> np.uint64(64 - bits)).view(np.int64) for h in hashes]
        for a, b in ((0, 1), (1, 0)):
            seen = np.zeros(1 << bits, bool)
            seen[slots[b]] = True
            some = np.flatnonzero(seen[slots[a]])
            places[a], of[a], hashes[a], slots[a] = places[a][some], of[a][some], hashes[a][some], slots[a][some]
        n = len(places[0])
        if not n:
            return (np.zeros(0, np.int64),) * 4
        before = []
        for side, (p, r) in enumerate(zip(places, of, strict=True)):  # before the first item of a range nothing is equal
            before.append(np.where(p == ranges[1 + 2 * side][r], -1 - side, self.codes[side][p - 1].astype(np.int32)))
        index = np.uint64(int(n + len(places[1])).bit_length())
        keys = np.concatenate(hashes)
        keys = (keys >> index << index) | np.arange(len(keys), dtype=np.uint64)
        keys.sort()
        at = (keys & ((np.uint64(1) << index) - np.uint64(1))).astype(np.int64)
        keys >>= index
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        del keys
        size = np.diff(starts, append=len(at))
        in_b = np.add.reduceat((at >= n).view(np.int8), starts, dtype=np.int64)  # a's come first in a group
        in_a = size - in_b
        if int((in_a * in_b).sum()) > self.MOST:
            return None
        both = (in_a > 0) & (in_b > 0)
        starts, in_a, in_b = starts[both], in_a[both], in_b[both]
        # an element of a with each of its group in b
        first = np.cumsum(in_a) - in_a
        ea = np.arange(int(in_a.sum())) + np.repeat(starts - first, in_a)
        times, to = np.repeat(in_b, in_a), np.repeat(starts + in_a, in_a)
        x = np.repeat(at[ea], times)
        y = at[np.arange(len(x)) + np.repeat(to - (np.cumsum(times) - times), times)] - n
        new = before[0][x] != before[1][y]
        x, y = x[new], y[new]
        r = of[0][x]
        same = r == of[1][y]
        x, y, r = x[same], y[same], r[same].astype(np.int64)
        i, j = places[0][x], places[1][y]
        return self._grown(i, j, r, ranges, k)

    def _grown(self, i, j, r, ranges, k) -> tuple[np.ndarray, ...]:
        room = np.minimum(ranges[2][r] - i, ranges[4][r] - j)
        size = np.zeros(len(i), np.int64)
        todo = np.arange(len(i))
        while len(todo):
            s = size[todo]
            x = self.grams[0][i[todo] + s] ^ self.grams[1][j[todo] + s]
            equal = (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // self.bits).astype(np.int64)
            size[todo] = s = s + equal
            todo = todo[(equal == self.width) & (s < room[todo])]
        size = np.minimum(size, room)
        long = size >= k  # others had an equal hash only
        return r[long], i[long], j[long], size[long]

    def _parts(self, ranges: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...] | None]]:
        """Ranges with their segments, as many at a time as may be held; None for the segments of a range that has too many."""
        todo = [ranges]
        while todo:
            part = todo.pop()
            found = self.segments(part, k)
            if found is None and part.shape[1] > 1:
                half = part.shape[1] // 2
                todo += [part[:, half:], part[:, :half]]
            else:
                yield part, found

    def _carve(self, ranges: np.ndarray, found: tuple[np.ndarray, ...], k: int, total: np.ndarray) -> np.ndarray:
        """Adds the sizes of blocks of k items or more to total; gives the ranges between them."""
        r, i, j, size = found
        left, last = [], (1 << self.BITS) - 1
        while len(r):
            key = size << 2 * self.BITS | (last - i) << self.BITS | (last - j)
            best = np.zeros(ranges.shape[1], np.int64)
            np.maximum.at(best, r, key)
            has = best > 0
            left.append(ranges[:, ~has])
            number = np.cumsum(has) - 1
            ranges, best, r = ranges[:, has], best[has], number[r]
            of, alo, ahi, blo, bhi = ranges
            n, ai, bj = best >> 2 * self.BITS, last - (best >> self.BITS & last), last - (best & last)
            total += np.bincount(of, n, len(total)).astype(np.int64)
            ranges = np.concatenate([np.stack([of, alo, ai, blo, bj]), np.stack([of, ai + n, ahi, bj + n, bhi])], axis=1)
            before_i, before_j = ai[r] - i, bj[r] - j
            s = n[r]
            cut = np.minimum(size, np.minimum(before_i, before_j))
            skip = np.maximum(np.maximum(before_i, before_j) + s, 0)
            rest = size - skip
            low, high = np.flatnonzero(cut >= k), np.flatnonzero(rest >= k)
            skip = skip[high]
            r, i, j, size = (np.concatenate(x) for x in ((r[low], r[high] + len(n)), (i[low], i[high] + skip), (j[low], j[high] + skip), (cut[low], rest[high])))
        left.append(ranges)
        ranges = np.concatenate(left, axis=1)
        return ranges[:, (ranges[1] < ranges[2]) & (ranges[3] < ranges[4])]

    def _alone(self, part: np.ndarray) -> Blocks:
        _, alo, ahi, blo, bhi = part[:, 0].tolist()
        return Blocks(self.codes[0][alo:ahi].tolist(), self.codes[1][blo:bhi].tolist())

    def matched(self) -> np.ndarray:
        """Blocks.matched of each pair."""
        total = np.zeros(self.pairs, np.int64)
        ranges = self.ranges
        for k in self.sizes:
            left = []
            for part, found in self._parts(ranges, k):
                if found is None and k == self.sizes[0]:
                    found = self.segments(part, self.LONG)
                    part = part if found is None else self._carve(part, found, self.LONG, total)
                    some = self._parts(part, k) if found is not None else [(part, None)]
                else:
                    some = [(part, found)]
                for p, f in some:
                    if f is None:
                        total[p[0, 0]] += self._alone(p).matched()
                    else:
                        left.append(self._carve(p, f, k, total))
            ranges = np.concatenate(left, axis=1) if left else ranges[:, :0]
        return total

    def longest(self) -> np.ndarray:
        """The size of the longest block of each pair."""
        size = np.zeros(self.pairs, np.int64)
        for k in self.sizes:
            for part, found in self._parts(self.ranges[:, size == 0], k):
                if found is None:
                    block = self._alone(part)
                    size[part[0, 0]] = block.longest(0, len(block.a), 0, len(block.b), len(block.a))[2]
                else:
                    np.maximum.at(size, part[0][found[0]], found[3])
        return size


#: Items of a and b that ManyBlocks gets at once, unless a single pair has more.
ITEMS = 1 << 18


def _together(sizes: Sequence[int]) -> Iterator[slice]:
    """Stretches of rows with at most ITEMS items, or of one row."""
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > ITEMS:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def matched(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Characters in the blocks of Ratcliff and Obershelp, for each pair of texts."""
    out = np.array([len(x) if x == y else 0 for x, y in zip(a, b, strict=True)], np.int64)
    rows = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y]
    for part in _together([len(a[k]) + len(b[k]) for k in rows]):
        ks = np.array(rows[part])
        joined = [np.frombuffer("".join(s[k] for k in ks).encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b)]
        cuts = [np.cumsum([len(s[k]) for k in ks])[:-1] for s in (a, b)]
        points = [np.split(s, c) for s, c in zip(joined, cuts, strict=True)]
        counts = np.bincount(np.concatenate(joined))
        common = np.zeros(len(counts), np.uint8)  # rare characters, which make a pair's codes two bytes long, are 0
        most = np.argsort(-counts, kind="stable")[:255]
        common[most] = np.arange(1, len(most) + 1)
        coded = [common[s] for s in joined]
        x, y = (np.split(s, c) for s, c in zip(coded, cuts, strict=True))
        short = np.ones(len(ks), bool)
        for s, c in zip(coded, cuts, strict=True):
            short[np.searchsorted(c, np.flatnonzero(s == 0), "right")] = False
        for way in (True, False):
            at = np.flatnonzero(short == way)
            if way:
                codes = [[s[n] for n in at] for s in (x, y)]
            elif len(at):
                seen, of = np.unique(np.concatenate([s[n] for s in points for n in at]), return_inverse=True)
                cut = np.split(of.astype(np.uint16), np.cumsum([len(s[n]) for s in points for n in at])[:-1])
                codes = [cut[: len(at)], cut[len(at) :]]
            if not len(at):
                continue
            if sum(map(len, codes[0])) >> ManyBlocks.BITS or sum(map(len, codes[1])) >> ManyBlocks.BITS or not way and len(seen) >> 16:
                out[ks[at]] = [Blocks(a[k], b[k]).matched() for k in ks[at]]
            else:
                out[ks[at]] = ManyBlocks(*codes).matched()
    return out


def longest(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """The size of the longest common block of each pair of arrays of numbers; only those below 65,536 are compared by ManyBlocks."""
    out = np.zeros(len(a), np.int64)
    rows = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if len(x) and len(y)]
    for part in _together([len(a[k]) + len(b[k]) for k in rows]):
        ks = np.array(rows[part])
        small = np.array([max(int(a[k].max()), int(b[k].max())) >> 16 == 0 for k in ks])
        if small.any():
            out[ks[small]] = ManyBlocks(*([s[k].astype(np.uint16) for k in ks[small]] for s in (a, b))).longest()
        for k in ks[~small]:
            block = Blocks(a[k].tolist(), b[k].tolist())
            out[k] = block.longest(0, len(block.a), 0, len(block.b), len(block.a))[2]
    return out
