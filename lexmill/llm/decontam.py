"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton is built over words, one path per item. A document's words are streamed through it; the length of the
longest suffix that occurs in some item is known after every word. Where it reaches the window length, the last window
words are a passage of an item. An item shorter than a window counts as one window.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import ascii_words, held, map_rows
from lexmill.session import Workspace

#: Words of benchmark items that one automaton holds (some 90 MB in a worker, and 350 MB in the driver while it is built); more items
#: are dealt with in blocks, one pass over the documents each. An item alone may have more.
MAX_BLOCK_WORDS = 500_000
#: Documents with hits of earlier blocks, and hits and items in all, that are broadcast to the last pass; more are joined by a shuffle.
MAX_BROADCAST_HITS = 500_000
#: A word of a text, as code points.
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class SuffixAutomaton:
    """Of several word sequences.

    While it is built, a state's transitions are a dictionary. Then states with a single one, which most are, keep it in two
    flat arrays, and so do states whose window occurs in a single item.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []  # state and item of every prefix of at least a window's words
        shorts: dict[tuple[int, ...], list[int]] = {}
        self.items = [k for k, _ in items]
        for at, (_, words) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if not ids:
                continue
            last = 0
            for n, c in enumerate(ids, 1):
                last = self._extend(last, c)
                if n >= window:
                    ends.append((last, at))
            if len(ids) < window:
                shorts.setdefault(tuple(ids), []).append(at)
        # the ancestor whose strings include a state's last `window` words; links lead to shorter states, so their own are known first
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        self.top = array("i", range(len(self.next)))
        for state in order:
            up = self.link[state]
            if up >= 0 and self.length[up] >= window:
                self.top[state] = self.top[up]
        owners: dict[int, set[int]] = {}  # the items in which a state's window occurs
        for state, at in ends:
            owners.setdefault(self.top[state], set()).add(at)
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> (length, item) of whole short items among its strings
        for ids, whose in shorts.items():
            state = 0
            for c in ids:
                state = self.next[state][c]
            self.short.setdefault(state, []).extend((len(ids), at) for at in whose)
        # the nearest ancestor, or the state itself, at which a short item ends; 0 where there is none
        self.ender = array("i", [0]) * len(self.next)
        for state in order[1:]:
            self.ender[state] = state if state in self.short else self.ender[self.link[state]]
        n = len(self.next)
        self.word, self.to, self.owner = (array("i", [-1]) * n for _ in range(3))
        self.branches: dict[int, dict[int, int]] = {}
        for state, out in enumerate(self.next):
            if len(out) == 1:
                [(self.word[state], self.to[state])] = out.items()
            elif out:
                self.branches[state] = out
        self.shared: dict[int, list[int]] = {}
        for state, who in owners.items():
            if len(who) == 1:
                [self.owner[state]] = who
            else:
                self.shared[state] = sorted(who)
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.next

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:  # known from an earlier item
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit word ranges (start, end), merged and in order; items with an occurring window; the longest match if any is hit."""
        vocab, link, length, window = self.vocab.get, self.link, self.length, self.window
        single, to, branches = self.word, self.to, self.branches.get
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        state = n = longest = 0
        short = self.short
        for i, w in enumerate(words):
            c = vocab(w)
            if c is None:
                state = n = 0
                continue
            while True:
                if single[state] == c:
                    state = to[state]
                    n += 1
                    break
                found = branches(state)
                if found is not None and c in found:
                    state = found[c]
                    n += 1
                    break
                if not state:  # a word of the vocabulary goes on from the root, unless no item was put in
                    n = 0
                    break
                state = link[state]
                n = length[state]
            if n > longest:
                longest = n
            if n >= window:
                s = self.top[state]
                at = self.owner[s]
                if at >= 0:
                    items.add(at)
                else:
                    items.update(self.shared[s])
                hits.append((i + 1 - window, i + 1))
            if short:
                s = self.ender[state]
                while s > 0:  # at most one state for each length below a window
                    for size, at in short[s]:
                        if size <= n:
                            items.add(at)
                            hits.append((i + 1 - size, i + 1))
                    s = self.ender[link[s]]
        return joined(hits), items, longest if hits else 0


def joined(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _blocks(items: DataFrame, item_id: str, text: str, window: int, max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in blocks of at most max_words words (an item alone may have more), one block at a time; at least one."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = items.select(F.col(item_id).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").distinct()
    for r in rows.toLocalIterator():
        words = ascii_words(r["t"])
        if size and size + len(words) > max_words:
            yield block
            block, size = [], 0
        block.append((r["k"], words))
        size += len(words)
    yield block


HITS = "array<struct<a:int,b:int>>"


def scan(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, keep: list[str] | None = None, max_block_words: int = MAX_BLOCK_WORDS,
) -> DataFrame:
    """Every row of df (columns `keep`, all by default) with what the benchmark items have in common with its text.

    Adds __n_words, __hits (word ranges inside an occurring window, merged), __items (ids of items with an occurring window,
    as strings, sorted, each once) and __longest (longest run of words shared with an item, 0 if nothing is hit). A null or
    empty text has no words. Items without id, text or words never occur; items that repeat count once. Without items nothing
    is hit. More items than one block holds are dealt with block by block: what the later blocks hit is written and handed to
    a last pass with the first one. Rows that repeat are scanned each; an empty table gives an empty one. Of a very long text
    its words are held at once.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("__n_words", "__hits", "__items", "__longest")]
    return _passes(df, items, text, item_id, item_text, window, keep, max_block_words, None)


def _passes(df, items, text, item_id, item_text, window, keep, max_block_words, max_coverage: float | None) -> DataFrame:
    """What scan() gives; with max_coverage instead the columns `keep`, the text among them cut, without the rows that go: in the same
    pass, so that texts go to Python once."""
    mark = uuid.uuid4().hex
    rid, held_text, prior = (f"__{k}{mark}" for k in "rtp")  # no column of df has such a name
    spark = df.sparkSession

    def one(block, frame: DataFrame, carried: list[str], with_prior: bool = False) -> DataFrame:
        sent = spark.sparkContext.broadcast(pickle.dumps(SuffixAutomaton(block, window), 5))
        name = uuid.uuid4().hex
        cutting = max_coverage is not None and carried == keep
        made = T._parse_datatype_string(f"__n_words bigint, __hits {HITS}, __items array<string>, __longest int").fields
        schema = T.StructType([frame.schema[k] for k in carried] + ([] if cutting else made))

        def make():
            sam = held(("automaton", name), lambda: pickle.loads(sent.value))

            def clean(rows):
                kept, new = [], []
                for i, t in enumerate(rows[text]):
                    words = ascii_words(t)
                    hits = sam.matches(words)[0]
                    if with_prior and rows[prior][i]:
                        hits = joined(hits + [(h["a"], h["b"]) for h in rows[prior][i]["hits"]])
                    n_hit = sum(b - a for a, b in hits)
                    if n_hit <= max_coverage * len(words):
                        kept.append(i)
                        new.append(cut(t, hits) if n_hit else t)
                return {k: [rows[k][i] for i in kept] for k in carried} | {text: new}

            def run(rows):
                out = {k: rows[k] for k in carried} | {"__n_words": [], "__hits": [], "__items": [], "__longest": []}
                for t, known in zip(rows[held_text], rows[prior] if with_prior else [None] * len(rows[held_text]), strict=True):
                    words = ascii_words(t)
                    hits, found, longest = sam.matches(words)
                    names = {sam.items[x] for x in found}
                    if known:
                        hits = joined(hits + [(h["a"], h["b"]) for h in known["hits"]])
                        names |= set(known["items"])
                        longest = max(longest, known["longest"])
                    out["__n_words"].append(len(words))
                    out["__hits"].append([{"a": a, "b": b} for a, b in hits])
                    out["__items"].append(sorted(names))
                    out["__longest"].append(longest)
                return out

            return clean if cutting else run

        scanned = [] if cutting else [frame[text].alias(held_text)]
        return map_rows(frame.select(*carried, *scanned, *([prior] if with_prior else [])), make, schema)

    blocks = _blocks(items, item_id, item_text, window, max_block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return one(first, df, keep)
    ws = Workspace(spark, "decontam")
    base = ws.write(df.withColumn(rid, F.monotonically_increasing_id()), "docs")
    parts = []
    for i, block in enumerate(chain([second], blocks)):
        parts.append(ws.write(one(block, base, [rid]).where(F.size("__hits") > 0), f"block{i}"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy(rid).agg(
        F.array_distinct(F.flatten(F.collect_list("__hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("__items"))).alias("items"),
        F.max("__longest").alias("longest"),
    )
    found = ws.write(found.select(rid, F.struct("hits", "items", "longest").alias(prior)), "found")
    size = found.agg(F.sum(F.size(f"{prior}.hits") + F.size(f"{prior}.items"))).first()[0] or 0
    return one(first, base.join(F.broadcast(found) if size <= MAX_BROADCAST_HITS else found, rid, "left"), keep, True)


def cut(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without the words of the hit ranges and what stands between them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in hits:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join(out) + text[at:]


def decontaminate(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, max_coverage: float = 0.5, n_chars: str | None = None, max_block_words: int = MAX_BLOCK_WORDS,
) -> DataFrame:
    """df's own columns, without the spans that it shares with benchmark items.

    Spans of at least `window` words (or a whole shorter item) are cut out of the text. A document of which more than
    max_coverage of the words are hit is removed. Other documents pass unchanged, those without
    text among them. n_chars names a column that follows the text's length.
    """
    out = _passes(df, items, text, item_id, item_text, window, df.columns, max_block_words, max_coverage)
    return out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType)) if n_chars else out
