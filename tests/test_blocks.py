"""Common blocks of many pairs at once, against difflib and a pair at a time."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from lexmill.functions import blocks, overlap


def matcher(a, b):
    return SequenceMatcher(None, a, b, autojunk=False)


def prose(rng, n):
    part = ["on", "th", "er", "an", "ing", "ea", "in", "re", "tion", "ha"]
    return " ".join(rng.choice(["the", "of", "and", "".join(rng.choices(part, k=rng.randint(1, 4)))]) for _ in range(n))


def odd_pairs():
    rng = random.Random(7)
    out = [("", ""), ("", "a"), ("a", ""), ("same text", "same text"), ("a" * 700, "a" * 900), ("ab" * 400, "ba" * 300), ("abc" * 200 + "x" + "abc" * 90, "abc" * 150 + "y" + "abc" * 120)]
    for k in range(120):
        a, b = ("".join(rng.choice("ab cdé"[: 1 + k % 6]) for _ in range(rng.randint(0, 200))) for _ in "ab")
        out.append((a, b + a[50:150] + b if k % 4 == 0 else b))
    wide = [chr(c) for c in (*range(0x4E00, 0x4E00 + 400), 0x1F600, 0x10FFFF, 0)]
    for _ in range(4):  # more different characters than a byte tells apart
        a, b = ("".join(rng.choices(wide, k=500)) for _ in "ab")
        out.append((a, b[:200] + a[100:300] + b[200:]))
    words = prose(rng, 300)
    return [*out, (words, words[:700] + "!" + words[701:]), (prose(rng, 400), words)]


@pytest.mark.parametrize("most", [20, 3000, blocks.ManyBlocks.MOST])
def test_blocks_of_many_pairs(monkeypatch, most):
    monkeypatch.setattr(blocks.ManyBlocks, "MOST", most)  # with few, ranges are split, begin with long segments or go to Blocks
    a, b = zip(*odd_pairs(), strict=True)
    assert blocks.matched(a, b).tolist() == [sum(m.size for m in matcher(x, y).get_matching_blocks()) for x, y in zip(a, b, strict=True)]
    codes = [[np.array([ord(c) % 5000 for c in x], np.int64) for x in s] for s in (a, b)]
    assert blocks.longest(*codes).tolist() == [matcher(x.tolist(), y.tolist()).find_longest_match().size for x, y in zip(*codes, strict=True)]
    assert blocks.longest([np.array(x) for x in ([70_000, 1, 2], [3])], [np.array(x) for x in ([5, 1, 2], [70_000])]).tolist() == [2, 0]


def test_scores_do_not_take_pairs_one_by_one():
    """Of 200 pairs of 3,000 characters, the similarity comes at a quarter of the time of one pair after the other, or less."""
    rng = random.Random(1)
    a, b = ([prose(rng, 550) for _ in range(200)] for _ in "ab")
    began = time.process_time()
    got = overlap.char_ratio.func(pd.Series(a), pd.Series(b))
    many = time.process_time() - began
    began = time.process_time()
    want = [2 * overlap.Blocks(x, y).matched() / (len(x) + len(y)) for x, y in zip(a[:20], b[:20], strict=True)]
    assert got[:20].tolist() == want
    assert 4 * many < 10 * (time.process_time() - began)


def test_words_of_a_pair():
    pred = pd.Series(["a, b c-d", "", "x", "a a b", "?", "é"])
    gold = pd.Series(["a b x c d", "a", "", "a b (b) a", "q", "é b"])
    p, g = pd.Series([None] * 5 + ["é"]), pd.Series([None] * 5 + ["é b"])
    got = overlap.token_overlap.func(p, g, pred, gold)
    assert got.values.tolist() == [[4, 5, 2, 2, 4, 4], [0, 1, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0], [3, 4, 1, 2, 2, 3], [0, 1, 0, 0, 0, 0], [1, 2, 1, 1, 1, 1]]
