"""Splits text by a pre-token pattern with \\p{L}, \\p{N} and \\s.

Python's re has no \\p classes but is quicker than the regex module, so the classes are spelled out for the basic plane; a
text with characters beyond it goes to the regex module. For the one pattern that PATTERN states, starts() finds the places
where pre-tokens begin in whole blocks of code points, without a Python object for each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import regex

#: The White_Space property.
SPACE = r"\t-\r \x85\xa0  -     　"


@cache
def _category(first: str) -> str:
    """Ranges of the basic plane's characters whose general category starts with a letter, as the inside of a class."""
    codes = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == first]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def _spelled_out(pattern: str) -> str | None:
    """The pattern for re, or None if it uses more than is known here."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            name = pattern[i : i + 5] if pattern[i + 1] in "pP" else pattern[i : i + 2]
            ranges = {r"\p{L}": _category("L"), r"\p{N}": _category("N"), r"\s": SPACE}.get(name)
            if ranges:
                out.append(ranges if inside else f"[{ranges}]")
            elif name == r"\S" and not inside:
                out.append(f"[^{SPACE}]")
            elif name[1].isalnum():
                return None
            else:
                out.append(name)
            i += len(name)
            continue
        inside = True if c == "[" else False if c == "]" else inside
        out.append(c)
        i += 1
    return "".join(out)


@cache
def pretokenizer(pattern: str) -> Callable[[str], list[str]]:
    """findall() of the pattern."""
    full = regex.compile(pattern).findall
    plain = _spelled_out(pattern)
    if plain is None:
        return full
    quick, beyond = re.compile(plain).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: full(text) if beyond(text) else quick(text)


#: Fixed value: the pattern that starts() follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)


@cache
def unsure() -> re.Pattern:
    """Finds characters whose class starts() doesn't know for certain: beyond the basic plane, or unassigned in Python's tables,
    which other libraries' tables may know."""
    codes = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]
    starts_ = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    inside = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts_, ends, strict=True))
    return re.compile(f"[{inside}\U00010000-\U0010ffff]")


@cache
def _classes() -> np.ndarray:
    """The class of each character of the basic plane."""
    out = np.full(0x10000, _OTHER, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
    spaces = re.compile(f"[{SPACE}]")
    out[[c for c in range(0x10000) if spaces.match(chr(c))]] = _SPACE
    return out


def starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where PATTERN's matches begin in code points of the basic plane; ends lists the places of marks that end a text.

    Matches are runs of one class, but for three rules. A run of spaces gives its last one away, which is a match of its own or,
    if it is a plain space, goes to the run behind it; a run at a text's end is whole. A lone apostrophe takes the letters of a
    contraction with it, unless a space went to it. The marks count as starts too.
    """
    kind = _classes()[codes]
    kind[ends] = _END
    n = len(codes)
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    run = start.copy()
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
    start[last] = True
    plain = last[codes[last] == 32]
    start[plain + 1] = False
    lone = np.flatnonzero((codes[:-2] == 39) & start[:-2] & run[1:-1] & run[:-2] & (kind[1:-1] == _LETTER)) if n > 2 else np.empty(0, np.int64)
    if len(lone):
        one, two = codes[lone + 1], codes[lone + 2]
        short = (one == 115) | (one == 116) | (one == 109) | (one == 100)  # s t m d
        long = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))  # re ve ll
        start[lone[short] + 1] = False
        start[lone[short] + 2] = True
        start[lone[long] + 1] = False
        after = lone[long] + 3
        start[after[after < n]] = True
    return np.flatnonzero(start)
