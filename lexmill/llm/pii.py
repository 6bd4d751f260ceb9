"""Personal data: candidate spans judged by boosted trees.

Fixed patterns give base spans of four kinds, which always stay. Generators of high recall propose further spans, which may
overlap: ranges of digit groups as phone, card and address numbers, and everything like an e-mail address, obfuscated ones
included. Boosted trees judge a candidate by its format and what stands around it. They are fitted without hand labels: a
candidate that covers a base span of its kind is a positive one, one that touches none a negative one, and no feature tells
what only the base pattern asks for (such as a phone's plus sign), so that the trees find spans that look alike without it.
Scores are calibrated on texts that the fit doesn't see, and each kind has the least threshold that is precise there.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import held, map_rows
from lexmill.session import Workspace

# Kinds in order, the base patterns, and what their matches must hold.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

#: Texts, their bytes and candidates that the trees are fitted on, at most; tenths of the texts that calibrate.
TRAIN_TEXTS, TRAIN_BYTES, TRAIN_CANDIDATES, HELD_BACK = 20_000, 64 << 20, 200_000, 3
#: Trees, their depth and learning rate; precision that a threshold has on held-back texts, and the positives it must rest on.
TREES, DEPTH, RATE, PRECISION, MIN_POSITIVES = 20, 4, 0.3, 0.9, 20
#: Digit groups of a candidate at most; characters of context on its left.
GROUPS, CONTEXT = 6, 32

_GROUPED = re.compile(r"[0-9]+(?:[\x20().\-/]{1,3}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"@|＠|[(\[]\x20?at\x20?[)\]]", re.I)
_BEFORE_AT = re.compile(r"[\w.+%-]{1,64}\x20?\Z")
_AFTER_AT = re.compile(r"\x20?[\w-]+(?:\x20?(?:\.|[(\[]\x20?dot\x20?[)\]])\x20?[\w-]+)*", re.I)
_FOR = re.compile(r"(tel|phone|call|mobile|cell|fax|mail|contact|card|visa|host|server|addr|telef|anruf|appel|correo)", re.I)
_AGAINST = re.compile(r"(version|isbn|order|invoice|token|key|hash|page|chapter|section|number of|id\b|no\.|\$|€)", re.I)


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and s <= "255"


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns' matches that hold what they must, by kind and start; positions in code points."""
    if not text:
        return []
    out, end, seen = [], 0, 0
    at = text.find("@")
    while at >= 0:  # an address stands around its @, so that long runs without one are never searched again and again
        before = text[max(end, seen) : at]
        n = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if n else None
        if m:
            out.append((0, at - n, m.end()))
            end = m.end()
        seen = at + 1
        at = text.find("@", seen)
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if CARD_DIGITS[0] <= m.end() - m.start() < 2 * CARD_DIGITS[1]:
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= sum(map(str.isdigit, m[0])) <= PHONE_DIGITS[1]]
    return out


def candidates(text: str | None) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of everything that might be personal data; spans overlap, and one may be proposed as several kinds."""
    if not text:
        return
    for m in _AT.finditer(text):
        before = _BEFORE_AT.search(text, max(0, m.start() - 65), m.start())
        after = _AFTER_AT.match(text, m.end())
        if before and after and before.end() == m.start():
            yield 0, before.start(), after.end()
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                digits += groups[j][1] - groups[j][0]
                if digits > CARD_DIGITS[1]:
                    break
                end = groups[j][1]
                a = start - (start > 0 and text[start - 1] == "(" and ")" in text[start:end])
                if 7 <= digits <= 15:
                    yield 3, a, end
                if digits >= 12:
                    yield 2, start, end
                if j - i == 3 and all(text[groups[k][1] : groups[k + 1][0]] == "." for k in range(i, j)):
                    yield 1, start, end


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[a:b]
    groups = _GROUP.findall(s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    before = text[max(0, a - CONTEXT) : a]
    # a plus sign is looked through, as base phones have one
    left = before.rstrip("+")[-1:]
    domain = s[max(s.rfind("@"), s.rfind("＠"), s.rfind(")"), s.rfind("]")) + 1 :] if kind == 0 else ""
    return [
        kind, len(s), len(digits), len(sizes), sizes[0], sizes[-1], min(sizes), max(sizes),
        s.count(" "), s.count("-"), s.count("."), s.count("("), s.count("/"),
        len(set(digits)), float(luhn(digits)) if digits and kind == 2 else 0.0,
        float(kind == 1 and all(map(_octet, groups))),
        domain.count(".") if kind == 0 else 0, len(domain.rpartition(".")[2]) if kind == 0 else 0,
        _side(left), _side(text[b : b + 1]),
        float(bool(_FOR.search(before))), float(bool(_AGAINST.search(before))),
    ]


def _touched(apart: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of some ordered spans, none overlapping another, that overlap (a, b)."""
    i = bisect_right(apart, (a, a))
    i -= i > 0 and apart[i - 1][1] > a
    j = i
    while j < len(apart) and apart[j][0] < b:
        j += 1
    return apart[i:j]


def label(a: int, b: int, base: list[tuple[int, int]]) -> int | None:
    """1 if the candidate covers much of a base span of its kind, 0 if it touches none of that kind, else nothing is known."""
    met = _touched(base, a, b)
    return 0 if not met else 1 if any(min(b, y) - max(a, x) >= 0.8 * (max(b, y) - min(a, x)) for x, y in met) else None


class Trees(NamedTuple):
    """Boosted trees of one depth as arrays [tree, node], node i's children being 2i + 1 and 2i + 2; then the calibration."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    slope: float
    shift: float
    thresholds: list[float]

    def margins(self, x: np.ndarray) -> np.ndarray:
        t, at = np.arange(len(self.feature)), np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            f = self.feature[t, at]
            inner = f >= 0
            right = x[np.arange(len(x))[:, None], np.maximum(f, 0)] > self.limit[t, at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return self.value[t, at].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margins(x) + self.shift)))


def _arrays(model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A fitted ensemble as the arrays of Trees."""
    shape = (len(model.treeWeights), 2 ** (DEPTH + 1) - 1)
    feature, limit, value = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        todo = [(tree._java_obj.rootNode(), 0)]
        while todo:
            node, i = todo.pop()
            if node.getClass().getSimpleName() == "InternalNode":
                feature[t, i], limit[t, i] = node.split().featureIndex(), node.split().threshold()
                todo += [(node.leftChild(), 2 * i + 1), (node.rightChild(), 2 * i + 2)]
            else:
                value[t, i] = weight * node.prediction()
    return feature, limit, value


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins, by Newton's method with a little shrinkage."""
    w, x = np.array([1.0, 0.0]), np.column_stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least probability from which on held-back candidates are precise; beyond 1 where too few positives say so."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    last = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.empty(0, bool)
    fine = last & (right >= PRECISION * np.arange(1, len(p) + 1)) & (right >= MIN_POSITIVES)
    return max(0.5, float(p[order][np.flatnonzero(fine)[-1]])) if fine.any() else 2.0


def train(df: DataFrame, text: str = "text", texts: int = TRAIN_TEXTS, most_bytes: int = TRAIN_BYTES, most: int = TRAIN_CANDIDATES) -> Trees | None:
    """Trees fitted and calibrated on the candidates of at most about `texts` different texts of df, of at most most_bytes
    bytes (one text at least) and `most` candidates, taken by a hash of the text. None without a candidate of either label."""
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "pii")
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    n = df.count()
    few = rows.where(F.pmod("h", F.lit(1 << 20)) < min(1.0, texts / max(1, n)) * (1 << 20))
    sizes = few.groupBy("h").agg(F.max(F.octet_length("t")).alias("b")).orderBy("h").limit(2 * texts).collect()
    size, last = 0, None
    for r in sizes:
        size += r["b"]
        if size > most_bytes and last is not None:
            break
        last = r["h"]
    if last is None:
        return None

    def make():
        def run(r):
            out: dict[str, list] = {"h": [], "kind": [], "a": [], "b": [], "y": [], "x": []}
            for h, t in zip(r["h"], r["t"], strict=True):
                base: list[list] = [[] for _ in KINDS]
                for k, a, b in base_spans(t):
                    base[k].append((a, b))
                for k, a, b in candidates(t):
                    y = label(a, b, base[k])
                    if y is not None:
                        for c, v in zip(out, (h, k, a, b, float(y), features(t, k, a, b)), strict=True):
                            out[c].append(v)
            return out

        return run

    found = map_rows(few.where(F.col("h") <= last).select("h", "t"), make, "h bigint, kind int, a int, b int, y double, x array<double>")
    found = ws.write(found.dropDuplicates(["h", "kind", "a", "b"]).orderBy("h", "kind", "a", "b").limit(most), "candidates")
    kept_back = F.pmod(F.xxhash64("h"), F.lit(10)) < HELD_BACK
    fit = found.where(~kept_back)
    if fit.select("y").distinct().count() < 2:
        return None
    # the sample is bounded, so one partition in a fixed order gives the same trees on every run
    fit = fit.select("y", array_to_vector("x").alias("features"), "h", "kind", "a", "b").repartition(1).sortWithinPartitions("h", "kind", "a", "b")
    boosted = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, minInstancesPerNode=5, seed=7)
    arrays = _arrays(boosted.fit(fit.select("y", "features")))
    test = found.where(kept_back).orderBy("h", "kind", "a", "b").select("kind", "y", "x").collect()
    none = Trees(*arrays, 2.0, 0.0, [2.0] * len(KINDS))
    if not test:
        return none
    x, y, kinds = np.array([r["x"] for r in test]), np.array([r["y"] for r in test]), np.array([r["kind"] for r in test])
    slope, shift = _platt(none.margins(x), y)
    trees = none._replace(slope=slope, shift=shift)
    p = trees.probabilities(x)
    return trees._replace(thresholds=[_threshold(p[kinds == k], y[kinds == k]) for k in range(len(KINDS))])


def spans_of(texts: list[str | None], trees: Trees | None) -> list[list[tuple[int, int, int, bool, float]]]:
    """(kind, start, end, base, probability) of each text, by kind, base ones first, and start.

    Base spans have probability 1. Of other candidates above their kind's threshold those stay that overlap no base span and no
    candidate of a higher probability (of equal ones the longer, then the earlier).
    """
    out = [[(*s, True, 1.0) for s in base_spans(t)] for t in texts]
    if trees is None:
        return out
    at, x = [], []
    for i, t in enumerate(texts):
        taken = [(a, b) for _, a, b in _apart([(a, b, k) for k, a, b, *_ in out[i]])]
        for k, a, b in candidates(t):
            if trees.thresholds[k] <= 1 and not _touched(taken, a, b):
                at.append((i, k, a, b))
                x.append(features(t, k, a, b))
    if not at:
        return out
    p = trees.probabilities(np.array(x))
    good = [(i, -q, a - b, a, k, b) for (i, k, a, b), q in zip(at, p.tolist(), strict=True) if q >= trees.thresholds[k]]
    added: dict[int, list] = {}
    held_by: dict[int, list] = {}
    for i, q, _, a, k, b in sorted(good):
        if not _touched(held_by.setdefault(i, []), a, b):
            insort(held_by[i], (a, b))
            added.setdefault(i, []).append((k, a, b, False, -q))
    for i, more in added.items():
        out[i] += sorted(more)
    return out


SPAN = "struct<kind:string,start:int,end:int,base:boolean,p:double>"


def scan(df: DataFrame, trees: Trees | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of df (all but the text by default) with __spans, the personal data of its text.

    A span has kind (email, ip, card, phone), start, end, base (found by the fixed pattern) and p, its probability; base spans
    come first, by kind and start, then those that the trees add, likewise. A null or empty text has none. Whole texts count;
    rows that repeat are scanned alike. An empty table gives an empty one. A column __spans of df is replaced.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c != "__spans"]
    sent, mark = df.sparkSession.sparkContext.broadcast(pickle.dumps(trees, 5)), uuid.uuid4().hex
    narrow = df.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], F.col(text).alias("t"))
    types = [f"k_{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{k} {narrow.schema[k].dataType.simpleString()}" for k in types), f"s array<{SPAN}>"])

    def make():
        model = held(("pii", mark), lambda: pickle.loads(sent.value))

        def run(r):
            found = [[dict(zip(("kind", "start", "end", "base", "p"), (KINDS[k], *rest), strict=True)) for k, *rest in s] for s in spans_of(r["t"], model)]
            return {k: r[k] for k in types} | {"s": found}

        return run

    return map_rows(narrow, make, schema).select(*[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)], F.col("s").alias("__spans"))


def redact(df: DataFrame, trees: Trees | None, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """df's own columns; in its text each span is replaced by its kind in angle brackets.

    Spans that overlap are replaced together, by the kind of the first. Texts without spans, null ones among them, pass
    unchanged. n_chars names a column that follows the text's length. No text is shuffled.
    """
    sent, mark, names = df.sparkSession.sparkContext.broadcast(pickle.dumps(trees, 5)), uuid.uuid4().hex, df.columns

    def make():
        model = held(("pii", mark), lambda: pickle.loads(sent.value))

        def run(r):
            new = []
            for t, found in zip(r[text], spans_of(r[text], model), strict=True):
                out, at = [], 0
                for kind, a, b in _apart([(a, b, k) for k, a, b, *_ in found]):
                    out += [t[at:a], f"<{KINDS[kind]}>"]
                    at = b
                new.append("".join(out) + t[at:] if out else t)
            return {k: r[k] for k in names} | {text: new}

        return run

    out = map_rows(df, make, df.schema)
    return out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType)) if n_chars else out


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of spans (start, end, kind), overlapping ones joined."""
    out: list[list[int]] = []
    for a, b, k in sorted(spans):
        if out and a < out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([k, a, b])
    return [tuple(x) for x in out]
