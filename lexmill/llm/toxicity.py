"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other; the probabilities of earlier ones are features of later ones. In training a
later model sees out-of-fold probabilities, so that it meets what it will meet in use. Features are the words of a text and
their beginnings, present or not.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_words, held, map_rows
from lexmill.llm.ftrl import Ftrl, softmax

#: Labelled rows that the models are fitted on, and bytes of their texts, at most; least rows of a feature; folds; bytes of a
#: word's beginnings.
TRAIN_ROWS, TRAIN_BYTES, MIN_ROWS, FOLDS, PREFIXES = 10_000, 64 << 20, 4, 5, (6, 8)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's words and their beginnings, without digits-only words."""
    words = set(ascii_words(text))
    h = xxhash.xxh32_intdigest
    out = [h(w) for w in words]
    for n in PREFIXES:
        out += map(lambda p, n=n: h(p, n), {w[:n] for w in words if len(w) >= n})
    return np.unique(np.array(out, np.uint32))


class Chain:
    """One model for each category, with the features that have weight and the decision threshold of the last one."""

    def __init__(self, names: list[str]):
        self.names = names
        self.models: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] = []
        self.threshold = 0.5

    def predict(self, found: np.ndarray) -> list[float]:
        """Probabilities of the categories, in order; zeros for a text without words or a chain without models."""
        out: list[float] = []
        if not len(found) or not self.models:
            return [0.0] * len(self.names)
        for known, weights, of_earlier, bias in self.models:
            at = np.searchsorted(known, found)
            at[at == len(known)] = 0
            hit = known[at] == found if len(known) else np.zeros(len(found), bool)
            s = weights[at[hit]].sum() + bias + float(np.dot(of_earlier, out))
            out.append(float(1 / (1 + np.exp(-s))))
        return out


def _fit(rows, labels, n) -> Ftrl:
    return Ftrl(n, 2, alpha=1.0, l1=1.5, l2=0.05).fit(rows, labels, epochs=max(3, min(60, 10_000 // max(1, len(rows)))))


def _score(model: Ftrl, rows) -> np.ndarray:
    w = model.weights()
    return np.array([softmax(v @ w[i] + w[-1])[1] for i, v in rows])


def _sample(df: DataFrame, labels: DataFrame, categories: list[str], key: str, text: str, rows: int, most_bytes: int) -> list[tuple[np.ndarray, list[int]]]:
    """(features, labels) of the rows to fit on, in the order of a hash of key and text."""
    usable = labels.select(F.col(key).alias("__k"), *[F.col(c).cast("int").alias(c) for c in categories]).where(
        " and ".join(["__k is not null", *[f"`{c}` in (0, 1)" for c in categories]])
    )
    n = usable.count()
    if not n:
        return []
    h = F.xxhash64("__k")
    few = usable.where(F.pmod(h, F.lit(1 << 20)) < min(1.0, rows / n) * (1 << 20)).orderBy(h, *categories).limit(2 * rows)
    texts = df.select(F.col(key).alias("__k"), F.col(text).alias("__t")).where("__t is not null").join(F.broadcast(few), "__k")
    texts = texts.withColumn("__h", F.xxhash64("__k", "__t"))
    # the first rows by hash whose texts stay within the bound; of rows that repeat one counts
    sizes = texts.groupBy("__h").agg(F.max(F.octet_length("__t")).alias("b")).orderBy("__h").limit(2 * rows).collect()
    size, last = 0, None
    for r in sizes:
        size += r["b"]
        if size > most_bytes and last is not None:
            break
        last = r["__h"]
    if last is None:
        return []

    def make():
        return lambda r: {"h": r["__h"], "f": [features(t).tobytes() for t in r["__t"]]} | {c: r[c] for c in categories}

    schema = "h bigint, f binary, " + ", ".join(f"`{c}` int" for c in categories)
    got = map_rows(texts.where(F.col("__h") <= last), make, schema).dropDuplicates(["h", *categories]).collect()
    got.sort(key=lambda r: (r["h"], *[r[c] for c in categories]))
    return [(np.frombuffer(r["f"], np.uint32), [r[c] for c in categories]) for r in got]


class _Rows:
    """Rows (indices, values) of a sample, made when they are asked for: features that a row has, then earlier probabilities."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, earlier: np.ndarray, n_names: int, use: list[int]):
        self.flat, self.ends, self.earlier, self.use = flat, ends, earlier, use
        self.more = n_names + np.arange(earlier.shape[1])

    def __len__(self) -> int:
        return len(self.use)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k >= len(self.use):
            raise IndexError
        i = self.use[k]
        at = self.flat[self.ends[i] : self.ends[i + 1]]
        return np.append(at, self.more), np.append(np.ones(len(at)), self.earlier[i])


def _fold(k: int, flat: np.ndarray, ends: np.ndarray, earlier: np.ndarray, y: list[int], n_names: int) -> bytes:
    """The probabilities of fold k's rows by a model of the other rows; for k = FOLDS the weights of a model of all rows."""
    every = range(len(y))
    part = [i for i in every if i % FOLDS != k]
    model = _fit(_Rows(flat, ends, earlier, n_names, part), [y[i] for i in part], n_names + earlier.shape[1])
    if k < FOLDS:
        return _score(model, _Rows(flat, ends, earlier, n_names, list(every[k::FOLDS]))).tobytes()
    w = model.weights()
    return (w[:, 1] - w[:, 0]).tobytes()


def _folds(spark, flat: np.ndarray, ends: np.ndarray, earlier: np.ndarray, y: list[int], n_names: int) -> dict[int, np.ndarray]:
    """_fold() of every fold, a task each."""
    sent = spark.sparkContext.broadcast((flat, ends, earlier, y, n_names))

    def run(batches):
        for b in batches:
            ks = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"k": pa.array(ks, pa.int64()), "w": pa.array([_fold(k, *sent.value) for k in ks], pa.binary())})

    got = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "k bigint, w binary").collect()
    sent.unpersist()
    return {r["k"]: np.frombuffer(r["w"]) for r in got}


def train(
    df: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text",
    rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES,
) -> Chain:
    """Fits the chain on rows of df that have all labels 0 or 1.

    At most about `rows` labelled keys are used, taken by a hash of the key, and of their rows those that come first by a hash
    of key and text until the texts have most_bytes bytes (one row at least). The sample is so small enough to be collected
    and broadcast; folds are fitted by a task each. Rows of df that repeat key and text count once; keys with differing labels
    count as often as they are labelled. Without usable rows the chain has no models and predicts 0 throughout; with a single
    class it predicts that one; with fewer than MIN_ROWS rows, or words that no MIN_ROWS rows share, models are a bias only.
    """
    chain = Chain(categories)
    got = _sample(df, labels, categories, key, text, rows, most_bytes)
    if not got:
        return chain
    found = [f for f, _ in got]
    names, times = np.unique(np.concatenate(found), return_counts=True)
    names = names[times >= MIN_ROWS]
    sparse = []
    for f in found:
        at = np.searchsorted(names, f)
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == f)] if len(names) else np.empty(0, int)
        sparse.append(at.astype(np.int32))
    flat, ends = np.concatenate(sparse), np.cumsum([0, *map(len, sparse)])
    earlier = np.zeros((len(sparse), 0))
    for j in range(len(categories)):
        y = [labelled[j] for _, labelled in got]
        made = _folds(df.sparkSession, flat, ends, earlier, y, len(names))
        oof = np.zeros(len(sparse))
        for k in range(FOLDS):
            oof[k::FOLDS] = made[k]
        w = made[FOLDS]
        some = np.flatnonzero(w[: len(names)])
        chain.models.append((names[some], w[some], w[len(names) : len(names) + j], float(w[-1])))
        earlier = np.column_stack([earlier, oof])
    chain.threshold = _best_threshold(oof, np.array(y))
    return chain


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where the F1 score of out-of-fold predictions is largest, from 0.4 to 0.7, so that a text without known words is never rejected; of equal ones nearest to 0.5."""
    grid = np.linspace(0.4, 0.7, 31)
    f1 = [2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + (y == 1).sum()) for t in grid]
    best = np.flatnonzero(np.isclose(f1, max(f1)))
    return float(grid[best[np.argmin(abs(grid[best] - 0.5))]])


def predict(df: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) with __p_<category> of each category, and __rejected: whether the last one is predicted.

    A null text, and one without words, has probabilities of 0. Whole texts count; rows that repeat are predicted alike.
    Columns of df that have the names of outputs are replaced. A very long text costs memory for its distinct words only.
    """
    made = {f"__p_{c}" for c in chain.names} | {"__rejected"}
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    sent, mark = df.sparkSession.sparkContext.broadcast(pickle.dumps(chain, 5)), uuid.uuid4().hex
    names, held_text = chain.names, text if text in keep else f"__t{mark}"  # the text goes to Python once
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    schema += "".join(f", `__p_{c}` double" for c in names) + ", __rejected boolean"

    def make():
        m = held(("toxicity", mark), lambda: pickle.loads(sent.value))

        def run(r):
            p = [m.predict(features(t)) for t in r[held_text]]
            return {k: r[k] for k in keep} | {f"__p_{c}": [x[i] for x in p] for i, c in enumerate(names)} | {"__rejected": [x[-1] >= m.threshold for x in p]}

        return run

    return map_rows(df.select(*keep, *([] if text in keep else [F.col(text).alias(held_text)])), make, schema)
