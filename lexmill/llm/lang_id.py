"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

The classifier is fitted by FTRL with an elastic net on a bounded sample of labelled rows; document frequencies count all
labelled rows. A temperature, fitted on part of the sample that training doesn't see, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks, held, map_rows
from lexmill.llm.ftrl import Ftrl, softmax, temperature

#: Features: hashes of lower-cased 1-, 2- and 3-grams.
BITS = 15
DIM = 1 << BITS
#: Rows of the fitting sample in all (about as many of each language), and the most languages that are learned.
TRAIN_ROWS, MAX_LANGS = 4000, 500
_PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def counts(text: str) -> np.ndarray | None:
    """How often each feature occurs in the text; None if it has no letter. What is no letter counts as a space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    plain = codes < 0x10000
    letter = _letters()[np.where(plain, codes, 0)]
    if not plain.all():
        letter[~plain] = [chr(c).isalpha() for c in codes[~plain].tolist()]
    if not letter.any():
        return None
    codes = np.concatenate([[np.uint32(32)], np.where(letter, codes, np.uint32(32)), [np.uint32(32)]]).astype(np.uint32)
    a = codes * np.uint32(_PRIMES[0])
    b = a[:-1] * np.uint32(_PRIMES[1]) ^ a[1:]
    c = b[:-1] * np.uint32(_PRIMES[2]) ^ a[2:]
    out = np.zeros(DIM)
    for h in (a, b * np.uint32(_PRIMES[1]), c * np.uint32(_PRIMES[2])):
        out += np.bincount(h >> np.uint32(32 - BITS), minlength=DIM)
    return out


class Model:
    """Languages, and scaled weights: probabilities are softmax(x @ weights / (|x * idf|) + bias)."""

    def __init__(self, langs: list[str], idf: np.ndarray, ftrl: Ftrl, heat: float):
        w = ftrl.weights()
        self.langs, self.idf = langs, idf
        self.weights, self.bias = idf[:, None] * w[:-1] / heat, w[-1] / heat

    def predict(self, text: str | None) -> tuple[str, float]:
        x = counts(text) if text and self.langs else None
        if x is None:
            return "und", 0.0
        norm = np.linalg.norm(x * self.idf)
        p = softmax(x @ self.weights / (norm or 1.0) + self.bias)
        best = int(np.argmax(p))  # of equal ones the first: languages are sorted
        return self.langs[best], float(p[best])


def _frequencies(df: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each feature occurs, and how many rows there are; counted over all rows of df (column t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for part in blocks(b):
                for t in part.column(0).to_pylist():
                    if t and (x := counts(t)) is not None:
                        df_ += x > 0
                        n += 1
        at = np.flatnonzero(df_)
        yield pa.RecordBatch.from_pydict({"f": pa.array(np.append(at, -1).astype(np.int32)), "n": pa.array(np.append(df_[at], n))})

    out, n = np.zeros(DIM, np.int64), 0
    for f, c in df.select("t").mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():
        if f < 0:
            n = c
        else:
            out[f] = c
    return out, n


def train(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fits a model on the rows where learn holds; key only decides which rows the sample holds.

    At most about `rows` rows are fitted on (the bound is on the sample's expected size). Rows without text or language are
    left out. Without any row the model knows no language.
    """
    usable = df.where(learn & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(key)).alias("h"))
    sizes = dict(usable.groupBy("lang").count().limit(MAX_LANGS + 1).collect())
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages, which is what a model is made for")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones(DIM), Ftrl(DIM, 1), 1.0)
    freq, n = _frequencies(usable)
    idf = np.log((1 + n) / (1 + freq)) + 1
    share = rows / len(langs)
    limit = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, share / sizes[k]))])
    sample = usable.where(F.col("lang").isin(langs)).where(F.pmod("h", F.lit(1 << 20)) < limit[F.col("lang")] * (1 << 20))

    def sparse():
        def run(r):
            out = {"lang": [], "h": [], "idx": [], "cnt": []}
            for k, t, h in zip(r["lang"], r["t"], r["h"], strict=True):
                if t and (x := counts(t)) is not None:
                    at = np.flatnonzero(x)
                    out["lang"].append(k)
                    out["h"].append(h)
                    out["idx"].append(at.astype(np.uint16).tobytes())
                    out["cnt"].append(x[at].astype(np.float32).tobytes())
            return out

        return run

    got = sorted(map_rows(sample, sparse, "lang string, h bigint, idx binary, cnt binary").collect(), key=lambda r: (r["h"], r["lang"], r["idx"], r["cnt"]))
    xs, ys = [], []
    for r in got:
        at = np.frombuffer(r["idx"], np.uint16).astype(np.int64)
        x = np.frombuffer(r["cnt"], np.float32) * idf[at]
        xs.append((at, x / np.linalg.norm(x)))
        ys.append(langs.index(r["lang"]))
    fit = [i for i in range(len(xs)) if i % 5]
    kept = [i for i in range(len(xs)) if not i % 5]
    model = Ftrl(DIM, len(langs), alpha=1.0, l1=0.02, l2=0.1).fit([xs[i] for i in fit], [ys[i] for i in fit])
    w = model.weights()
    logits = np.array([xs[i][1] @ w[xs[i][0]] + w[-1] for i in kept]).reshape(len(kept), len(langs))
    return Model(langs, idf, model, temperature(logits, np.array([ys[i] for i in kept], int)))


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) with __lang_pred and __score: the likeliest language and its probability.

    A null text, and one without letters, gets `und` and 0. Every row gets a prediction, repeated ones too; whole texts count.
    """
    import pickle
    import uuid

    keep = [c for c in (df.columns if keep is None else keep) if c not in ("__lang_pred", "__score")]
    sent, mark = df.sparkSession.sparkContext.broadcast(pickle.dumps(model, 5)), uuid.uuid4().hex
    held_text = text if text in keep else f"__t{mark}"  # the text goes to Python once
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep) + ", __lang_pred string, __score double"

    def make():
        m = held(("language", mark), lambda: pickle.loads(sent.value))

        def run(r):
            got = [m.predict(t) for t in r[held_text]]
            return {k: r[k] for k in keep} | {"__lang_pred": [a for a, _ in got], "__score": [b for _, b in got]}

        return run

    return map_rows(df.select(*keep, *([] if text in keep else [F.col(text).alias(held_text)])), make, schema)
