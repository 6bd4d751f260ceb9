"""What lies outside the engine (models, web, GPU), behind one interface, with a stub that always answers alike."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from lexmill.operators.relational import todo


class Provider(Protocol):
    def __call__(self, prompt: str) -> str: ...


@dataclass
class Stub:
    """Answers with a JSON object made from a digest of the prompt."""

    seed: int = 0

    def __call__(self, prompt: str) -> str:
        d = hashlib.sha256(f"{self.seed}|{prompt}".encode()).digest()
        return json.dumps({"score": (d[0] % 5) / 4, "verdict": bool(d[1] & 1), "text": d.hex()[:16]})


@dataclass
class Retrying:
    """Calls a provider until valid() accepts the answer: waits double from `first` to `longest` seconds; gives up after `attempts`
    calls, or when the same invalid answer came twice."""

    inner: Callable[[str], str]
    valid: Callable[[str], bool] = lambda _: True
    attempts: int = 8
    first: float = 8.0
    longest: float = 60.0
    sleep: Callable[[float], None] = field(default=time.sleep)

    def __call__(self, prompt: str) -> str:
        wait, last, error = self.first, None, "no attempt was made"
        for n in range(self.attempts):
            try:
                got = self.inner(prompt)
                if self.valid(got):
                    return got
                error = "the answer isn't valid"
                if got == last:
                    break
                last = got
            except (OSError, TimeoutError) as e:
                error = str(e)
            if n + 1 < self.attempts:
                self.sleep(wait)
                wait = min(self.longest, 2 * wait)
        raise RuntimeError(error)


@dataclass
class Paced:
    """At least `gap` seconds between calls, and at most `budget` of them in this process."""

    inner: Callable[[str], str]
    gap: float = 0.0
    budget: int | None = None
    sleep: Callable[[float], None] = field(default=time.sleep)
    _next: float = 0.0
    _used: int = 0

    def __call__(self, prompt: str) -> str:
        if self.budget is not None and self._used >= self.budget:
            raise RuntimeError("out of budget")
        now = time.monotonic()
        if now < self._next:
            self.sleep(self._next - now)
        self._next, self._used = time.monotonic() + self.gap, self._used + 1
        return self.inner(prompt)


def allowed_source(url: str, refused: tuple[str, ...]) -> str:
    """The address, unless its host is one that asks not to be read."""
    from urllib.parse import urlsplit

    host = urlsplit(url).hostname or ""
    if any(host == r or host.endswith("." + r) for r in refused):
        raise PermissionError(f"{host} asks not to be read")
    return url


def ask(items: DataFrame, keys: list[str], prompt: str, make: Callable[[], Provider], done: DataFrame | None = None) -> DataFrame:
    """(keys, answer, error) of items that aren't done: an item is asked once, prompts that repeat are asked once for each item.

    make() builds a provider in each task. An error doesn't end the job: it stands in its row, and such rows aren't done.
    """
    from pyspark.sql import functions as F

    rest = items if done is None else todo(items, done, keys, F.col("error") != "")
    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys) + ", answer string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            answers, errors = [], []
            for p in f["__p"]:
                try:
                    answers.append(provider(p))
                    errors.append("")
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield f[keys].assign(answer=answers, error=errors)

    return rest.select(*keys, F.col(prompt).alias("__p")).mapInPandas(run, schema)


def ask_once_per_key(items: DataFrame, key: str, prompt: str, make: Callable[[], Provider]) -> DataFrame:
    """items with the answer for their key, each different key being asked once, with its smallest prompt."""
    from pyspark.sql import functions as F

    once = items.groupBy(key).agg(F.min(prompt).alias("__q"))
    return items.join(ask(once, [key], "__q", make).select(key, "answer"), key, "left")


#: What an answer is judged in, and the anchors that a quality goes to.
DIMENSIONS, ANCHORS = ("factor_recall", "grounding", "outcome", "verdict", "similarity", "quality"), (0.0, 0.25, 0.5, 0.75, 1.0)


def judge_dimensions(items: DataFrame, key: str, text, make: Callable[[], Provider]) -> DataFrame:
    """(key, factor_recall, similarity, quality, anchor, verdict, outcome, grounded): each dimension is a question of its own to the
    provider, whose answer is JSON with score and verdict; what isn't answered is null."""
    from pyspark.sql import functions as F

    asked = items.select(key, F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("dimension"), text.alias("__t"))
    asked = asked.withColumn("__p", F.concat("dimension", F.lit(": "), "__t")).drop("__t")
    got = ask(asked, [key, "dimension"], "__p", make)
    got = got.select(key, "dimension", F.from_json("answer", "score double, verdict boolean").alias("a"))
    of = lambda d, field: F.max(F.when(F.col("dimension") == d, F.col(f"a.{field}")))
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("quality") - a).alias("gap"), F.lit(a).alias("anchor")) for a in ANCHORS]))
    out = got.groupBy(key).agg(
        of("factor_recall", "score").alias("factor_recall"), of("similarity", "score").alias("similarity"), of("quality", "score").alias("quality"),
        of("verdict", "verdict").alias("verdict"), of("outcome", "verdict").alias("outcome"), of("grounding", "verdict").alias("grounded"),
    )
    return out.withColumn("anchor", F.when(F.col("quality").isNotNull(), near["anchor"])).select(key, "factor_recall", "similarity", "quality", "anchor", "verdict", "outcome", "grounded")
