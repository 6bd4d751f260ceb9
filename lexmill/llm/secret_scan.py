"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every text by fixed patterns and by a looser one for random-looking tokens. Hashes of their values
are counted over the whole corpus by distinct repositories and owners. A value that many owners have, or that stands in very
many repositories of whatever owners, is a copied example; one that a single owner has looks live. Loose candidates become
spans only if they look live; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_rows
from lexmill.session import Workspace

# The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "owned")

#: A loose candidate: so long, with a digit and both cases, and at least so many bits a character.
LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
MIN_BITS = 3.5
#: From so many distinct owners, or so many distinct repositories (forks of one owner's), on a value counts as a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: Values with a verdict other than `live` that redact() broadcasts, at 16 bytes each; more are joined by a shuffle.
MAX_BROADCAST_VALUES = 200_000


def _bits(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the candidates of one text, by start and kind; positions in code points."""
    if not text:
        return []
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    for m in LOOSE.finditer(text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and _bits(v) >= MIN_BITS:
            if not any(a < m.end() and m.start() < b for _, a, b, _ in out):
                out.append((3, *m.span(), v))
    return sorted(out, key=lambda x: (x[1], x[0]))


SPAN = "struct<kind:string,start:int,end:int,verdict:string>"


def _hash(value: str) -> bytes:
    return hashlib.sha256(value.encode()).digest()[:16]


def _who(repository: str, owner: str | None) -> tuple[Column, Column]:
    repo = F.col(repository).cast("string")
    return repo, F.col(owner).cast("string") if owner else F.substring_index(repo, "/", 1)


def _ownership(hits: DataFrame, example_owners: int, example_repositories: int) -> DataFrame:
    """(h, owners, repos, n, verdict) of each value from hits (h, o, r).

    (value, owner, repository) is counted on the map side first, so that a value copied everywhere stays cheap.
    """
    use = hits.groupBy("h", "o", "r").agg(F.count("*").alias("n"))
    use = use.groupBy("h", "o").agg(F.count("r").alias("repos"), F.sum("n").alias("n"))
    use = use.groupBy("h").agg(F.count("o").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))
    verdict = F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repositories), "example")
    return use.withColumn("verdict", verdict.when(F.col("owners") == 1, "live").when(F.col("owners") == 0, "unowned").otherwise("shared"))


def scan(
    df: DataFrame, text: str = "text", repository: str = "source", owner: str | None = None, keep: list[str] | None = None,
    example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """Every row of df (columns `keep`, all but the text by default) with __spans, the secrets found in its text.

    A span has kind (assign, access, hex, owned), start, end and verdict: `example` from example_owners distinct owners or
    example_repositories distinct repositories on, `live` with one owner, `unowned` where no row that has it names one, else
    `shared`. owner is a column; without one, it is what the repository's name has before its first slash. A null or empty
    text has no spans. Rows that repeat are scanned each; an empty table gives an empty one. A very long text is a block of
    its own in its task, with a list of its candidates.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("__spans",)]
    ws = Workspace(df.sparkSession, "secrets")
    repo, who = _who(repository, owner)
    narrow = df.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], repo.alias("r"), who.alias("o"), F.col(text).alias("t"))
    types = [f"k_{i}" for i in range(len(keep))]
    schema = ", ".join(f"{k} {narrow.schema[k].dataType.simpleString()}" for k in types)
    schema += (", " if types else "") + "r string, o string, found array<struct<kind:int,start:int,end:int,h:binary>>"

    def make():
        def run(rows):
            found = [[{"kind": k, "start": a, "end": b, "h": _hash(v)} for k, a, b, v in find(t)] for t in rows["t"]]
            return {k: rows[k] for k in (*types, "r", "o")} | {"found": found}

        return run

    docs = ws.write(map_rows(narrow, make, schema).withColumn("rid", F.monotonically_increasing_id()), "docs")
    hits = docs.where(F.size("found") > 0).select("rid", "r", "o", F.explode("found").alias("c")).select("rid", "r", "o", "c.*")
    use = ws.write(_ownership(hits, example_owners, example_repositories), "ownership")
    named = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    judged = (
        hits.select("rid", "kind", "start", "end", "h")
        .join(use.select("h", "verdict"), "h")
        .where((F.col("kind") < 3) | (F.col("verdict") == "live"))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict", named.alias("name")))).alias("s"))
        .select("rid", F.transform("s", lambda x: F.struct(x["name"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["verdict"].alias("verdict"))).alias("__spans"))
    )
    none = F.array().cast(f"array<{SPAN}>")
    out = docs.join(judged, "rid", "left")
    return out.select(*[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)], F.coalesce("__spans", none).alias("__spans"))


def without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with the mark in place of spans (start, end), which are in order; spans that overlap are replaced together."""
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(
    df: DataFrame, text: str = "text", repository: str = "source", owner: str | None = None, mark: str = "<secret>", n_chars: str | None = None,
    example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, max_broadcast: int = MAX_BROADCAST_VALUES,
) -> DataFrame:
    """df's own columns; in its text every span that isn't a copied example is replaced by the mark.

    Spans that overlap are replaced together. Rows without such spans, null texts among them, pass unchanged. n_chars names a
    column that follows the text's length. Two passes over the texts: the first gives hashes of candidates for the ownership
    table, the second finds the candidates again and looks their verdicts up, so that no text is shuffled. Values that aren't
    live are broadcast if they are at most max_broadcast (counted first); otherwise candidates of the texts that have some are
    joined with the ownership table, and the rows of those texts with their spans.
    """
    spark, names = df.sparkSession, df.columns
    ws = Workspace(spark, "redact")
    repo, who = _who(repository, owner)

    def candidates():
        def run(rows):
            out: dict[str, list] = {"r": [], "o": [], "h": []}
            for r, o, t in zip(rows["r"], rows["o"], rows["t"], strict=True):
                for _, _, _, v in find(t):
                    out["r"].append(r)
                    out["o"].append(o)
                    out["h"].append(_hash(v))
            return out

        return run

    hits = map_rows(df.select(repo.alias("r"), who.alias("o"), F.col(text).alias("t")), candidates, "r string, o string, h binary")
    use = ws.write(_ownership(hits, example_owners, example_repositories).select("h", "verdict"), "ownership")
    other = use.where("verdict <> 'live'")
    if other.count() <= max_broadcast:
        verdicts = spark.sparkContext.broadcast({bytes(r["h"]): r["verdict"] for r in other.collect()})

        def judge(_: list, t: str | None) -> list[tuple[int, int]]:
            known = verdicts.value
            found = [(k, a, b, known.get(_hash(v), "live")) for k, a, b, v in find(t)]
            return [(a, b) for k, a, b, v in found if v != "example" and (k < 3 or v == "live")]

        frame, spans = df, None
    else:
        spans = f"__s{ws.path[-12:]}"  # no column of df has such a name

        def judge(s: list | None, _: str | None) -> list[tuple[int, int]]:
            return [(x["start"], x["end"]) for x in s or [] if x["verdict"] != "example"]

        frame = scan(df, text, repository, owner, names, example_owners, example_repositories).withColumnRenamed("__spans", spans)

    def make():
        def run(rows):
            new = []
            for i, t in enumerate(rows[text]):
                found = judge(rows[spans][i] if spans else [], t)
                new.append(without(t, found, mark) if found else t)
            return {k: rows[k] for k in names} | {text: new}

        return run

    out = map_rows(frame, make, df.schema)
    return out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType)) if n_chars else out
