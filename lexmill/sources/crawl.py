"""A data source that crawls: a plan of queries over hosts and half-year windows, cursor pages, a budget, pacing and cool-downs.

A partition is a host and a window. Its requests are numbered: all pages of the first query, then those of the next. Every
answer is saved under its number as soon as it is there, so that a task which starts again, or a later run with a new budget,
asks only for what isn't there yet; where request n goes follows from the answer to request n - 1, its cursor among it. The
stream's offsets are numbers of requests for each partition; a micro-batch that is run again gives the same rows.

Servers are handed in by name (module:class), as tasks make their own: FolderServer serves a folder written by Spark.
"""

from __future__ import annotations

import gzip
import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "host string, window string, request int, query int, page int, place int, id string, url string, content string, error string"
#: Partitions of a plan at most, as the driver lists them.
MOST_PARTITIONS = 100_000


class Answer(NamedTuple):
    """What a server says: an HTTP status, (id, url, content) of each result, and the next page's cursor, if there is one."""

    status: int
    results: list[tuple[str, str, str]]
    cursor: str | None = None


class Server(Protocol):
    def __call__(self, host: str, window: str, query: str, cursor: str | None) -> Answer: ...


class OutOfBudget(RuntimeError):
    """No more requests may be made; what is missing is asked for by a later run."""


class Throttled(RuntimeError):
    """The server still refuses after all pauses."""


@dataclass
class Client:
    """Asks a server: at least `gap` seconds apart, at most `budget` times. Of `lanes` clients of one host that run side by
    side each keeps to its own lane of time, so that the host sees one request a gap without them talking to each other.

    A status of 429 is answered by a pause of `cooldown` seconds, `pauses` times in all; one of 500 and more, or an OSError,
    by waits that double from `first` seconds up to `longest`, `attempts` calls in all.
    """

    server: Server
    gap: float = 0.0
    lane: int = 0
    lanes: int = 1
    budget: int | None = None
    cooldown: float = 75.0
    pauses: int = 4
    attempts: int = 4
    first: float = 1.5
    longest: float = 30.0
    sleep: Callable[[float], None] = field(default=time.sleep)
    clock: Callable[[], float] = field(default=time.time)
    used: int = 0
    _slot: int = -1

    def _pace(self) -> None:
        if self.gap <= 0:
            return
        turn = self.gap * self.lanes
        now = self.clock() - self.lane * self.gap
        self._slot = max(self._slot + 1, -int(-now // turn))
        self.sleep(max(0.0, self._slot * turn - now))

    def __call__(self, host: str, window: str, query: str, cursor: str | None) -> Answer:
        wait, failed = self.first, 0
        while True:
            if self.budget is not None and self.used >= self.budget:
                raise OutOfBudget(f"{self.used} requests made")
            self.used += 1
            self._pace()
            try:
                got = self.server(host, window, query, cursor)
            except OSError as e:
                got = Answer(599, [("", "", str(e))])
            if got.status == 429:
                if self.pauses <= 0:
                    raise Throttled(f"{host} still refuses after all pauses")
                self.pauses -= 1
                self.sleep(self.cooldown)
            elif got.status >= 500 and failed + 1 < self.attempts:
                failed += 1
                self.sleep(wait)
                wait = min(self.longest, 2 * wait)
            else:
                return got


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Answers:
    """Saved answers of one partition, by number."""

    def __init__(self, store: str, host: str, window: str):
        self.fs, root = _file_system(store)
        self.folder = f"{root}/{host}/{window}"

    def get(self, n: int) -> dict | None:
        from pyarrow import fs

        path = f"{self.folder}/{n:09d}.json.gz"
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path, compression=None) as f:
            return json.loads(gzip.decompress(f.read()))

    def put(self, n: int, answer: dict) -> None:
        """Under a name of its own first, so that no half-written answer is ever found."""
        self.fs.create_dir(self.folder, recursive=True)
        new = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(new, compression=None) as f:
            f.write(gzip.compress(json.dumps(answer).encode(), 1))
        self.fs.move(new, f"{self.folder}/{n:09d}.json.gz")

    def count(self) -> tuple[int, bool]:
        """How many there are, and whether the last one is the end of the partition."""
        from pyarrow import fs

        names = [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))]
        n = sum(x.endswith(".json.gz") for x in names)
        return n, n > 0 and _after(self.get(n - 1)) is None


def _after(answer: dict) -> tuple[int, int, str | None] | None:
    """(query, page, cursor) of the request after one, None after the last."""
    if answer["cursor"] is not None:
        return answer["query"], answer["page"] + 1, answer["cursor"]
    return (answer["query"] + 1, 0, None) if answer["query"] + 1 < answer["queries"] else None


def walk(answers: Answers, client: Client, host: str, window: str, queries: list[str], start: int = 0, end: int | None = None) -> Iterator[tuple[int, dict]]:
    """(number, answer) of the requests from start to end (all by default), saved ones from the store.

    A query that fails for good is an answer with an error, after which the next query comes. Ends early out of budget.
    """
    at: tuple[int, int, str | None] | None = (0, 0, None) if queries else None
    if start:
        before = answers.get(start - 1)
        at = _after(before) if before else None
    n = start
    while at is not None and (end is None or n < end):
        saved = answers.get(n)
        if saved is None:
            query, page, cursor = at
            try:
                got = client(host, window, queries[query], cursor)
            except OutOfBudget:
                return
            fine = got.status == 200
            saved = {"query": query, "page": page, "queries": len(queries), "cursor": got.cursor if fine else None,
                     "results": [list(r) for r in got.results] if fine else [], "error": "" if fine else f"http {got.status}"}
            answers.put(n, saved)
        yield n, saved
        at, n = _after(saved), n + 1


class Stretch(InputPartition):
    """Requests of one host and window, with their share of the budget and their lane."""

    def __init__(self, host: str, window: str, start: int, end: int | None, budget: int | None, lane: int, lanes: int):
        self.host, self.window, self.start, self.end, self.budget, self.lane, self.lanes = host, window, start, end, budget, lane, lanes


class _Crawl:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.o = dict(options)
        self.plan: list[list[str]] = json.loads(self.o["plan"])
        self.queries: list[str] = json.loads(self.o["queries"])
        self.budget = int(self.o["budget"]) if self.o.get("budget") else None
        hosts: dict[str, int] = {}
        self.lane = {}
        for host, window in self.plan:
            self.lane[host, window] = hosts[host] = hosts.get(host, -1) + 1
        self.lanes = {h: n + 1 for h, n in hosts.items()}

    def stretch(self, host: str, window: str, start: int, end: int | None, budget: int | None) -> Stretch:
        return Stretch(host, window, start, end, budget, self.lane[host, window], self.lanes[host])

    def read(self, p: Stretch) -> Iterator[pa.RecordBatch]:
        module, _, name = self.o["server"].partition(":")
        server = getattr(importlib.import_module(module), name)(**json.loads(self.o.get("server_args", "{}")))
        client = Client(server, float(self.o.get("gap", 0)), p.lane, p.lanes, p.budget, float(self.o.get("cooldown", 75)))
        for n, a in walk(Answers(self.o["store"], p.host, p.window), client, p.host, p.window, self.queries, p.start, p.end):
            rows = a["results"] or ([[None, None, None]] if a["error"] else [])
            if rows:
                k = len(rows)
                ids, urls, contents = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.host] * k), pa.array([p.window] * k), *(pa.array([x] * k, pa.int32()) for x in (n, a["query"], a["page"])), pa.array(range(k), pa.int32()),
                     pa.array(ids, pa.string()), pa.array(urls, pa.string()), pa.array(contents, pa.string()), pa.array([a["error"] or None] * k, pa.string())],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )


class BatchReader(_Crawl, DataSourceReader):
    """All that is missing, and what was saved before; the budget is shared out evenly."""

    def partitions(self) -> list[Stretch]:
        n = len(self.plan)
        share = [None] * n if self.budget is None else [self.budget // n + (i < self.budget % n) for i in range(n)]
        return [self.stretch(h, w, 0, None, b) for (h, w), b in zip(self.plan, share, strict=True)]


class StreamReader(_Crawl, DataSourceStreamReader):
    """Micro-batches of at most `per_batch` requests, dealt out in turn to the partitions that aren't at their end."""

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        """Requests that were answered before, and those to make now: how far the partitions are is known by their answers."""
        there = [Answers(self.o["store"], h, w).count() for h, w in self.plan]
        done = sum(n for n, _ in there)
        left = int(self.o.get("per_batch", len(self.plan)))
        left = left if self.budget is None else min(left, max(0, self.budget - done))
        live = [i for i, (_, ended) in enumerate(there) if not ended]
        more = {i: left // len(live) + (k < left % len(live)) for k, i in enumerate(live)}
        return {f"{h} {w}": there[i][0] + more.get(i, 0) for i, (h, w) in enumerate(self.plan)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        spans = [(h, w, start.get(f"{h} {w}", 0), end.get(f"{h} {w}", 0)) for h, w in self.plan]
        return [self.stretch(h, w, a, b, None) for h, w, a, b in spans if b > a]

    def commit(self, end: dict[str, int]) -> None:
        pass


class CrawlSource(DataSource):
    """format("crawl") with the options plan (JSON list of [host, window]), queries (JSON list), server (module:class),
    server_args (JSON), store (folder of the answers), budget, gap, cooldown and, for a stream, per_batch."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def options(plan: DataFrame, queries: list[str], server: str, server_args: dict[str, Any], store: str, **more: Any) -> dict[str, str]:
    """Options of the source from a table (host, window) of what is to be crawled, which is counted first."""
    rows = plan.select("host", "window").distinct().orderBy("host", "window").limit(MOST_PARTITIONS + 1).collect()
    if len(rows) > MOST_PARTITIONS:
        raise ValueError("more hosts and windows than the driver lists")
    made = {"plan": json.dumps([[r["host"], r["window"]] for r in rows]), "queries": json.dumps(queries), "server": server, "server_args": json.dumps(server_args), "store": store}
    return made | {k: str(v) for k, v in more.items() if v is not None}


def crawl(spark: SparkSession, plan: DataFrame, queries: list[str], server: str, server_args: dict[str, Any], store: str, **more: Any) -> DataFrame:
    """(host, window, request, query, page, place, id, url, content, error) of all answers that the budget allows.

    Results that several queries find come for each; see first_found. An empty plan gives no rows.
    """
    made = options(plan, queries, server, server_args, store, **more)
    if made["plan"] == "[]":
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(CrawlSource)
    return spark.read.format("crawl").options(**made).load()


def first_found(found: DataFrame) -> DataFrame:
    """One row for each id: that of the earliest query, then request and place, by host and window. Errors are left out."""
    order = F.struct("query", "request", "place", "host", "window")
    return found.where("error is null").groupBy("id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "id"]), order).alias("x")).select("id", "x.*")


class FolderServer:
    """A stand-in for a site: serves Parquet below folder/host=…/window=… (id, url, filed, content) in pages, newest first.

    A query matches a url that holds it. `log`, if given, gets a file for each request made. With `trap`, a file's path, the
    request at which it exists ends the process (to test resumption).
    """

    def __init__(self, folder: str, size: int = 100, log: str | None = None, trap: str | None = None):
        self.folder, self.size, self.log, self.trap = folder, size, log, trap
        self._held: tuple[str, pa.Table] | None = None

    def _rows(self, host: str, window: str) -> pa.Table:
        import pyarrow.dataset as ds

        fs, root = _file_system(self.folder)
        path = f"{root}/host={host}/window={window}"
        if self._held is None or self._held[0] != path:
            from pyarrow import fs as pafs

            there = fs.get_file_info(path).type == pafs.FileType.Directory
            table = ds.dataset(path, filesystem=fs, format="parquet").to_table(["id", "url", "filed", "content"]) if there else pa.table({c: pa.array([], pa.string()) for c in ("id", "url", "filed", "content")})
            self._held = path, table.sort_by([("filed", "descending"), ("id", "ascending")])
        return self._held[1]

    def __call__(self, host: str, window: str, query: str, cursor: str | None) -> Answer:
        import os

        import pyarrow.compute as pc

        if self.log:
            with open(f"{self.log}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{host} {window} {query} {cursor}")
        if self.trap and os.path.exists(self.trap):
            os.remove(self.trap)
            os._exit(1)
        rows = self._rows(host, window)
        hits = rows.filter(pc.match_substring(rows["url"], query))
        at = int(cursor or 0)
        part = hits.slice(at, self.size)
        results = [(str(r["id"]), r["url"], r["content"]) for r in part.to_pylist()]
        return Answer(200, results, str(at + self.size) if at + self.size < len(hits) else None)
