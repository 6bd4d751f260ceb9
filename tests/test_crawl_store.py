"""The crawl source (budget, pacing, cool-downs, resumption) and the content-addressed store (two phases, failures)."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexmill.sources import crawl, store

ROWS = [(f"{i:03d}", f"http://h{i % 2}.org/{'en' if i % 3 else 'de'}/{i}", f"2024-0{1 + i % 9}-01", f"h{i % 2}.org", "2024H1" if i % 9 < 6 else "2024H2", f"text {i}") for i in range(90)]
QUERIES = ["/de/", "/en/", "nothing like it", "/"]


@pytest.fixture
def site(spark, tmp_path):
    folder = str(tmp_path / "site")
    df = spark.createDataFrame(ROWS, "id string, url string, filed string, host string, window string, content string")
    df.write.partitionBy("host", "window").parquet(folder)
    os.mkdir(tmp_path / "log")
    return df.select("host", "window"), {"folder": folder, "size": 7, "log": str(tmp_path / "log")}, str(tmp_path / "answers")


def found(df):
    return sorted(r.id for r in crawl.first_found(df).collect())


def test_a_budget_is_kept_and_a_later_run_goes_on(spark, site, tmp_path):
    plan, args, answers = site
    log = tmp_path / "log"
    server = "lexmill.sources.crawl:FolderServer"
    some = found(crawl.crawl(spark, plan, QUERIES, server, args, answers, budget=10))
    assert len(os.listdir(log)) == 10 and 0 < len(some) < 90
    more = found(crawl.crawl(spark, plan, QUERIES, server, args, answers, budget=10))
    assert len(os.listdir(log)) == 20 and set(some) < set(more)
    assert found(crawl.crawl(spark, plan, QUERIES, server, args, answers)) == [r[0] for r in ROWS]
    asked = len(os.listdir(log))
    assert found(crawl.crawl(spark, plan, QUERIES, server, args, answers)) == [r[0] for r in ROWS]
    assert len(os.listdir(log)) == asked == len({(log / f).read_text() for f in os.listdir(log)})  # nothing was asked twice
    assert crawl.crawl(spark, plan.limit(0), QUERIES, server, args, answers).count() == 0


def test_a_killed_stream_resumes(spark, site, tmp_path):
    plan, args, answers = site
    trap, out = tmp_path / "trap", str(tmp_path / "out")
    made = crawl.options(plan, QUERIES, "lexmill.sources.crawl:FolderServer", args | {"trap": str(trap)}, answers, per_batch=9)
    spark.dataSource.register(crawl.CrawlSource)

    def run():
        stream = spark.readStream.format("crawl").options(**made).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(out).awaitTermination(120)

    run()
    first = spark.read.parquet(out).count()
    trap.write_text("")  # the next request ends its worker
    with pytest.raises(PySparkException):
        run()
    assert spark.read.parquet(out).count() == first and not trap.exists()
    before = -1
    while (now := spark.read.parquet(out).count()) != before:
        before = now
        run()
    rows = spark.read.parquet(out)
    assert found(rows) == [r[0] for r in ROWS]
    assert rows.count() == rows.select("host", "window", "request", "place").distinct().count()
    log = tmp_path / "log"
    texts = [(log / f).read_text() for f in os.listdir(log)]
    assert len(texts) - len(set(texts)) <= 1  # the request that was cut off


def test_client_pauses_waits_and_keeps_its_lane():
    waits, now = [], [1000.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    replies = [429, 503, 429, 500, 200]
    client = crawl.Client(lambda *_: crawl.Answer(replies.pop(0), []), cooldown=75, pauses=2, sleep=sleep, clock=lambda: now[0])
    assert client("h", "w", "q", None).status == 200 and waits == [75, 1.5, 75, 3.0] and client.used == 5
    with pytest.raises(crawl.Throttled):
        crawl.Client(lambda *_: crawl.Answer(429, []), pauses=1, sleep=sleep)("h", "w", "q", None)
    assert crawl.Client(lambda *_: crawl.Answer(503, []), attempts=3, sleep=sleep)("h", "w", "q", None).status == 503
    with pytest.raises(crawl.OutOfBudget):
        crawl.Client(lambda *_: crawl.Answer(503, []), budget=2, sleep=sleep)("h", "w", "q", None)

    def broken(*_):
        raise OSError("no route")

    assert crawl.Client(broken, attempts=2, sleep=sleep)("h", "w", "q", None).status == 599
    times = []
    for lane in range(3):  # three clients of one host side by side
        now[0] = 1000.3
        c = crawl.Client(lambda *_: crawl.Answer(200, []), gap=2.0, lane=lane, lanes=3, sleep=sleep, clock=lambda: now[0])
        for _ in range(4):
            c("h", "w", "q", None)
            times.append(round(now[0], 6))
    times.sort()
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) >= 2.0 - 1e-6


def test_failing_queries_are_rows_and_the_next_query_comes(tmp_path):
    def server(host, window, query, cursor):
        return crawl.Answer(404, []) if query == "bad" else crawl.Answer(200, [("1", "u", "x")], None)

    got = list(crawl.walk(crawl.Answers(str(tmp_path), "h", "w"), crawl.Client(server), "h", "w", ["bad", "good"]))
    assert [(n, a["error"], len(a["results"])) for n, a in got] == [(0, "http 404", 0), (1, "", 1)]
    assert crawl.Answers(str(tmp_path), "h", "w").count() == (2, True)


PAGE = "<html><title>{}</title>{}</html>"


def test_store_saves_each_content_once(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [(1, PAGE.format("a", "x")), (2, PAGE.format("a", "x")), (None, PAGE.format("a", "x")), (3, PAGE.format("404", "y")), (4, ""), (5, None), (6, "%PDF-1"), (7, PAGE.format("b", "z"))]
    df = spark.createDataFrame(rows, "key int, content string").repartition(3)
    got = {r.key: r.decision for r in store.save(df, root, "key", "content", kind="html").collect()}
    assert got == {"1": "duplicate", "2": "duplicate", None: "saved", "3": "refused", "4": "empty", "5": "empty", "6": "refused", "7": "saved"}
    packs = store.committed(root)
    assert store.objects(spark, root).where("sha2(content, 256) <> digest").count() == 0 and store.objects(spark, root).count() == 2
    again = {r.key: r.decision for r in store.save(df, root, "key", "content", kind="html").collect()}
    assert again["7"] == again["1"] == "exists" and store.committed(root) == packs and len(os.listdir(f"{root}/commits")) == 1
    assert store.audit(spark, root).groupBy("decision").count().count() == 5 and store.audit(spark, root).count() == 16
    store.save(df.limit(0), root, "key", "content")
    assert store.committed(root) == packs


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    spark.dataSource.register(store.ContentStore)
    bad = F.when(F.col("id") == 1900, F.raise_error(F.lit("broken"))).otherwise(F.lit("x"))
    df = spark.range(0, 2000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), bad.alias("kind"), F.lit(1).cast("bigint").alias("bytes"), F.lit("c").cast("binary").alias("content"))
    with pytest.raises(PySparkException):
        df.write.format("content_store").mode("append").option("path", root).save()
    left = [f for d, _, names in os.walk(root) for f in names]
    assert left == [] and store.committed(root) == [] and store.objects(spark, root).count() == 0
    with pytest.raises(PySparkException):
        df.write.format("content_store").mode("overwrite").option("path", root).save()
    df.where("id < 1000").write.format("content_store").mode("append").option("path", root).save()
    assert store.objects(spark, root).count() == 1000
    commit = next(os.scandir(f"{root}/commits")).path
    assert json.load(open(commit))["objects"] == 1000
