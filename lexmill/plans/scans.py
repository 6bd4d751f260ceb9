"""Queries that write the driver's tables in the formats of the domain and read them back by the sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexmill.functions.numbers import millionths
from lexmill.plans.registry import query
from lexmill.session import Workspace
from lexmill.sources import readers, sinks


def _at(t, name: str) -> str:
    return Workspace(t.spark, "scans").at(name)


def _few(df) -> list:
    """All rows of a short table, whose files the driver writes one by one; more rows than that are an error."""
    rows = df.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more rows than the driver writes files for")
    return rows


def _md5(c):
    return F.md5(c.cast("binary"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text) AS text FROM conversations")
def csv_round_trip(t):
    """CSV with line breaks and quotes in cells, columns in a fixed order, others left out."""
    path = _at(t, "csv")
    sinks.write_csv(t.conversations.withColumn("more", F.lit(1)), path, ["conv_id", "turn", "role", "text"])
    return readers.csv_rows(t.spark, path).select("conv_id", "turn", "role", _md5(F.col("text")).alias("text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def csv_quoted(t):
    """Every cell in quotes."""
    path = _at(t, "quoted")
    sinks.write_csv(t.part, path, ["p_partkey", "p_name", "p_brand"], quote_all=True)
    return readers.csv_rows(t.spark, path)


@query("SELECT p_partkey, p_name, p_brand AS model FROM part")
def csv_by_model(t):
    """Many files, the model from where a file is."""
    path = _at(t, "models")
    t.part.select("p_partkey", "p_name", F.replace("p_brand", F.lit("#"), F.lit("-")).alias("slug")).write.partitionBy("slug").csv(path, header=True)
    out = readers.csv_by_model(t.spark, f"{path}/*/", r"slug=([^/]+)/", "p_partkey bigint, p_name string, model string")
    return out.withColumn("model", F.replace("model", F.lit("-"), F.lit("#")))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def append_log(t):
    """Rows added to a log in turn."""
    path = _at(t, "log")
    for status in ("F", "O", "P"):
        sinks.append(t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus"), path, "json")
    return t.spark.read.schema("o_orderkey bigint, o_orderstatus string").json(path)


@query("SELECT id, prompt, truth FROM (SELECT c_custkey//7 AS id, c_name AS prompt, c_mktsegment AS truth, row_number() OVER (PARTITION BY c_custkey//7 ORDER BY c_custkey DESC) AS k FROM customer) WHERE k=1")
def json_records(t):
    """Arrays of records; the last record of equal ids wins."""
    path = _at(t, "arrays")
    rec = F.struct(F.floor(F.col("c_custkey") / 7).alias("id"), F.col("c_name").alias("prompt"), F.col("c_mktsegment").alias("truth"))
    arrays = t.customer.groupBy(F.floor(F.col("c_custkey") / 700).alias("part")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", rec.alias("r")))).alias("a"))
    arrays.select("part", F.to_json(F.transform("a", lambda x: x["r"])).alias("value")).write.partitionBy("part").text(path)
    return readers.json_records(t.spark, f"{path}/*/", "id bigint, prompt string, truth string", key="id")


@query("SELECT event_id, event_type, value FROM events")
def json_lines_tolerant(t):
    """JSON Lines with broken lines in between, which are left out."""
    path = _at(t, "lines")
    good = t.events.select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    good.union(t.events.where("event_id % 10 = 0").select(F.lit('{"event_id": broken'))).write.text(path)
    return readers.json_lines(t.spark, path, "event_id bigint, event_type string, value double", tolerant=True)


@query("SELECT 'lines' AS form, n_nationkey AS case_id, n_name AS answer FROM nation UNION ALL SELECT 'array', n_nationkey, n_name FROM nation")
def json_any(t):
    """An array or lines, told apart by the first character, with names of their own."""
    lines, array = _at(t, "lines"), _at(t, "array")
    rows = t.nation.select(F.col("n_nationkey").alias("case"), F.col("n_name").alias("response"))
    rows.write.json(lines)
    sinks.named_files(t.spark, array, {"all.json": json.dumps([r.asDict() for r in _few(rows)])})  # 25 nations
    names = {"case": "case_id", "response": "answer"}
    both = [readers.json_any(t.spark, p, names).select(F.lit(k).alias("form"), F.col("case_id").cast("int").alias("case_id"), "answer") for k, p in (("lines", lines), ("array", array))]
    return both[0].union(both[1])


@query("SELECT count(*) AS regions, max(r_name) AS last FROM region")
def json_document(t):
    """A small document saved and read, with an error if a section is missing."""
    folder = _at(t, "stats")
    s = t.region.agg(F.count("*").alias("regions"), F.max("r_name").alias("last")).first()
    sinks.save_json(t.spark, folder, "stats.json", {"regions": s["regions"], "last": s["last"], "more": [1]})
    return readers.json_document(t.spark, f"{folder}/stats.json", "regions bigint, last string")


@query("SELECT n_regionkey AS case_id, CASE WHEN n_nationkey%2=0 THEN 'even' ELSE 'odd' END AS model, CASE WHEN n_nationkey%5=0 THEN n_name ELSE 'concept '||n_nationkey%3 END AS feature, n_nationkey%7 AS importance FROM nation WHERE n_nationkey%4<>3")
def selections(t):
    """A map of cases to chosen features, in long form, with features renamed or dropped by a mapping."""
    folder, cases = _at(t, "selections"), {}
    rows = _few(t.nation)  # 25 nations
    for r in rows:
        k, i = f"d:{r['n_regionkey']}", r["n_nationkey"]
        case = cases.setdefault(k, {"dataset": "d", "case_id": r["n_regionkey"], "superset": [], "features": {}})
        case["features"][f"f{i}"] = {"model": "even" if i % 2 == 0 else "odd", "model_family": "m", "feature": r["n_name"], "importance": i % 7, "superset_index": None}
    sinks.save_json(t.spark, folder, "case_feat.json", cases)
    key = F.col("n_nationkey")
    mapping = t.nation.where(key % 5 != 0).select(F.col("n_name").alias("feature"), F.when(key % 4 != 3, F.concat(F.lit("concept "), (key % 3).cast("string"))).alias("concept"))
    drop = t.nation.where((key % 5 == 0) & (key % 4 == 3)).select(F.col("n_name").alias("feature"), F.lit(None).cast("string").alias("concept"))
    out = readers.selections(t.spark, f"{folder}/case_feat.json", mapping.union(drop))
    return out.select(F.col("case_id").cast("int").alias("case_id"), "model", "feature", "importance")


@query("SELECT n_name AS case_id, n_regionkey AS year, CASE n_nationkey%3 WHEN 0 THEN 'own' WHEN 1 THEN 'pre_cutoff' ELSE 'post_cutoff_control' END AS arm FROM nation")
def manifest(t):
    """Cases of a manifest in either layout."""
    folder, parts = _at(t, "manifest"), {"cases": [], "pre_cutoff": [], "post_cutoff_control": []}
    for r in _few(t.nation):  # 25 nations
        name = ("cases", "pre_cutoff", "post_cutoff_control")[r["n_nationkey"] % 3]
        parts[name].append({"case_id": r["n_name"], "year": r["n_regionkey"], "arm": "own"})
    sinks.save_json(t.spark, folder, "m.json", {"court": parts})
    return readers.manifest(t.spark, f"{folder}/m.json", "court").select("case_id", "year", "arm")


@query("SELECT n_name AS case_id, CASE WHEN n_nationkey%3=0 THEN 'fetched' WHEN n_nationkey%3=1 THEN 'pdf_clean' ELSE 'pdf_raw' END AS text_source, md5(CASE WHEN n_nationkey%3=0 THEN repeat(n_name||' a ',30) WHEN n_nationkey%3=1 THEN repeat(n_name||' b ',30) ELSE repeat(n_name||' c ',30) END) AS text FROM nation")
def whole_texts(t):
    """Whole texts, from the first source that has a long enough one."""
    folder, rows = _at(t, "texts"), _few(t.nation)  # 25 nations
    names = ("fetched", "pdf_clean", "pdf_raw")
    for k, (name, letter) in enumerate(zip(names, "abc", strict=True)):
        files = {f"{r['n_name']}.txt": f"{r['n_name']} {letter} " * 30 if r["n_nationkey"] % 3 <= k else "short" for r in rows}
        sinks.named_files(t.spark, f"{folder}/{name}", files)
    out = readers.whole_texts(t.spark, [(n, f"{folder}/{n}") for n in names])
    return out.select("case_id", "text_source", _md5(F.col("text")).alias("text"))


@query("SELECT n_name||'.bin' AS name, CAST(k AS INTEGER) AS page, n_name||' page '||k AS text FROM nation, unnest(range(0, n_nationkey%3+1)) AS t(k)")
def document_pages(t):
    """Pages of binary documents by an extractor that is handed in; here pages end at a form feed."""
    folder = _at(t, "binary")
    rows = _few(t.nation)  # 25 nations
    sinks.named_files(t.spark, folder, {f"{r['n_name']}.bin": "\f".join(f"{r['n_name']} page {k}" for k in range(r["n_nationkey"] % 3 + 1)) for r in rows})
    out = readers.pages(t.spark, folder, lambda b: b.decode().split("\f"))
    return out.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "page", "text")


@query("SELECT n_name||'.txt' AS name, CASE WHEN n_nationkey%2=0 THEN 'first' ELSE 'second' END AS folder FROM nation")
def file_index(t):
    """Where a file of each name is, in the first folder that has it."""
    folder, rows = _at(t, "index"), _few(t.nation)  # 25 nations
    sinks.named_files(t.spark, f"{folder}/first", {f"{r['n_name']}.txt": "x" for r in rows if r["n_nationkey"] % 2 == 0})
    sinks.named_files(t.spark, f"{folder}/second", {f"{r['n_name']}.txt": "y" for r in rows})
    out = readers.file_index(t.spark, [f"{folder}/first", f"{folder}/second"])
    return out.select("name", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))


@query("SELECT n_nationkey AS id, CASE n_nationkey%2 WHEN 0 THEN 'mcq' ELSE 'essay' END AS content_type, n_name||CASE n_nationkey%2 WHEN 0 THEN '_MCQ.json' ELSE '_essay.json' END AS file FROM nation")
def typed_tree(t):
    """All files below a folder, with a type from the end of their names."""
    folder, rows = _at(t, "tree"), _few(t.nation)  # 25 nations
    for r in rows:
        name = r["n_name"] + ("_essay.json" if r["n_nationkey"] % 2 else "_MCQ.json")
        sinks.named_files(t.spark, f"{folder}/{r['n_regionkey']}/deep", {name: json.dumps([{"id": r["n_nationkey"], "topic": "t"}])})
    out = readers.typed_tree(t.spark, folder, {"_mcq.json": "mcq", "_essay.json": "essay"})
    return out.select(F.col("id").cast("int").alias("id"), "content_type", F.col("_file").alias("file"))


@query("SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes, CASE WHEN regexp_matches(ltrim(lower(substr(html,1,200))),'^<(!doctype html|html)') THEN 'html' WHEN ltrim(substr(html,1,200))='' THEN 'empty' ELSE 'other' END AS kind, first FROM (SELECT page_id, html, page_id=min(page_id) OVER (PARTITION BY sha256(html)) AS first FROM pages)")
def content_addressed(t):
    """What a content is kept under, what kind it is, and which row would be the one that saves it."""
    x = sinks.content_addressed(t.pages.select("page_id", "html"), "html")
    saved = x.groupBy("sha256").agg(F.min("page_id").alias("__first"))
    x = x.join(saved, "sha256")
    return x.select("page_id", "sha256", F.col("bytes").cast("long").alias("bytes"), "kind", (F.col("page_id") == F.col("__first")).alias("first"))


@query("SELECT page_id, regexp_matches(lower(regexp_extract(url,'^[a-zA-Z]+://([^/:?#]+)',1)),'(^|\\.)example\\.(org|net)$') AS refused FROM pages")
def refused_sources(t):
    """Addresses on hosts that ask not to be read."""
    return t.pages.select("page_id", readers.refused(F.col("url"), ["example.org", "example.net"]).alias("refused"))


@query("SELECT user_id, min(value) FILTER (WHERE event_type='click') AS click, min(value) FILTER (WHERE event_type='error') AS error, min(value) FILTER (WHERE event_type='purchase') AS purchase, min(value) FILTER (WHERE event_type='signup') AS signup, min(value) FILTER (WHERE event_type='view') AS view FROM events GROUP BY user_id")
def wide_table(t):
    """A column for each name that the data have."""
    return sinks.wide(t.events, "user_id", "event_type", "value").select("user_id", "click", "error", "purchase", "signup", "view")


@query("SELECT md5('## '||p_name||' '||p_partkey||chr(10)||chr(10)||'**p_brand**'||chr(10)||chr(10)||'> '||p_brand||chr(10)||chr(10)||'**p_type**'||chr(10)||chr(10)||'> '||p_type||chr(10)||'> more'||chr(10)||chr(10)) AS section, count(*) AS n FROM part GROUP BY 1")
def rating_packet(t):
    """A Markdown section for each item, with its fields as quotations."""
    path = _at(t, "packet")
    x = t.part.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), "p_brand", F.concat("p_type", F.lit("\nmore")).alias("p_type"))
    sinks.packet(x, path, "title", ["p_brand", "p_type"])
    parts = t.spark.read.option("lineSep", "## ").text(path).where(F.trim("value") != "")
    # a section's last line ends at the writer's own line end
    return parts.select(_md5(F.concat(F.lit("## "), F.regexp_replace("value", r"\s+$", "\n\n"))).alias("section")).groupBy("section").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_acctbal+1 AS c_acctbal FROM customer")
def new_version(t):
    """A changed table as a new version; the old one stays as it is."""
    root = _at(t, "versions")
    old = sinks.versioned(t.customer.select("c_custkey", "c_acctbal"), root, "1")
    new = sinks.versioned(t.spark.read.parquet(old).withColumn("c_acctbal", F.col("c_acctbal") + 1), root, "2")
    return t.spark.read.parquet(new)


@query("SELECT p_brand, citation FROM (SELECT DISTINCT p_brand, p_type||' § '||p_size AS citation FROM part)")
def citation_dump(t):
    """A row for each citation, tab-separated."""
    path = _at(t, "citations")
    x = t.part.groupBy("p_brand").agg(F.collect_set(F.concat("p_type", F.lit(" § "), F.col("p_size").cast("string"))).alias("c"))
    sinks.citations(x, path, ["p_brand"], "c")
    return t.spark.read.csv(path, sep="\t", header=True)


@query("SELECT event_id AS id, value AS score, 'judge'||user_id%4 AS judge FROM events")
def judgment_panel(t):
    """Judgments of several judges, each in a folder of its own."""
    path = _at(t, "panel")
    x = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("score"), F.concat(F.lit("judge"), (F.col("user_id") % 4).cast("string")).alias("folder"))
    x.write.partitionBy("folder").json(path)
    out = readers.judgments(t.spark, f"{path}/*/", "id bigint, score double")
    return out.withColumn("judge", F.regexp_replace("judge", "^folder=", ""))


@query("""SELECT d.doc_id, lang AS question, quality AS reference, CASE WHEN d.doc_id%2=0 THEN source END AS answer, CAST(floor(a*1e6+0.5) AS BIGINT) AS j0, CAST(floor(b*1e6+0.5) AS BIGINT) AS j1 FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id LEFT JOIN (SELECT event_id, avg(value) FILTER (WHERE user_id%2=0) AS a, avg(value) FILTER (WHERE user_id%2=1) AS b FROM events GROUP BY 1) e ON e.event_id=d.doc_id""")
def rating_sheet(t):
    """Every case with its question, reference, answer and the judges' scores, as far as they exist."""
    key = F.col("event_id").alias("doc_id")
    scores = t.events.select(key, F.concat(F.lit("j"), (F.col("user_id") % 2).cast("string")).alias("judge"), F.col("value").alias("score"))
    d = t.documents
    out = sinks.rating_sheet(d.select("doc_id"), d.select("doc_id", F.col("lang").alias("question")), t.labels.select("doc_id", F.col("quality").alias("reference")), d.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("answer")), scores, "doc_id", ["j0", "j1"])
    return out.withColumns({j: millionths(j) for j in ("j0", "j1")}).select("doc_id", "question", "reference", "answer", "j0", "j1")


@query("SELECT n_name||'.txt' AS file, 'S-'||n_nationkey AS id, 'Topic '||n_regionkey AS topic, 'Facts of '||n_name||chr(10)||'in two lines' AS facts, CASE WHEN n_nationkey%2=0 THEN 'Yes, it is.' END AS answer FROM nation")
def hypotheticals(t):
    """Scenario files with header fields and dashed sections."""
    folder, files = _at(t, "hypotheticals"), {}
    for r in _few(t.nation):  # 25 nations
        body = f"ID: S-{r['n_nationkey']}\nTopic: Topic {r['n_regionkey']}\n\nFACTS\n-----\nFacts of {r['n_name']}\nin two lines\n\nQUESTION\n--------\nWell?\n"
        files[f"{r['n_name']}.txt"] = body + ("\nANSWER\n------\nYes, it is.\n" if r["n_nationkey"] % 2 == 0 else "")
    sinks.named_files(t.spark, folder, files)
    return readers.hypotheticals(t.spark, folder).select(F.col("_file").alias("file"), "id", "topic", "facts", "answer")


@query("SELECT p_partkey, bucket FROM (SELECT p_partkey, CASE WHEN p_size%3=0 THEN 'controls' ELSE 'court' END AS tag, CASE WHEN p_size%3=0 THEN p_brand WHEN p_size%2=0 THEN 'court_pre' ELSE 'court_post' END AS bucket FROM part WHERE p_size%7<>0)")
def score_files(t):
    """H6, H8: score files chosen by a part of their names, without errored rows, each row in its bucket."""
    folder = _at(t, "scores")
    k = F.col("p_size")
    x = t.part.select("p_partkey", F.when(k % 7 == 0, "1").otherwise("").alias("errored"), F.when(k % 3 == 0, F.concat("p_brand", F.lit("_ch1"))).otherwise("case").alias("case_id"), F.when(k % 2 == 0, "pre_cutoff").otherwise("control").alias("arm"), (k % 3 == 0).alias("c"))
    for tag, rows in (("controls", x.where("c")), ("court", x.where("not c")), ("draft", x)):
        rows.drop("c").coalesce(1).write.csv(f"{folder}/{tag}", header=True)
    out = None
    for tag in ("controls", "court"):
        paths = readers.files_with(t.spark, f"{folder}/{tag}", ".csv")
        one = readers.csv_rows(t.spark, paths, "p_partkey bigint, errored string, case_id string, arm string").where("coalesce(errored, '') <> '1'")
        bucket = F.regexp_replace("case_id", "_ch[^_]*$", "") if tag == "controls" else F.when(F.contains("arm", F.lit("pre")), "court_pre").otherwise("court_post")
        one = one.select("p_partkey", bucket.alias("bucket"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT doc_id, len(text) AS answer_chars, CAST(row_number() OVER (ORDER BY len(text) DESC, doc_id) AS INTEGER) AS place FROM documents QUALIFY place<=100")
def subset_manifest(t):
    """A report's hundred longest answers in order, with their lengths."""
    from pyspark.sql import Window

    top = t.documents.select("doc_id", F.length("text").cast("long").alias("answer_chars")).orderBy(F.desc("answer_chars"), "doc_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("answer_chars"), "doc_id")))


@query("SELECT event_id, value FROM events WHERE user_id=(SELECT min(user_id) FROM events) AND event_type='click'")
def single_case(t):
    """One case's rows; the case is the one with the smallest id."""
    case = t.events.agg(F.min("user_id").alias("user_id"))
    return t.events.where("event_type = 'click'").join(F.broadcast(case), "user_id").select("event_id", "value")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def snapshot_once(t):
    """Rows are only added for keys that a table doesn't have yet; what is there stays."""
    from lexmill.operators.relational import todo

    path = _at(t, "snapshot")
    keys = ["user_id", "event_type"]
    first = lambda df: df.groupBy(*keys).agg(F.min("event_id").alias("event_id"))
    half = t.events.agg(F.percentile_approx("event_id", F.lit(0.5)).alias("h"))
    early = t.events.join(F.broadcast(half)).where("event_id <= h").drop("h")
    first(early).write.parquet(path)
    there = t.spark.read.parquet(path)
    todo(first(t.events), there, keys).select("user_id", "event_type", "event_id").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


# the stub's answers are bytes of a digest, so that SQL can state them
_STUB = "s AS (SELECT *, sha256('0|'||prompt) AS d FROM p), a AS (SELECT *, (CAST('0x'||substr(d,1,2) AS BIGINT)%5)/4.0 AS score, CAST('0x'||substr(d,3,2) AS BIGINT)%2=1 AS verdict, substr(d,1,16) AS text FROM s)"


@query(f"WITH p AS (SELECT p_partkey, 'Rate: '||p_name||' / '||p_type AS prompt FROM part), {_STUB} SELECT p_partkey, CAST(floor(score*1e6+0.5) AS BIGINT) AS score, verdict, text FROM a")
def judged_by_stub(t):
    """X1, X2 in part: a provider that is asked with retries and a check of its answers; the stub answers by a digest of the prompt."""
    from lexmill.sources import providers

    items = t.part.select("p_partkey", F.concat(F.lit("Rate: "), "p_name", F.lit(" / "), "p_type").alias("prompt"))
    got = providers.ask(items, ["p_partkey"], "prompt", lambda: providers.Retrying(providers.Stub(0), lambda a: a.startswith("{")))
    x = got.select("p_partkey", F.from_json("answer", "score double, verdict boolean, text string").alias("a"))
    return x.select("p_partkey", millionths("a.score").alias("score"), "a.verdict", "a.text")


@query(f"WITH p AS (SELECT DISTINCT p_type, 'Gold: '||p_type AS prompt FROM part), {_STUB} SELECT p_partkey, verdict AS gold FROM part JOIN a USING (p_type)")
def asked_once(t):
    """What depends on a key is asked once for each key."""
    from lexmill.sources import providers

    items = t.part.select("p_partkey", "p_type", F.concat(F.lit("Gold: "), "p_type").alias("prompt"))
    got = providers.ask_once_per_key(items, "p_type", "prompt", lambda: providers.Stub(0))
    return got.select("p_partkey", F.from_json("answer", "verdict boolean").alias("a")).select("p_partkey", F.col("a.verdict").alias("gold"))


@query(f"WITH p AS (SELECT conv_id, turn, 'Answer: '||text AS prompt FROM conversations WHERE role='user'), {_STUB} SELECT conv_id, turn, text AS answer, CASE WHEN score>=0.5 THEN 'accepted' ELSE 'failed' END AS state FROM a")
def staged_generation(t):
    """H3, and X4, X5 in part: a stage that asks for what isn't done yet, in two runs, and logs which answers pass its check."""
    from lexmill.sources import providers

    path = _at(t, "stage")
    items = t.conversations.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("Answer: "), "text").alias("prompt"))
    providers.ask(items.where("conv_id % 2 = 0"), ["conv_id", "turn"], "prompt", lambda: providers.Stub(0)).write.parquet(path)
    done = t.spark.read.parquet(path)
    providers.ask(items, ["conv_id", "turn"], "prompt", lambda: providers.Stub(0), done).write.mode("append").parquet(path)
    x = t.spark.read.parquet(path).select("conv_id", "turn", F.from_json("answer", "score double, text string").alias("a"))
    return x.select("conv_id", "turn", F.col("a.text").alias("answer"), F.when(F.col("a.score") >= 0.5, "accepted").otherwise("failed").alias("state"))


@query(f"WITH q AS (SELECT item_id, dimension, dimension||': '||text AS prompt FROM benchmark, (SELECT unnest(['factor_recall','grounding','outcome','verdict','similarity','quality']) AS dimension)), p AS (SELECT * FROM q), {_STUB} SELECT item_id, CAST(floor(max(score) FILTER (WHERE dimension='factor_recall')*1e6+0.5) AS BIGINT) AS factor_recall, CAST(floor(max(score) FILTER (WHERE dimension='similarity')*1e6+0.5) AS BIGINT) AS similarity, CAST(floor(max(score) FILTER (WHERE dimension='quality')*1e6+0.5) AS BIGINT) AS quality, CAST(floor(max(round(score*4)/4) FILTER (WHERE dimension='quality')*1e6+0.5) AS BIGINT) AS anchor, bool_or(verdict) FILTER (WHERE dimension='verdict') AS verdict, bool_or(verdict) FILTER (WHERE dimension='outcome') AS outcome, bool_or(verdict) FILTER (WHERE dimension='grounding') AS grounded FROM a GROUP BY item_id")
def judge_dimensions(t):
    """X3 in part: an answer judged in six dimensions, each asked by itself, as one row; quality goes to the nearest of five anchors."""
    from lexmill.sources import providers

    got = providers.judge_dimensions(t.benchmark, "item_id", F.col("text"), lambda: providers.Stub(0))
    return got.withColumns({c: millionths(c) for c in ("factor_recall", "similarity", "quality", "anchor")})
