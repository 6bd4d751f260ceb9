"""Queries on joins, resume, de-duplication, windows and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.numbers import millionths
from lexmill.operators import intervals, sampling
from lexmill.operators import relational as op
from lexmill.plans.registry import query


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem)
SELECT o_orderkey, l_linenumber, l_partkey, o_custkey FROM q JOIN orders ON o_orderkey=l_orderkey WHERE k=1""")
def join_dedup_last_wins(t):
    """A join on keys made unique first."""
    one = op.latest(t.lineitem, ["l_orderkey", "l_linenumber"], [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"), F.col("l_shipdate")])
    return one.select("l_orderkey", "l_linenumber", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag<>'R')")
def resume_left_anti(t):
    """Orders without a finished line; returned lines count as failed."""
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return op.todo(t.orders.select("o_orderkey"), done, ["o_orderkey"], F.col("l_returnflag") == "R")


@query("""SELECT e.event_type, n.n_name, count(*) AS n FROM events e LEFT JOIN customer c ON e.user_id=c.c_custkey LEFT JOIN nation n ON c.c_nationkey=n.n_nationkey GROUP BY ALL""")
def metadata_lookup(t):
    """A left join with small dimension tables."""
    j = t.events.join(t.customer.select("c_custkey", "c_nationkey"), F.col("user_id") == F.col("c_custkey"), "left")
    j = j.join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("event_type", "n_name").agg(F.count("*").alias("n"))


@query("""SELECT state, quality, count(*) AS n FROM (SELECT coalesce(l.toxic, d.q) AS quality, CASE WHEN l.doc_id IS NULL THEN 'unmatched' WHEN l.toxic IS NOT DISTINCT FROM d.q THEN 'same' ELSE 'changed' END AS state
FROM (SELECT doc_id, CAST(n_chars%2 AS INTEGER) AS q FROM documents) d LEFT JOIN labels l USING (doc_id)) GROUP BY ALL""")
def label_overwrite(t):
    """Labels taken over from a later table, with what changed."""
    d = t.documents.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return op.overwrite(d, t.labels, "doc_id", "quality", "toxic").groupBy("state", "quality").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag='A' THEN l_quantity END) AS a, avg(CASE WHEN l_returnflag='N' THEN l_quantity END) AS b FROM lineitem WHERE l_returnflag IN ('A','N') GROUP BY l_suppkey),
d AS (SELECT l_suppkey%3 AS g, b-a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT g, count(*) AS n, CAST(floor(avg(d)*1e6+0.5) AS BIGINT) AS mean, CAST(floor(stddev_samp(d)*1e6+0.5) AS BIGINT) AS sd, CAST(floor(avg(d)/(stddev_samp(d)/sqrt(count(*)))*1e6+0.5) AS BIGINT) AS t, count(*) FILTER (WHERE d>0) AS up, count(*) FILTER (WHERE d<0) AS down FROM d GROUP BY g""")
def paired_arm_delta_summary(t):
    """Paired differences of two arms."""
    p = op.paired(t.lineitem, ["l_suppkey"], "l_returnflag", "l_quantity", "A", "N").withColumn("g", F.col("l_suppkey") % 3)
    out = op.delta_summary(p, ["g"])
    return out.withColumns({c: millionths(c) for c in ("mean", "sd", "t")})


@query("""SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type)=(SELECT count(DISTINCT event_type) FROM events)) GROUP BY user_id""")
def complete_cases_division(t):
    """Users that have every event type."""
    return op.complete_cases(t.events.select("user_id", "event_type"), "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A','N') AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag='N') GROUP BY l_orderkey""")
def key_intersection_of_arms(t):
    """Orders with lines of both arms."""
    return op.both_arms(t.lineitem.select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", "A", "N").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch(ts) AS s FROM events), a AS (SELECT event_id, user_id, CAST(floor(s) AS BIGINT) AS lo, CAST(floor(s) AS BIGINT)+600 AS hi FROM e WHERE event_type='click'),
u AS (SELECT user_id, CAST(floor(s) AS BIGINT) AS lo, CAST(floor(s) AS BIGINT)+1800 AS hi FROM e WHERE event_type<>'click')
SELECT event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id=a.user_id AND a.lo<u.hi AND a.hi>u.lo)""")
def interval_overlap_anti(t):
    """Clicks whose ten minutes meet no other event's half hour."""
    e = t.events.select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("lo"))
    a = e.where("event_type = 'click'").withColumn("hi", F.col("lo") + 600)
    u = e.where("event_type <> 'click'").withColumn("hi", F.col("lo") + 1800)
    return intervals.no_overlap(a, u, "user_id").select("event_id")


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 60 + event_id % 5 * event_id % 40000 AS hi FROM events)
SELECT a.user_id, a.event_id AS a, b.event_id AS b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM e a JOIN e b ON a.user_id=b.user_id AND a.lo<b.hi AND b.lo<a.hi WHERE a.event_type='click' AND b.event_type='purchase'""")
def interval_pairs(t):
    """Clicks and purchases of a user whose times overlap, with what they share; lasting from a minute to half a day."""
    lo = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = t.events.select("event_id", "user_id", "event_type", lo.alias("lo"), (lo + 60 + F.col("event_id") % 5 * F.col("event_id") % 40000).alias("hi"))
    a = e.where("event_type = 'click'").withColumnRenamed("event_id", "a")
    return intervals.overlap_pairs(a, e.where("event_type = 'purchase'").withColumnRenamed("event_id", "b"), "user_id", "a", "b")


_CONTROLS = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, len(regexp_extract_all(text, '\S+')) AS n FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, w, n, least(12, n - n // 4) AS s1, least(12, n - n // 2) AS s2 FROM d WHERE n > 0),
step AS (
  SELECT doc_id, n, s1, s2, 0 AS i, 0 AS made, CAST([] AS INTEGER[]) AS found, [[n // 4, n // 4 + s1], [n // 2, n // 2 + s2]] AS used FROM x
  UNION ALL
  SELECT doc_id, n, s1, s2, CASE WHEN over THEN i + 1 ELSE i END, CASE WHEN over THEN 0 ELSE made + 1 END,
    CASE WHEN over THEN [] WHEN fits THEN list_append(found, w) ELSE found END, CASE WHEN NOT over AND fits THEN list_append(used, [w, w + size]) ELSE used END
  FROM (SELECT *, NOT over AND len(list_filter(used, lambda u: u[1] < w + size AND u[2] > w)) = 0 AS fits FROM (
    SELECT *, len(found) >= 3 OR made >= 90 OR n < 10 + size + 40 OR n - size - 5 < 15 AS over, 15 + CAST('0x' || substr(md5(doc_id || '|' || i || '|' || made), 1, 8) AS BIGINT) % greatest(1, n - size - 5 - 15 + 1) AS w
    FROM (SELECT *, CASE i WHEN 0 THEN s1 ELSE s2 END AS size FROM step WHERE i < 2)
  ))
),
ends AS (SELECT * FROM step s WHERE i < 2 QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY made DESC, len(found) DESC) = 1)
SELECT ends.doc_id, CAST(i AS INTEGER) AS span, CAST(CASE i WHEN 0 THEN ends.s1 ELSE ends.s2 END AS INTEGER) AS n_words, CAST(made AS INTEGER) AS tries, array_to_string(found, ',') AS starts,
  md5(array_to_string(list_transform(found, lambda k: array_to_string(w[k + 1:k + CASE i WHEN 0 THEN ends.s1 ELSE ends.s2 END], ' ')), '|')) AS texts
FROM ends JOIN x USING (doc_id)
"""


@query(_CONTROLS)
def matched_controls(t):
    """For two spans of twelve words of each document up to three control spans of equal length, with the draws made."""
    d = t.documents.withColumn("n", F.regexp_count("text", F.lit(r"\S+"))).where("n > 0")

    def target(part: int):
        first = F.floor(F.col("n") / part).cast("int")
        return F.struct(first.alias("lo"), F.least(first + 12, F.col("n")).alias("hi"))

    got = sampling.matched_controls(d.withColumn("targets", F.array(target(4), target(2))), "doc_id", "text", "targets", in_words=True)
    starts = F.array_join(F.transform("controls", lambda c: c["word"].cast("string")), ",")
    texts = F.md5(F.array_join(F.transform("controls", lambda c: c["text"]), "|").cast("binary"))
    return got.select("doc_id", "span", "n_words", "tries", starts.alias("starts"), texts.alias("texts"))


@query("""WITH d AS (SELECT doc_id, md5(text) AS name FROM documents), k AS (SELECT *, count(*) OVER (PARTITION BY name) AS c, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS r FROM d)
SELECT doc_id, CASE WHEN c>1 THEN name||'__'||r ELSE name END AS uid FROM k""")
def collision_suffix(t):
    """Unique names for documents of equal text."""
    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("name"))
    return op.collision_suffix(d, "name", "doc_id").select("doc_id", "uid")


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate)||CASE WHEN month(o_orderdate)<=6 THEN 'H1' ELSE 'H2' END AS half, row_number() OVER (PARTITION BY year(o_orderdate)||CASE WHEN month(o_orderdate)<=6 THEN 'H1' ELSE 'H2' END ORDER BY o_totalprice DESC, o_orderkey)-1 AS r FROM orders)
SELECT o_orderkey, half, CAST(r//3 AS BIGINT) AS round, CAST(r%3 AS BIGINT) AS slot FROM o""")
def round_robin_half_year(t):
    """Orders dealt from half-year buckets, three a turn."""
    o = t.orders.select("o_orderkey", "o_totalprice", op.half_year(F.col("o_orderdate")).alias("half"))
    return op.round_robin(o, "half", [op.By("o_totalprice", True), "o_orderkey"], 3).drop("o_totalprice")


@query("""WITH c AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY o_custkey),
h AS (SELECT o_custkey, a, b, unnest(generate_series(make_date(year(a), CASE WHEN month(a)<=6 THEN 1 ELSE 7 END, 1), b, INTERVAL 6 MONTH)) AS h FROM c)
SELECT o_custkey, a, b, greatest(CAST(h AS DATE), a) AS lo, least(CAST(h + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE), b) AS hi FROM h""")
def half_year_windows(t):
    """Each customer's time of orders, cut at half-years."""
    c = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return op.half_year_windows(c, "a", "b")


@query("""SELECT CASE WHEN CAST(o_orderdate AS DATE)<=DATE '1997-01-31' THEN 'pre' WHEN CAST(o_orderdate AS DATE)>DATE '1999-02-28' THEN 'post' END AS arm, CASE WHEN CAST(o_orderdate AS DATE)<=DATE '1998-01-31' THEN 'pre' ELSE 'post' END AS model_arm, count(*) AS n FROM orders GROUP BY ALL""")
def common_arm_split(t):
    """K4, K5: the arm of a model, and the arm that all models agree on."""
    arm = op.common_arm(F.col("o_orderdate"), ["1997-01-31", "1998-01-31", "1999-02-28"])
    own = op.arm_of(F.col("o_orderdate").cast("date"), F.lit("1998-01-31").cast("date"))
    return t.orders.select(arm.alias("arm"), own.alias("model_arm")).groupBy("arm", "model_arm").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT page_id, nullif(lower(regexp_extract(url,'(?i)^https?://([^?#]*)',1)),'') AS address, nullif(trim(regexp_replace(lower(regexp_extract(html,'(?i)<title[^>]*>([^<]*)',1)),'[^\\p{L}\\p{N}]+',' ','g')),'') AS title, coalesce(regexp_matches(url,'^(?i)https:'),false) AS new FROM pages),
n AS (SELECT *, row_number() OVER (ORDER BY page_id) AS k FROM p WHERE new AND (address IS NULL OR address NOT IN (SELECT address FROM p WHERE NOT new AND address IS NOT NULL)) AND (title IS NULL OR title NOT IN (SELECT title FROM p WHERE NOT new AND title IS NOT NULL))),
r AS (SELECT 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS a, CAST([] AS VARCHAR[]) AS t, false AS keep UNION ALL SELECT n.k, CASE WHEN z THEN list_append(r.a, address) ELSE r.a END, CASE WHEN z THEN list_append(r.t, title) ELSE r.t END, z FROM (SELECT r.k AS rk, r.a, r.t FROM r) r JOIN (SELECT * FROM n) n ON n.k=r.rk+1, LATERAL (SELECT NOT coalesce(list_contains(r.a, address),false) AND NOT coalesce(list_contains(r.t, title),false) AS z))
SELECT page_id, address, title FROM n JOIN r USING (k) WHERE keep""")
def three_layer_dedup(t):
    """Pages by https that are new by address, folded title and id against all others, one page for each of these."""
    title = F.trim(F.regexp_replace(F.lower(F.regexp_extract("html", r"(?i)<title[^>]*>([^<]*)", 1)), r"[^\p{L}\p{N}]+", " "))
    address = F.lower(F.regexp_extract("url", r"^(?i:https?)://([^?#]*)", 1))
    p = t.pages.select("page_id", F.nullif(address, F.lit("")).alias("address"), F.nullif(title, F.lit("")).alias("title"), F.coalesce(F.col("url").rlike("^(?i)https:"), F.lit(False)).alias("new"))
    return op.three_layer_dedup(p.where("new"), p.where("not new"), ["address", "title", "page_id"], ["page_id"]).drop("new")


@query("""WITH c AS (SELECT c_custkey AS id, unnest(string_split(replace(c_name,'#',' '),' ')) AS w FROM customer), s AS (SELECT s_suppkey AS id, unnest(string_split(replace(s_name,'#',' '),' ')) AS w FROM supplier),
u AS (SELECT id, w, 1 AS a, 0 AS b FROM c UNION ALL SELECT id, w, 0, 1 FROM s) SELECT id, w, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM u GROUP BY id, w HAVING sum(a)<>sum(b)""")
def multiset_difference(t):
    """Words that customers' and suppliers' names don't share, by id."""
    words = lambda df, k, c: df.select(F.col(k).alias("id"), F.explode(F.split(F.replace(c, F.lit("#"), F.lit(" ")), " ")).alias("w"))
    return op.multiset_difference(words(t.customer, "c_custkey", "c_name"), words(t.supplier, "s_suppkey", "s_name"), ["id"], "w")


@query("""SELECT o_orderkey, band FROM (SELECT o_orderkey, band, row_number() OVER (PARTITION BY band ORDER BY md5(o_orderkey||'|7'), o_orderkey) AS r FROM (SELECT o_orderkey, CASE WHEN o_totalprice>400000 THEN NULL WHEN o_totalprice>=300000 THEN 3 WHEN o_totalprice>=200000 THEN 2 WHEN o_totalprice>=100000 THEN 1 WHEN o_totalprice>=0 THEN 0 END AS band FROM orders) WHERE band IS NOT NULL) WHERE r<=25""")
def stratified_bands_sample(t):
    """A hundred orders over four price bands."""
    return sampling.stratified(t.orders, "o_orderkey", "o_totalprice", [0, 100_000, 200_000, 300_000, 400_000], 100, 7).select("o_orderkey", "band")


@query("""WITH w AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40), l AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM w) ORDER BY o_orderdate, o_orderkey LIMIT 25),
r AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM w UNION ALL SELECT o_orderkey FROM l) ORDER BY md5(o_orderkey||'|3'), o_orderkey LIMIT 35)
SELECT o_orderkey, 'widest' AS stratum FROM w UNION ALL SELECT o_orderkey, 'lowest' FROM l UNION ALL SELECT o_orderkey, 'random' FROM r""")
def three_strata_sample(t):
    """Widest, lowest and random orders."""
    return sampling.three_strata(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderkey", "o_totalprice", "o_orderdate", 100, 3).select("o_orderkey", "stratum")


@query("""SELECT doc_id, md5(array_to_string(list_transform(list_sort(list_transform(range(1, len(w)+1), lambda i: {'b': (i-1)//40, 'h': md5(doc_id||'|'||(i-1)), 'w': w[i]})), lambda x: x.w), ' ')) AS shuffled, len(w) AS n FROM (SELECT doc_id, string_split_regex(trim(text), '[ \\n]+') AS w FROM documents)""")
def scramble_control(t):
    """Documents with the words of every window of 40 shuffled."""
    words = F.split(F.trim("text"), "[ \\n]+")
    mixed = sampling.scramble(words, 40, F.col("doc_id"))
    return t.documents.select("doc_id", F.md5(F.array_join(mixed, " ").cast("binary")).alias("shuffled"), F.size(words).cast("long").alias("n"))


@query("""SELECT c_custkey, (['ann','ben','cy','dee','eli'])[(c_custkey+2)%5+1] AS name FROM customer""")
def name_assignment(t):
    """Names in rotation."""
    return sampling.assign_names(t.customer.select("c_custkey"), "c_custkey", ["ann", "ben", "cy", "dee", "eli"], 2)


@query("""WITH g AS (SELECT DISTINCT c_custkey, unnest(['a','b','c']) AS model FROM customer) SELECT c_custkey, model FROM g WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'a' WHEN 'F' THEN 'b' ELSE 'c' END AS m FROM orders) d WHERE d.o_custkey=g.c_custkey AND d.m=g.model)""")
def work_grid_minus_done(t):
    """Customers and models still to do."""
    models = t.spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    done = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "a").when(F.col("o_orderstatus") == "F", "b").otherwise("c").alias("model"))
    return op.work_grid(t.customer, models, done, "c_custkey", "model")


@query("""SELECT conv_id, coalesce(nullif(trim(a),''), nullif(trim(b),'')) AS text, CASE WHEN nullif(trim(a),'') IS NOT NULL THEN 'a' WHEN nullif(trim(b),'') IS NOT NULL THEN 'b' END AS text_field FROM (SELECT conv_id, max(CASE WHEN role='system' THEN text END) AS a, max(CASE WHEN role='user' THEN text END) AS b FROM conversations GROUP BY conv_id)""")
def first_non_empty_field(t):
    """H7: the system text, or else a user's."""
    c = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("a"), F.max(F.when(F.col("role") == "user", F.col("text"))).alias("b"))
    return op.first_text(c, ["a", "b"]).select("conv_id", "text", "text_field")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank<=3""")
def top_n_per_group(t):
    """The three dearest lines of each supplier."""
    out = op.top_n(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount<0.05 AND l_tax<0.05) AS survivors, count(*) FILTER (WHERE l_discount<0.05 AND l_tax<0.05 AND l_linestatus='O') AS n_O, count(*) FILTER (WHERE l_discount<0.05 AND l_tax<0.05 AND l_linestatus='F') AS n_F FROM lineitem GROUP BY l_returnflag""")
def hotspot_funnel(t):
    """Survivors of two thresholds by bucket."""
    return op.funnel(t.lineitem, "l_returnflag", (F.col("l_discount") < 0.05) & (F.col("l_tax") < 0.05), F.col("l_linestatus"), ["O", "F"])


@query("""SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING sum(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) >= 13""")
def having_coverage(t):
    """Parts with at least 13 open lines."""
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("found")).where("found >= 13").select("l_partkey", "n")


_LINKS = "WITH l AS (SELECT page_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS k FROM (SELECT page_id, regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1) AS w FROM pages)), h AS (SELECT page_id, k, w, CAST('0x' || substr(md5(page_id || '|' || k), 1, 8) AS BIGINT) AS h FROM l)"


@query(f"""{_LINKS}, v AS (SELECT page_id, k, CASE WHEN h % 5 = 0 THEN CAST(h % 400 - 20 AS VARCHAR) WHEN h % 31 = 0 THEN ' ' ELSE w END AS value, row_number() OVER (ORDER BY page_id, k) - 1 AS n FROM h),
x AS (SELECT page_id, k, n, CASE WHEN NOT regexp_matches(trim(value), '^-*[0-9]+$') AND trim(value) <> '' THEN trim(value) END AS t, CASE WHEN regexp_matches(trim(value), '^-*[0-9]+$') THEN CAST(trim(value) AS BIGINT) END AS i FROM v),
known AS (SELECT * FROM (VALUES (0, 'The', -1), (1, 'unseen', -1)) AS z(place, entry, first)),
e AS (SELECT place, entry, first FROM known UNION ALL SELECT 1 + row_number() OVER (ORDER BY min(n)), t, min(n) FROM x WHERE t IS NOT NULL AND t NOT IN (SELECT entry FROM known) GROUP BY t)
SELECT page_id, CAST(k AS INTEGER) AS k, coalesce(a.entry, b.entry) AS entry, CAST(coalesce(a.place, b.place) AS BIGINT) AS place FROM x LEFT JOIN e a ON a.entry = x.t LEFT JOIN e b ON b.place = x.i AND b.first < x.n""")
def growing_vocabulary(t):
    """link texts of all pages as entries of a vocabulary that grows as they come; every fifth is a number that means an entry."""
    links = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<li><a[^>]*>([^<]*)</a>"), F.lit(1))).alias("k", "w"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("k").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    value = F.when(h % 5 == 0, (h % 400 - 20).cast("string")).when(h % 31 == 0, " ").otherwise(F.col("w"))
    rows, _ = op.grow_vocabulary(links.select("page_id", "k", value.alias("value")), "value", ["page_id", "k"], ["The", "unseen"])
    return rows.select("page_id", "k", "entry", "place")
