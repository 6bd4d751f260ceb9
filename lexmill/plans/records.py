"""Queries on joins and summaries of evaluation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import rules
from lexmill.functions.numbers import millionths
from lexmill.operators import records as op
from lexmill.operators import shingle
from lexmill.plans.overlap import _SH, _WORDS
from lexmill.plans.registry import query


def _m(df, *cols):
    return df.withColumns({c: millionths(c) for c in cols})


def _mil(x: str) -> str:
    return f"CAST(floor(({x})*1e6+0.5) AS BIGINT)"


@query(f"""WITH lp AS (SELECT l_orderkey AS k, sum(l_discount) AS x FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_totalprice AS y FROM orders WHERE o_orderstatus<>'F')
SELECT count(*) AS n, {_mil('corr(x,y)')} AS r FROM lp JOIN b USING (k)""")
def scores_joined(t):
    """One model's log probabilities against scores of attempts, and their correlation."""
    lp = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_discount").alias("x")).withColumn("model", F.lit("m"))
    b = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("y"))
    return op.single_model(lp, "model").join(b, "k").agg(F.count("*").alias("n"), millionths(F.corr("x", "y")).alias("r"))


@query("""SELECT o_orderkey, o_orderstatus AS old, n AS new FROM orders JOIN (SELECT l_orderkey, max(l_linestatus) AS n, bool_or(l_returnflag='R') AS d FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey WHERE NOT d AND o_orderstatus IS DISTINCT FROM n""")
def moved_labels(t):
    """Labels that differ from the baseline's; declined rows don't count."""
    new = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("label"), F.bool_or(F.col("l_returnflag") == "R").alias("declined"))
    return op.moved_labels(new, t.orders.withColumnRenamed("o_orderstatus", "label"), ["o_orderkey"], "label", F.col("declined"))


@query("""SELECT conv_id, md5(arg_min(c, turn)) AS caption FROM (SELECT conv_id, turn, CASE WHEN turn%3=0 THEN '  ' ELSE text END AS c FROM conversations) WHERE trim(coalesce(c,''))<>'' GROUP BY conv_id""")
def first_caption(t):
    """Each case's first caption that isn't blank."""
    c = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("caption"))
    return op.first_filled(c, "conv_id", "caption", ["turn"]).withColumn("caption", F.md5(F.col("caption").cast("binary")))


@query("""SELECT e.event_type AS dataset, count(*) AS n, count(DISTINCT e.user_id) AS cases FROM events e JOIN (SELECT DISTINCT event_type, user_id FROM events WHERE event_id%9=0) g ON g.event_type=e.event_type AND g.user_id=e.user_id WHERE e.event_id%9<>0 GROUP BY 1""")
def generations_with_gold(t):
    """Generations that have a gold answer of their data set and case."""
    gold = t.events.where("event_id % 9 = 0").select("event_type", "user_id").distinct()
    x = t.events.where("event_id % 9 <> 0").join(gold, ["event_type", "user_id"])
    return x.groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("cases"))


@query("""SELECT l.doc_id, quality, toxic, lang AS src_lang, source AS src_source, n_chars AS src_n_chars FROM labels l LEFT JOIN documents d ON d.doc_id=l.doc_id AND d.doc_id%10<>0""")
def reviewed_with_source(t):
    """Reviewed records with the columns of their source."""
    src = t.documents.where("doc_id % 10 <> 0").select("doc_id", *[F.col(c).alias(f"src_{c}") for c in ("lang", "source", "n_chars")])
    return t.labels.join(src, "doc_id", "left").select("doc_id", "quality", "toxic", "src_lang", "src_source", "src_n_chars")


_CONTRAST = "c AS (SELECT l_partkey, CAST(sum(CASE WHEN l_suppkey%4=0 THEN l_linenumber ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_suppkey%4=1 THEN l_linenumber ELSE 0 END) AS BIGINT) AS b FROM lineitem WHERE l_suppkey%4 IN (0,1) GROUP BY 1)"


def _contrast(t):
    x = t.lineitem.withColumn("model", F.col("l_suppkey") % 4)
    return op.contrast(x, "l_partkey", "model", "l_linenumber", 0, 1)


@query(f"WITH {_CONTRAST} SELECT l_partkey, a, b, abs(a-b) AS gap FROM c WHERE a<>0 OR b<>0")
def feature_contrast(t):
    """What two models give each case."""
    return _contrast(t)


@query(f"WITH {_CONTRAST} SELECT l_partkey, a, b, abs(a-b) AS gap FROM c ORDER BY gap DESC, l_partkey LIMIT 20")
def contrast_top20(t):
    """The cases that two models differ on most."""
    return _contrast(t).orderBy(F.desc("gap"), "l_partkey").limit(20)


@query(f"""SELECT model, count(*) AS cases, {_mil('avg(s)')} AS mean FROM (SELECT l_partkey, l_suppkey%4 AS model, sum(l_linenumber) AS s FROM lineitem GROUP BY ALL) WHERE s<>0 GROUP BY model""")
def selection_counts(t):
    """In how many cases a model names something, and how much there."""
    x = t.lineitem.withColumn("model", F.col("l_suppkey") % 4)
    return _m(op.when_named(x, "l_partkey", "model", "l_linenumber"), "mean")


@query(f"""WITH i AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 100000+doc_id, text FROM documents WHERE doc_id%2=0), e AS (SELECT item_id, min(doc_id) AS doc_id FROM i JOIN documents d ON d.text=i.text GROUP BY item_id),
b AS (SELECT item_id, unnest({_SH}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)), d AS (SELECT doc_id, unnest({_SH}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
h AS (SELECT item_id, doc_id, count(*)*1.0/any_value(n) AS share FROM b JOIN d USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING share>=0.5), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY share DESC, doc_id) AS k FROM h WHERE item_id NOT IN (SELECT item_id FROM e))
SELECT item_id, doc_id, 'sha1' AS method, 1000000 AS score FROM e UNION ALL SELECT item_id, doc_id, 'text_overlap', {_mil('share')} FROM r WHERE k=1""")
def identity_by_hash(t):
    """The document that an item is, by its hash, else by the best overlap."""
    items = t.benchmark.union(t.documents.where("doc_id % 2 = 0").select(F.col("doc_id") + 100000, "text"))
    scores = shingle.containment(t.benchmark, t.documents, "item_id", "text", "doc_id", "text").select("item_id", "doc_id", "share")
    return _m(op.identity(items, t.documents.select("doc_id", "text"), "item_id", "text", "doc_id", "text", scores), "score")


@query("""WITH p AS (SELECT l_orderkey, l_suppkey%3 AS j, avg(l_linenumber) FILTER (WHERE l_partkey%2=0) AS a, avg(l_linenumber) FILTER (WHERE l_partkey%2=1) AS b FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_suppkey%3 AS j, count(*) AS n FROM lineitem WHERE (l_orderkey, l_suppkey%3) IN (SELECT l_orderkey, j FROM p WHERE a=b) GROUP BY ALL""")
def identical_pairs(t):
    """The detail rows of keys whose two arms don't differ."""
    from lexmill.operators.relational import paired

    x = t.lineitem.withColumn("j", F.col("l_suppkey") % 3).withColumn("arm", F.col("l_partkey") % 2)
    same = paired(x, ["l_orderkey", "j"], "arm", "l_linenumber", 0, 1).where("delta = 0").select("l_orderkey", "j")
    return x.join(same, ["l_orderkey", "j"], "left_semi").groupBy("l_orderkey", "j").agg(F.count("*").alias("n"))


_DATES = "d AS (SELECT o_orderkey, o_orderstatus AS court, o_orderpriority AS juris, CASE WHEN o_custkey%4<>0 THEN CAST(o_orderdate AS DATE) END AS f, CASE WHEN o_custkey%8=0 THEN 'n/a' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS y FROM orders), c AS (SELECT *, coalesce(f, TRY_CAST(y||'-07-01' AS DATE)) AS date, CASE WHEN f IS NOT NULL THEN 'fetched' WHEN y<>'n/a' THEN 'year' ELSE 'unknown' END AS source FROM d)"


def _dated(t):
    x = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("court"), F.col("o_orderpriority").alias("juris"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderdate").cast("date")).alias("f"),
        F.when(F.col("o_custkey") % 8 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string")).alias("y"),
    )
    date, source = op.case_date(F.col("f"), F.col("y"))
    return x.withColumn("date", date).withColumn("source", source)


@query(f"WITH {_DATES} SELECT o_orderkey, date, source FROM c")
def case_dates(t):
    """The date that a case counts under, and where it is from."""
    return _dated(t).select("o_orderkey", "date", "source")


@query(f"""WITH {_DATES} SELECT juris, coalesce(CASE WHEN date IS NULL THEN 'undated' WHEN date<=DATE '1997-06-30' THEN 'pre_cutoff' ELSE 'post_cutoff_control' END,'ALL') AS arm, coalesce(year(date)||CASE WHEN month(date)<=6 THEN 'H1' ELSE 'H2' END,'-') AS half, count(*) AS n, count(DISTINCT court) AS courts FROM c GROUP BY ALL""")
def manifest_counters(t):
    """Cases by jurisdiction, arm and half-year."""
    from lexmill.operators.relational import half_year

    arm = F.when(F.col("date").isNull(), "undated").when(F.col("date") <= F.lit("1997-06-30").cast("date"), "pre_cutoff").otherwise("post_cutoff_control")
    x = _dated(t).withColumn("arm", arm).withColumn("half", F.coalesce(half_year(F.col("date")), F.lit("-")))
    return x.groupBy("juris", "arm", "half").agg(F.count("*").alias("n"), F.countDistinct("court").alias("courts"))


@query(f"""SELECT event_type AS dataset, user_id%3 AS family, count(*) AS n, {_mil("avg(CASE WHEN event_id%5<>0 THEN value END)")} AS similarity, {_mil("avg(CASE WHEN event_id%4=0 THEN CASE WHEN event_id%8=0 THEN 1.0 ELSE 0.0 END END)")} AS direction FROM events GROUP BY ALL""")
def judge_aggregate(t):
    """Means of judged values that skip what wasn't judged, flags as 0 and 1."""
    x = t.events.select(F.col("event_type").alias("dataset"), (F.col("user_id") % 3).alias("family"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("similarity"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 8 == 0).alias("direction"))
    return _m(op.judge_aggregate(x, ["dataset", "family"], ["similarity"], ["direction"]), "similarity", "direction")


@query(f"""SELECT model, criterion, {_mil('avg(p)')} AS rate FROM (SELECT user_id%12 AS model, event_type AS criterion, user_id, event_id%3 AS run, max(CASE WHEN value>100 THEN 1.0 ELSE 0.0 END) AS p FROM events GROUP BY ALL) GROUP BY ALL""")
def presence_rates(t):
    """A10, H4: by model and criterion, the share of cases that meet it."""
    x = t.events.select((F.col("user_id") % 12).alias("model"), F.col("event_type").alias("criterion"), F.struct("user_id", F.col("event_id") % 3).alias("case"), "value")
    return _m(op.presence_rates(x, "model", "case", "criterion", F.col("value") > 100), "rate")


@query(f"""WITH c AS (SELECT l_suppkey%4 AS model, l_orderkey, sum(w) AS m, count(*) FILTER (WHERE w>0) AS k, count(DISTINCT CASE WHEN w>0 THEN l_partkey%40 END) AS f FROM (SELECT *, l_linenumber-2 AS w FROM lineitem) GROUP BY ALL)
SELECT model, CAST(sum(m) AS BIGINT) AS mass, CAST(sum(k) AS BIGINT) AS named, {_mil('avg(f) FILTER (WHERE f>0)')} AS verbosity FROM c GROUP BY model""")
def importance_mass(t):
    """A model's weights, how many selections carry some, and features a case."""
    x = t.lineitem.select((F.col("l_suppkey") % 4).alias("model"), "l_orderkey", (F.col("l_partkey") % 40).alias("f"), (F.col("l_linenumber") - 2).alias("w"))
    return _m(op.importance(x, "model", "l_orderkey", "f", "w"), "verbosity")


@query(f"""SELECT l_returnflag AS model, CASE WHEN l_partkey%2=0 THEN 'base' ELSE 'instruct' END AS series, l_linenumber AS length, count(*) AS n, {_mil('avg(l_quantity)')} AS mean FROM lineitem GROUP BY ALL""")
def means_by_length(t):
    """Means by model, series and prefix length."""
    series = F.when(F.col("l_partkey") % 2 == 0, "base").otherwise("instruct")
    x = t.lineitem.groupBy(F.col("l_returnflag").alias("model"), series.alias("series"), F.col("l_linenumber").alias("length"))
    return _m(x.agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")), "mean")


@query(f"""SELECT user_id%4 AS model, event_type AS source, {_mil("avg(value) FILTER (WHERE ts<=TIMESTAMP '2024-01-15 00:00:00')")} AS pre, {_mil("avg(value) FILTER (WHERE ts>TIMESTAMP '2024-01-15 00:00:00')")} AS post, {_mil("avg(value)")} AS mean FROM events GROUP BY ALL""")
def recall_by_source(t):
    """Means by source, and before and after the cutoff."""
    pre = F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    x = t.events.groupBy((F.col("user_id") % 4).alias("model"), F.col("event_type").alias("source"))
    return _m(x.agg(F.avg(F.when(pre, F.col("value"))).alias("pre"), F.avg(F.when(~pre, F.col("value"))).alias("post"), F.avg("value").alias("mean")), "pre", "post", "mean")


@query(f"""SELECT count(*) AS n, {_mil('avg(value)')} AS floor FROM events WHERE ts>TIMESTAMP '2024-01-15 00:00:00' AND event_type<>'error'""")
def empirical_floor(t):
    """The mean over what no model can have seen."""
    x = t.events.where((F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")) & (F.col("event_type") != "error"))
    return x.agg(F.count("*").alias("n"), millionths(F.avg("value")).alias("floor"))


@query("""WITH e AS (SELECT len(text)*0.37::DOUBLE+doc_id*0.001::DOUBLE AS v, source AS g, lang FROM documents), d AS (SELECT avg(v) AS m FROM e), r AS (SELECT abs(v-m) AS s, v>m AS up, g, v FROM e, d WHERE v<>m),
k AS (SELECT *, rank() OVER (ORDER BY s)+(count(*) OVER (PARTITION BY s)-1)/2.0 AS rank FROM r)
SELECT g, CAST(count(*) AS BIGINT) AS n, CAST(floor(sum(rank*CAST(up AS INTEGER))*10+0.5) AS BIGINT) AS rank_sum10, CAST(floor(quantile_cont(v,0.1)*1e6+0.5) AS BIGINT) AS p10, CAST(floor(median(v)*1e6+0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(v,0.99)*1e6+0.5) AS BIGINT) AS p99 FROM k GROUP BY g""")
def continuous_ranks(t):
    """Rank sums of signed differences and percentiles by source, of a measure that no two documents share."""
    from lexmill.operators.order import average_ranks, percentiles

    x = t.documents.select(F.col("source").alias("g"), (F.length("text") * F.lit(0.37) + F.col("doc_id") * F.lit(0.001)).alias("v"))
    m = x.agg(F.avg(F.col("v").cast("decimal(38,18)")).cast("double").alias("m"))  # one row; a mean of doubles has last digits by the order of rows, and they break ties
    x = x.crossJoin(F.broadcast(m)).where("v <> m")
    ranks = average_ranks(x.groupBy(F.abs(F.col("v") - F.col("m")).alias("s")).agg(F.count("*").alias("c")), [], "s", "c").select("s", "rank")
    sums = x.withColumn("s", F.abs(F.col("v") - F.col("m"))).join(ranks, "s").groupBy("g").agg(F.count("*").alias("n"), F.floor(F.sum(F.when(F.col("v") > F.col("m"), F.col("rank")).otherwise(0)) * 10 + 0.5).cast("long").alias("rank_sum10"))
    q = percentiles(x, ["g"], "v", [0.1, 0.5, 0.99]).select(F.col("g").alias("__g"), F.col("p0").alias("p10"), F.col("p1").alias("p50"), F.col("p2").alias("p99"))
    return _m(sums.join(q, F.col("g").eqNullSafe(F.col("__g"))).drop("__g"), "p10", "p50", "p99")


@query(f"""WITH s AS (SELECT l_partkey, max(l_quantity)-min(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT count(*) AS n, {_mil('avg(v)')} AS mean, {_mil('stddev_samp(v)')} AS sd, min(v) AS min, quantile_cont(v,0.25) AS q25, median(v) AS q50, quantile_cont(v,0.75) AS q75, max(v) AS max FROM s""")
def spread_described(t):
    """The spread of ratings over items, described."""
    from lexmill.operators.order import percentiles
    from lexmill.operators.panel import spread

    x = spread(t.lineitem, "l_partkey", "l_quantity")
    q = percentiles(x, [], "spread", [0.25, 0.5, 0.75]).select(F.col("p0").alias("q25"), F.col("p1").alias("q50"), F.col("p2").alias("q75"))
    out = x.agg(F.count("*").alias("n"), F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("sd"), F.min("spread").alias("min"), F.max("spread").alias("max"))
    return _m(out.crossJoin(F.broadcast(q)).select("n", "mean", "sd", "min", "q25", "q50", "q75", "max"), "mean", "sd")  # two tables of one row


@query(f"""WITH x AS (SELECT l_suppkey%4 AS g, l_partkey%4 AS j, l_linenumber%2 AS q, CASE WHEN l_returnflag<>'R' THEN l_quantity END AS s FROM lineitem), m AS (SELECT g, j, avg(s) AS m, avg(s) FILTER (WHERE q=1)-avg(s) FILTER (WHERE q=0) AS e, avg(CASE WHEN s IS NULL THEN 1.0 ELSE 0.0 END) AS i FROM x GROUP BY ALL)
SELECT g, j, {_mil('m')} AS mean, {_mil('e')} AS effect, {_mil('i')} AS invalid, {_mil('m-avg(m) OVER (PARTITION BY j)')} AS over_judge FROM m""")
def judge_matrix_effects(t):
    """Mean scores of generators by judge, the effect of showing the question, the share without a score, and how far a mean is from the judge's own."""
    from pyspark.sql import Window

    x = t.lineitem.select((F.col("l_suppkey") % 4).alias("g"), (F.col("l_partkey") % 4).alias("j"), (F.col("l_linenumber") % 2).alias("q"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("s"))
    s = lambda q: F.avg(F.when(F.col("q") == q, F.col("s")))
    m = x.groupBy("g", "j").agg(F.avg("s").alias("mean"), (s(1) - s(0)).alias("effect"), F.avg(F.isnull("s").cast("int")).alias("invalid"))
    m = m.withColumn("over_judge", F.col("mean") - F.avg("mean").over(Window.partitionBy("j")))  # 4 x 4 rows
    return _m(m, "mean", "effect", "invalid", "over_judge")


@query("""SELECT source, count(*) FILTER (WHERE lang='en') AS n_en, count(*) FILTER (WHERE lang='de') AS n_de, count(*) FILTER (WHERE lang IN ('en','de')) AS total FROM documents GROUP BY source ORDER BY total DESC, source LIMIT 5""")
def crosstab_top5(t):
    """The five fullest rows of a cross table, in order of their totals."""
    return op.crosstab_by_total(t.documents, "source", "lang", ["en", "de"]).orderBy(F.desc("total"), "source").limit(5)


@query(f"""SELECT event_id, {_mil('p')} AS p, {_mil('h*1.0/n')} AS empirical, {_mil('t')} AS tolerance, p>t AS powered, abs(h*1.0/n-p)<=t AND p>t AS ok FROM (SELECT event_id, p, n, h, 4*sqrt(greatest(p*(1-p),1e-12)/n)+0.01 AS t FROM (SELECT event_id, (event_id%97)/100.0::DOUBLE AS p, 50+event_id%50 AS n, (event_id%89)*(50+event_id%50)//100 AS h FROM events))""")
def binomial_check(t):
    """Whether a share of hits agrees with its probability, and whether the test could tell."""
    n = 50 + F.col("event_id") % 50
    x = t.events.select("event_id", ((F.col("event_id") % 97) / 100.0).alias("p"), n.alias("n"), F.floor((F.col("event_id") % 89) * n / 100).alias("h"))
    return _m(op.binomial_check(x, "p", "h", "n"), "p", "empirical", "tolerance").select("event_id", "p", "empirical", "tolerance", "powered", "ok")


@query(f"""WITH d AS (SELECT o_orderpriority AS g, avg(o_totalprice) FILTER (WHERE o_orderstatus='F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus='O') AS b FROM orders GROUP BY 1) SELECT count(*) AS n, {_mil('avg(b-a)')} AS mean, count(*) FILTER (WHERE b>a) AS up, count(*) FILTER (WHERE b<a) AS down FROM d WHERE a IS NOT NULL AND b IS NOT NULL""")
def group_gaps(t):
    """The gap between two groups, with counts up and down."""
    from lexmill.operators.relational import delta_summary, paired

    return _m(delta_summary(paired(t.orders, ["o_orderpriority"], "o_orderstatus", "o_totalprice", "F", "O")).select("n", "mean", "up", "down"), "mean")


@query("""SELECT CAST(floor(log2(greatest(len(text),1))) AS INTEGER) AS rung, count(*) AS n, min(len(text)) AS shortest, max(len(text)) AS longest, CAST(greatest(ceil(count(*)/32.0),1) AS BIGINT) AS batches FROM documents GROUP BY 1""")
def length_batches(t):
    """Batches of texts of like length."""
    x = op.length_batches(t.documents.select("doc_id", "text"), "doc_id", F.length("text"), 32)
    n = F.count_distinct("batch")
    return x.groupBy("rung").agg(F.count("*").alias("n"), F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"), n.alias("batches"))


@query("""WITH s AS (SELECT doc_id, lo, least(lo+200, len(text)) AS hi, text FROM (SELECT doc_id, text, unnest(range(0, len(text), 400)) AS lo FROM documents)), p AS (SELECT doc_id, lo, list_filter(string_split(trim(regexp_replace(substr(text,1,lo),'\\s+',' ','g')),' '), lambda x: x<>'') AS w, trim(regexp_replace(substr(text,lo+1,hi-lo),'\\s+',' ','g')) AS a FROM s),
q AS (SELECT doc_id, lo, w[greatest(len(w)-49,1):] AS w, a, CASE WHEN a='' THEN 0 ELSE len(string_split(a,' ')) END AS n FROM p) SELECT doc_id, CAST(lo AS INTEGER) AS lo, md5(array_to_string(w,' ')) AS prompt, md5(a) AS answer FROM q WHERE len(w)>=30 AND n>=8""")
def emitted_spans(t):
    """Spans of 200 characters over every document with the fifty words before them, unless there are too few."""
    x = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(400))).alias("lo")).where(F.col("lo") < F.length("text"))
    x = op.emit_spans(x.withColumn("hi", F.least(F.col("lo") + 200, F.length("text"))), "text", "lo", "hi")
    return x.select("doc_id", "lo", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.md5(F.col("answer").cast("binary")).alias("answer"))


@query(f"""WITH b AS (SELECT DISTINCT item_id, unnest({_SH}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)), k AS (SELECT a.item_id AS a, c.item_id AS b FROM (SELECT DISTINCT item_id FROM b) a, (SELECT DISTINCT item_id FROM b) c WHERE a.item_id<c.item_id AND a.item_id%4=c.item_id%4),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), i AS (SELECT k.a, k.b, count(*) AS i FROM k JOIN b x ON x.item_id=k.a JOIN b y ON y.item_id=k.b AND y.s=x.s GROUP BY ALL)
SELECT k.a, k.b, coalesce(i,0) AS shared, na.n+nb.n-coalesce(i,0) AS in_either, na.n-coalesce(i,0) AS only_a FROM k LEFT JOIN i USING (a,b) JOIN n na ON na.item_id=k.a JOIN n nb ON nb.item_id=k.b""")
def shingle_sets(t):
    """Intersection, union and difference of shingle sets of items in the same group."""
    from lexmill.functions.text import shingle_words, shingles

    x = t.benchmark.select("item_id", F.explode(F.array(shingle_words(F.col("text")))).alias("w")).select("item_id", shingles(F.col("w"), 8).alias("s")).where(F.size("s") > 0)
    left, right = x.select(F.col("item_id").alias("a"), F.col("s").alias("sa"), (F.col("item_id") % 4).alias("g")), x.select(F.col("item_id").alias("b"), F.col("s").alias("sb"), (F.col("item_id") % 4).alias("g"))
    size = lambda c: F.size(c).cast("long")
    return left.join(right, "g").where("a < b").select("a", "b", size(F.array_intersect("sa", "sb")).alias("shared"), size(F.array_union("sa", "sb")).alias("in_either"), size(F.array_except("sa", "sb")).alias("only_a"))


@query("""SELECT model, family, count(*) AS n FROM (SELECT CASE user_id%4 WHEN 0 THEN 'alpha/large' WHEN 1 THEN 'alpha__small' WHEN 2 THEN 'beta/x' ELSE 'gamma' END AS model, CASE user_id%4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' ELSE 'gamma' END AS family FROM events) GROUP BY ALL""")
def families(t):
    """A model's family, from its name."""
    k = F.col("user_id") % 4
    model = F.when(k == 0, "alpha/large").when(k == 1, "alpha__small").when(k == 2, "beta/x").otherwise("gamma")
    return t.events.select(model.alias("model")).groupBy("model", rules.family(F.col("model")).alias("family")).agg(F.count("*").alias("n"))


@query(f"""SELECT event_id%6 AS run, count(*) AS n, {_mil("avg(CASE WHEN e THEN 1.0 ELSE 0.0 END)")} AS exact FROM (SELECT event_id, p IS NOT NULL AND p IS NOT DISTINCT FROM g AS e FROM (SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS p, CASE WHEN event_id%3=0 THEN true WHEN event_id%3=1 THEN false END AS g FROM events)) GROUP BY 1""")
def verdicts_exact(t):
    """K8: verdicts as truth values; exact if there is one and it is the gold one."""
    word = F.when(F.col("event_type") == "click", "violation").when(F.col("event_type") == "view", "no_violation").otherwise("unclear")
    gold = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    x = t.events.select("event_id", rules.verdict_value(word).alias("p"), gold.alias("g"))
    return x.groupBy((F.col("event_id") % 6).alias("run")).agg(F.count("*").alias("n"), millionths(F.avg(rules.exact_verdict(F.col("p"), F.col("g")).cast("int"))).alias("exact"))


@query("""SELECT CASE WHEN c='-' THEN '__residual' WHEN c IN ('s','v') THEN '__other' ELSE c END AS bucket, count(*) AS n FROM (SELECT CASE WHEN event_id%2=0 THEN substr(event_type,1,1) WHEN event_id%3=0 THEN substr(event_type,1,1)||'n' ELSE '-' END AS c FROM events) GROUP BY 1""")
def furniture_buckets(t):
    """K9: a span's own kind, else its neighbourhood's, else the rest; small kinds pooled."""
    own = F.when(F.col("event_id") % 2 == 0, F.substring("event_type", 1, 1)).otherwise("-")
    near = F.when(F.col("event_id") % 3 == 0, F.concat(F.substring("event_type", 1, 1), F.lit("n"))).otherwise("-")
    return t.events.groupBy(rules.furniture_bucket(own, near, ["s", "v"]).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE s_nationkey%6 WHEN 0 THEN 'federal' WHEN 1 THEN 'federal' WHEN 2 THEN 'federal' WHEN 3 THEN 'federal' WHEN 4 THEN 'state' END AS jurisdiction, CASE s_nationkey%6 WHEN 0 THEN 'supreme' WHEN 1 THEN 'appeal' WHEN 2 THEN 'appeal' WHEN 3 THEN 'district' WHEN 4 THEN 'state' END AS level FROM supplier""")
def court_levels(t):
    """K6: jurisdiction and level from a court's id."""
    k = F.col("s_nationkey") % 6
    court = F.when(k == 0, "SCOTUS").when(k == 1, "ca9").when(k == 2, "cadc").when(k == 3, "nysd").when(k == 4, "texapp")
    return t.supplier.select("s_suppkey", rules.court_level(court).alias("c")).select("s_suppkey", "c.jurisdiction", "c.level")


@query("""SELECT conv_id, turn, CASE WHEN t='' THEN false WHEN u THEN false ELSE regexp_matches(substr(t,1,400),'(?i)(cannot|can''t|unable to|not able to)') END AS refusal, u AS unknown FROM (SELECT conv_id, turn, trim(a) AS t, lower(trim(regexp_replace(a,'^[ .]+|[ .]+$','','g'))) IN ('unknown','i don''t know','i do not know') AS u FROM
(SELECT conv_id, turn, CASE (conv_id+turn)%6 WHEN 0 THEN 'UNKNOWN.' WHEN 1 THEN 'I do not know' WHEN 2 THEN 'I cannot do that' WHEN 3 THEN '' ELSE text END AS a FROM conversations))""")
def older_nonanswers(t):
    """K2: the older flags of refusals and of answers that say they don't know."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    a = F.when(k == 0, "UNKNOWN.").when(k == 1, "I do not know").when(k == 2, "I cannot do that").when(k == 3, "").otherwise(F.col("text"))
    refusal, unknown = rules.older_flags(a, r"(cannot|can't|unable to|not able to)")
    return t.conversations.select("conv_id", "turn", refusal.alias("refusal"), unknown.alias("unknown"))
