"""Queries on judge panels and model profiles; lineitem's parts are items, suppliers modulo 4 judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.numbers import millionths
from lexmill.operators import panel as op
from lexmill.plans.registry import query


def _ratings(t):
    return t.lineitem.select(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 4).alias("judge"), F.col("l_quantity").alias("v"))


def _m(df, *cols):
    return df.withColumns({c: millionths(c) for c in cols})


_R = "r AS (SELECT l_partkey AS item, l_suppkey%4 AS judge, l_quantity AS v FROM lineitem)"
_P = f"{_R}, j AS (SELECT item, judge, avg(v) AS v FROM r GROUP BY ALL), p AS (SELECT l.item, l.judge AS a, k.judge AS b, l.v AS x, k.v AS y FROM j l JOIN j k ON l.item=k.item AND l.judge<k.judge)"


@query(f"""WITH {_R}, u AS (SELECT item, count(*) AS n, sum(v) AS s, sum(v*v) AS q FROM r GROUP BY item HAVING count(*)>1), a AS (SELECT count(*) AS units, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(2*(n*q-s*s)/(n-1)) AS o FROM u)
SELECT units, CAST(n AS BIGINT) AS ratings, CAST(floor((1-(o/n)/(2*(n*q-s*s)/(n*(n-1))))*1e6+0.5) AS BIGINT) AS alpha FROM a""")
def krippendorff_alpha(t):
    """Interval alpha."""
    return _m(op.krippendorff_alpha(_ratings(t), "item", "v"), "alpha")


@query(f"""WITH {_P}, k AS (SELECT a, b, x, y, rank() OVER (PARTITION BY a,b ORDER BY x)+(count(*) OVER (PARTITION BY a,b,x)-1)/2.0 AS rx, rank() OVER (PARTITION BY a,b ORDER BY y)+(count(*) OVER (PARTITION BY a,b,y)-1)/2.0 AS ry FROM p)
SELECT a, b, count(*) AS n, CAST(floor(corr(x,y)*1e6+0.5) AS BIGINT) AS pearson, CAST(floor(corr(rx,ry)*1e6+0.5) AS BIGINT) AS spearman, CAST(floor(avg(x-y)*1e6+0.5) AS BIGINT) AS mean_diff, CAST(floor(avg(abs(x-y))*1e6+0.5) AS BIGINT) AS mad FROM k GROUP BY a,b HAVING count(*)>=3""")
def judge_pair_agreement(t):
    """Correlations of each pair of judges."""
    return _m(op.pair_agreement(op.judge_pairs(_ratings(t), "item", "judge", "v")), "pearson", "spearman", "mean_diff", "mad")


@query("""WITH r AS (SELECT l_partkey AS item, l_suppkey%4 AS judge, l_linenumber AS v FROM lineitem), j AS (SELECT item, judge, avg(v) AS v FROM r GROUP BY ALL), p AS (SELECT l.judge AS a, k.judge AS b, l.v AS x, k.v AS y FROM j l JOIN j k ON l.item=k.item AND l.judge<k.judge)
SELECT a, b, count(*) AS n, CAST(floor(avg(CASE WHEN x=y THEN 1.0 ELSE 0.0 END)*1e6+0.5) AS BIGINT) AS exact, CAST(floor(avg(CASE WHEN x IN (1,2,3,4,5) AND y IN (1,2,3,4,5) AND abs(x-y)<=1 THEN 1.0 ELSE 0.0 END)*1e6+0.5) AS BIGINT) AS adjacent FROM p GROUP BY a,b""")
def anchor_agreement(t):
    """Agreement on five levels."""
    r = t.lineitem.select(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 4).alias("judge"), F.col("l_linenumber").alias("v"))
    return _m(op.anchor_agreement(op.judge_pairs(r, "item", "judge", "v"), [1, 2, 3, 4, 5]), "exact", "adjacent")


@query(f"""WITH {_R}, m AS (SELECT *, max(v) OVER (PARTITION BY judge) AS m FROM r) SELECT judge, count(v) AS n, CAST(floor(avg(v)*1e6+0.5) AS BIGINT) AS mean, CAST(floor(stddev_samp(v)*1e6+0.5) AS BIGINT) AS sd, CAST(floor(median(v)*1e6+0.5) AS BIGINT) AS median, CAST(floor(avg(CASE WHEN v=m THEN 1.0 ELSE 0.0 END)*1e6+0.5) AS BIGINT) AS at_max FROM m GROUP BY judge""")
def judge_usage(t):
    """How judges use the scale."""
    return _m(op.judge_usage(_ratings(t), "judge", "v"), "mean", "sd", "median", "at_max")


@query(f"WITH {_R} SELECT item, count(v) AS n, max(v)-min(v) AS spread FROM r GROUP BY item ORDER BY spread DESC, item LIMIT 10")
def spread_top10(t):
    """Items that judges differ on most."""
    return op.spread(_ratings(t), "item", "v").orderBy(F.desc("spread"), "item").limit(10)


_S = "s AS (SELECT user_id AS c, event_id%5 AS model, event_type AS f FROM events)"


@query(f"""WITH {_S}, n AS (SELECT c, count(DISTINCT f) AS total FROM s GROUP BY c) SELECT c, model, count(DISTINCT f) AS found, total, CAST(floor(count(DISTINCT f)*1.0/total*1e6+0.5) AS BIGINT) AS coverage FROM s JOIN n USING (c) GROUP BY c, model, total""")
def coverage_ratio(t):
    """How many of a user's event types each model saw."""
    s = t.events.select(F.col("user_id").alias("c"), (F.col("event_id") % 5).alias("model"), F.col("event_type").alias("f"))
    return _m(op.coverage(s, s.groupBy("c").agg(F.countDistinct("f").alias("total")), "c", "model", "f"), "coverage")


@query("""WITH s AS (SELECT user_id AS c, event_id%5 AS model, (event_id//5)%12 AS f FROM events), g AS (SELECT DISTINCT c FROM s WHERE model=0), k AS (SELECT c, f, count(DISTINCT model) AS k FROM s WHERE model<>0 GROUP BY c, f HAVING count(DISTINCT model)>=0.75*(SELECT count(DISTINCT model) FROM s WHERE model<>0)),
m AS (SELECT * FROM k WHERE c IN (SELECT c FROM g) AND NOT EXISTS (SELECT 1 FROM s WHERE model=0 AND s.c=k.c AND s.f=k.f)) SELECT c, count(*) AS misses, string_agg('['||k||'] '||f, '; ' ORDER BY k DESC, CAST(f AS VARCHAR)) AS slots FROM m GROUP BY c""")
def consensus_misses(t):
    """Slots that most models name and the gold answer doesn't."""
    s = t.events.select(F.col("user_id").alias("c"), (F.col("event_id") % 5).alias("model"), (F.floor(F.col("event_id") / 5) % 12).alias("f"))
    return op.consensus_misses(s, "c", "model", "f", 0, 0.75)


_J = """s AS (SELECT DISTINCT l_suppkey%12 AS model, l_orderkey AS c, l_partkey%40 AS f FROM lineitem), n AS (SELECT model, f, count(*) AS c FROM s GROUP BY ALL), p AS (SELECT model, f, c/CAST(sum(c) OVER (PARTITION BY model) AS DOUBLE) AS p FROM n),
z AS (SELECT a.model AS a, b.model AS b, f.f FROM (SELECT DISTINCT model FROM p) a, (SELECT DISTINCT model FROM p) b, (SELECT DISTINCT f FROM p) f WHERE a.model<b.model),
x AS (SELECT z.a, z.b, coalesce(l.p,0) AS p, coalesce(r.p,0) AS q FROM z LEFT JOIN p l ON l.model=z.a AND l.f=z.f LEFT JOIN p r ON r.model=z.b AND r.f=z.f),
d AS (SELECT a, b, sum(CASE WHEN p>0 THEN p*log2(p/((p+q)/2))/2 ELSE 0 END+CASE WHEN q>0 THEN q*log2(q/((p+q)/2))/2 ELSE 0 END) AS d FROM x GROUP BY a,b)"""


def _jsd(t):
    s = t.lineitem.select((F.col("l_suppkey") % 12).alias("model"), F.col("l_orderkey").alias("c"), (F.col("l_partkey") % 40).alias("f"))
    return op.jsd(op.profiles(s, "model", "f", "c"), "model", "f")


def _families(t):
    return t.spark.range(12).select(F.col("id").alias("model"), (F.col("id") % 3).alias("family"))


@query(f"WITH {_J} SELECT a, b, CAST(floor(d*1e6+0.5) AS BIGINT) AS d FROM d")
def jsd_matrix(t):
    """Divergence of models' selection profiles."""
    return _m(_jsd(t), "d")


@query(f"""WITH {_J}, f AS (SELECT avg(CASE WHEN a%3=b%3 THEN d END) AS w, avg(CASE WHEN a%3<>b%3 THEN d END) AS x FROM d) SELECT CAST(floor(w*1e6+0.5) AS BIGINT) AS within, CAST(floor(x*1e6+0.5) AS BIGINT) AS across, CAST(floor(w/x*1e6+0.5) AS BIGINT) AS ratio FROM f""")
def within_across_ratio(t):
    """R2: divergence within families against across."""
    return _m(op.family_ratio(_jsd(t), _families(t), "model", "family"), "within", "across", "ratio")


@query(f"""WITH {_J}, s2 AS (SELECT a,b,d FROM d UNION ALL SELECT b,a,d FROM d), k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM s2), m AS (SELECT a%3 AS f, count(*) AS nf, count(*) FILTER (WHERE a%3=b%3) AS hits FROM k WHERE r=1 GROUP BY 1)
SELECT CAST(sum(nf) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits, CAST(floor(sum(nf*(nf-1))/(sum(nf)*(sum(nf)-1))*1e6+0.5) AS BIGINT) AS chance FROM m""")
def nearest_neighbour_purity(t):
    """Nearest neighbours of the same family."""
    return _m(op.family_recovery(_jsd(t), _families(t), "model", "family"), "chance")
