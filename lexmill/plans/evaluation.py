"""Queries on graded answers; lineitem and events stand in for judged answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.numbers import millionths
from lexmill.operators import evaluation as op
from lexmill.plans.registry import query


def _m(df, *cols):
    return df.withColumns({c: millionths(c) for c in cols})


@query("""SELECT event_type, hour, CAST(GROUPING(event_type)*2+GROUPING(hour) AS BIGINT) AS level, count(*) AS n, CAST(floor(avg(value)*1e6+0.5) AS BIGINT) AS mean_value
FROM (SELECT event_type, hour(ts) AS hour, value FROM events) GROUP BY GROUPING SETS ((event_type),(hour),())""")
def metric_means_grouping_sets(t):
    """A1: means by type, by hour and pooled."""
    out = op.means(t.events.select("event_type", F.hour("ts").cast("long").alias("hour"), "value"), ["event_type", "hour"], ["value"])
    return _m(out.withColumn("level", F.col("level").cast("long")), "mean_value")


@query("""WITH x AS (SELECT l_suppkey % 8 AS model, l_returnflag AS arm, l_discount*10 AS s, l_tax*10 AS r, l_linenumber=1 AS d, nullif(l_linestatus,'') AS lab, CASE WHEN l_quantity>25 THEN 'O' ELSE 'F' END AS cl FROM lineitem)
SELECT model, arm, count(*) AS n, CAST(floor(avg(s)*1e6+0.5) AS BIGINT) AS outcome, CAST(floor(avg(r)*1e6+0.5) AS BIGINT) AS reasoning,
CAST(floor(avg(CASE WHEN d THEN 1 ELSE 0 END)*1e6+0.5) AS BIGINT) AS declined, count(*) FILTER (WHERE NOT d AND lab IS NOT NULL) AS attempted,
CAST(floor(count(*) FILTER (WHERE NOT d AND lab=cl)*1.0/count(*) FILTER (WHERE NOT d AND lab IS NOT NULL)*1e6+0.5) AS BIGINT) AS hit,
CAST(floor(avg(CASE WHEN s>=0.99 THEN 1 ELSE 0 END)*1e6+0.5) AS BIGINT) AS "full", CAST(floor(avg(CASE WHEN s<=0.01 THEN 1 ELSE 0 END)*1e6+0.5) AS BIGINT) AS "none" FROM x GROUP BY model, arm""")
def model_arm_summary(t):
    """Summary by model and arm."""
    x = t.lineitem.select(
        (F.col("l_suppkey") % 8).alias("model"), F.col("l_returnflag").alias("arm"), (F.col("l_discount") * 10).alias("s"), (F.col("l_tax") * 10).alias("r"),
        (F.col("l_linenumber") == 1).alias("d"), F.nullif("l_linestatus", F.lit("")).alias("lab"), F.when(F.col("l_quantity") > 25, "O").otherwise("F").alias("cl"), F.lit("").alias("error"),
    )
    out = op.summary(op.graded(x, "error", "s", "r"), ["model", "arm"], F.col("s"), F.col("r"), F.col("d"), F.col("lab"), F.col("cl"))
    return _m(out, "outcome", "reasoning", "declined", "hit", "full", "none").drop("gap")


@query("""WITH x AS (SELECT event_type, CAST(user_id % 5 AS VARCHAR) AS model, value > 20 AS t, value > 60 AS h FROM events)
SELECT event_type, CASE WHEN GROUPING(model)=1 THEN 'POOLED' ELSE model END AS model, count(*) AS n, count(*) FILTER (WHERE t) AS attempted, count(*) FILTER (WHERE t AND h) AS hits,
CAST(floor(count(*) FILTER (WHERE t AND h)*1.0/count(*) FILTER (WHERE t)*1e6+0.5) AS BIGINT) AS accuracy FROM x GROUP BY GROUPING SETS ((event_type,model),(event_type)) HAVING count(*) FILTER (WHERE t)>0""")
def accuracy_with_pooled_row(t):
    """A3, A4: accuracy by model with a pooled row."""
    x = t.events.select("event_type", (F.col("user_id") % 5).alias("model"), "value")
    return _m(op.accuracy(x, "event_type", "model", F.col("value") > 20, F.col("value") > 60), "accuracy")


@query("""WITH n AS (SELECT o_orderstatus AS g, o_orderpriority AS l, count(*) AS c FROM orders GROUP BY ALL), p AS (SELECT *, c/CAST(sum(c) OVER (PARTITION BY g) AS DOUBLE) AS p, row_number() OVER (PARTITION BY g ORDER BY c DESC, l) AS k FROM n),
a AS (SELECT g, CAST(sum(c) AS BIGINT) AS n, count(*) AS k, sum(p*p) AS matched, max(p) AS mode_share, max(CASE WHEN k=1 THEN l END) AS mode, coalesce(max(CASE WHEN l='1-URGENT' THEN p END),0) AS always, 1.0/count(*) AS uniform FROM p GROUP BY g)
SELECT g AS o_orderstatus, n, k, CAST(floor(matched*1e6+0.5) AS BIGINT) AS matched, CAST(floor(mode_share*1e6+0.5) AS BIGINT) AS mode_share, mode, CAST(floor(always*1e6+0.5) AS BIGINT) AS always,
CAST(floor(uniform*1e6+0.5) AS BIGINT) AS uniform, CAST(floor(greatest(uniform,matched,mode_share,always)*1e6+0.5) AS BIGINT) AS strongest FROM a""")
def knowledge_free_baselines(t):
    """A5: baselines for order priorities by status."""
    out = op.baselines(t.orders, ["o_orderstatus"], "o_orderpriority", "1-URGENT")
    return _m(out, "matched", "mode_share", "always", "uniform", "strongest")


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_discount<=0.02 AND l_linenumber<>7) AS misses, CAST(floor(avg(l_discount)*1e6+0.5) AS BIGINT) AS mean_score,
coalesce(string_agg(l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE l_discount<=0.02 AND l_linenumber<>7),'') AS labels FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_discount<=0.02 AND l_linenumber<>7)>0""")
def misses_by_case(t):
    """Orders with low-discount lines."""
    return _m(op.misses(t.lineitem, "l_orderkey", "l_discount", "l_returnflag", F.col("l_linenumber") == 7, 0.02), "mean_score")


@query("""WITH n AS (SELECT o_orderstatus, l_returnflag, count(*) AS n FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY ALL)
SELECT *, CAST(floor(n/CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS DOUBLE)*1e6+0.5) AS BIGINT) AS share FROM n""")
def confusion_row_normalised(t):
    """Order status against return flag."""
    j = t.orders.select("o_orderkey", "o_orderstatus").join(t.lineitem.select("l_orderkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    return _m(op.confusion(j, "o_orderstatus", "l_returnflag"), "share")


@query("""WITH x AS (SELECT l_suppkey AS model, l_returnflag AS truth, count(*) AS n, count(*) FILTER (WHERE l_quantity>10) AS attempted, count(*) FILTER (WHERE l_quantity>10 AND l_linestatus='O') AS hits FROM lineitem GROUP BY ALL)
SELECT *, CAST(floor(hits*1.0/nullif(attempted,0)*1e6+0.5) AS BIGINT) AS rate, CASE WHEN attempted=0 THEN 'declined all '||n WHEN attempted<5 THEN 'thin' ELSE '' END AS note FROM x""")
def hit_rate_by_class(t):
    """Hit rates with thin cells marked."""
    x = t.lineitem.select(F.col("l_suppkey").alias("model"), F.col("l_returnflag").alias("truth"), "l_quantity", "l_linestatus")
    return _m(op.hit_rates(x, "model", "truth", F.col("l_quantity") <= 10, F.col("l_linestatus") == "O"), "rate")


@query("""SELECT user_id, count(*) AS n, CAST(floor(avg(CASE WHEN event_type='click' THEN 1.0 ELSE 0.0 END)*100*1e6+0.5) AS BIGINT) AS pct_click, CAST(floor(avg(CASE WHEN event_type='view' THEN 1.0 ELSE 0.0 END)*100*1e6+0.5) AS BIGINT) AS pct_view FROM events GROUP BY user_id""")
def disposition_shares(t):
    """Shares of event types by user."""
    return _m(op.shares(t.events, ["user_id"], "event_type", ["click", "view"]), "pct_click", "pct_view")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value>30) AS attempts, CAST(floor(avg(CASE WHEN value>30 THEN value END)*1e6+0.5) AS BIGINT) AS conditional,
CAST(floor(avg(CASE WHEN value>30 THEN value ELSE 0 END)*1e6+0.5) AS BIGINT) AS unconditional FROM events GROUP BY event_type""")
def conditional_vs_unconditional_mean(t):
    """Means over attempts and over all."""
    return _m(op.conditional_means(t.events, "event_type", "value", F.col("value") > 30), "conditional", "unconditional")


@query("""WITH b AS (SELECT l_returnflag, CASE WHEN l_quantity>=20 THEN 4 WHEN l_quantity>=10 THEN 3 WHEN l_quantity>=5 THEN 2 WHEN l_quantity>=2 THEN 1 WHEN l_quantity>=0 THEN 0 END AS bin FROM lineitem), n AS (SELECT l_returnflag, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL)
SELECT *, CAST(floor(n/CAST(sum(n) OVER (PARTITION BY l_returnflag) AS DOUBLE)*1e6+0.5) AS BIGINT) AS share FROM n""")
def histogram_bins(t):
    """Quantities in bins."""
    return _m(op.histogram(t.lineitem, "l_returnflag", "l_quantity", [0, 2, 5, 10, 20]), "share")


@query("""SELECT l_returnflag, count(*) AS clusters, CAST(floor(avg(m)*1e6+0.5) AS BIGINT) AS mean_of_means FROM (SELECT l_returnflag, l_partkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def cluster_means(t):
    """Means of part means."""
    return _m(op.cluster_means(t.lineitem, "l_returnflag", "l_partkey", "l_quantity"), "mean_of_means")


@query("""SELECT l_returnflag, e, count(*) AS n, CAST(floor(avg(CASE WHEN -l_quantity/2 >= -e*ln(10.0) THEN 1.0 ELSE 0.0 END)*100*1e6+0.5) AS BIGINT) AS pct FROM lineitem, (SELECT unnest(range(1,13)) AS e) GROUP BY l_returnflag, e""")
def extractability_curve(t):
    """The share of rows above falling probability thresholds."""
    x = t.lineitem.select("l_returnflag", (-F.col("l_quantity") / 2).alias("logp"))
    return _m(op.threshold_curve(x, "l_returnflag", "logp"), "pct").withColumn("e", F.col("e").cast("long"))


@query("""WITH n AS (SELECT l_suppkey%6 AS model, l_linenumber AS item, sum(l_quantity) AS s FROM lineitem GROUP BY ALL), p AS (SELECT *, s/sum(s) OVER (PARTITION BY model) AS share FROM n)
SELECT model, item, CAST(floor(share*1e6+0.5) AS BIGINT) AS share, CAST(floor((share-avg(share) OVER (PARTITION BY item))*100*1e6+0.5) AS BIGINT) AS tilt FROM p""")
def presence_rate_tilt(t):
    """Each model's share of an item against the mean share."""
    x = t.lineitem.select((F.col("l_suppkey") % 6).alias("model"), F.col("l_linenumber").alias("item"), "l_quantity")
    return _m(op.extremes_vs_mean(x, "model", "item", "l_quantity"), "share", "tilt")
