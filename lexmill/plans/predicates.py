"""Queries on what counts: predicates, projections, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.numbers import millionths
from lexmill.operators import records as op
from lexmill.operators.relational import top_n
from lexmill.plans.registry import query

# parts stand for question records: brands with a chapter mark as cases, sizes as questions, names as texts
_QA = """qa AS (SELECT p_brand||'_ch'||p_partkey AS case_id, 'Q0'||(p_size%5) AS qid, CASE WHEN p_partkey%3=0 THEN 'A' WHEN p_partkey%3=1 THEN 'D' END AS tier, CASE WHEN p_partkey%7=0 THEN '0' ELSE '1' END AS found,
split_part(p_name,' ',1) AS prompt, CASE WHEN p_size%11=0 THEN ' ' ELSE split_part(p_name,' ',2) END AS answer FROM part)"""


def _qa(t):
    k = F.col("p_partkey")
    return t.part.select(
        F.concat("p_brand", F.lit("_ch"), k.cast("string")).alias("case_id"), F.concat(F.lit("Q0"), (F.col("p_size") % 5).cast("string")).alias("qid"),
        F.when(k % 3 == 0, "A").when(k % 3 == 1, "D").alias("tier"), F.when(k % 7 == 0, "0").otherwise("1").alias("found"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prompt"),
        F.when(F.col("p_size") % 11 == 0, " ").otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("answer"),
    )


_OK = "coalesce(tier,'D')='D' AND qid<>'Q03'"


@query(f"WITH {_QA} SELECT case_id, qid, regexp_extract(case_id,'^(.*)_ch',1) AS work, trim(prompt) AS prefix, trim(answer) AS suffix FROM qa WHERE found='1' AND {_OK} AND trim(prompt)<>'' AND trim(answer)<>''")
def scoring_pairs(t):
    """Pairs that may be scored."""
    return op.scoring_pairs(_qa(t))


# events stand for scored rows: the type tells what kind of answer it was
_SCORED = "s AS (SELECT event_id, user_id, 'Q0'||(event_id%5) AS qid, CASE WHEN event_id%4=0 THEN 'A' ELSE 'D' END AS tier, event_type, value FROM events)"


def _scored(t):
    return t.events.select("event_id", "user_id", F.concat(F.lit("Q0"), (F.col("event_id") % 5).cast("string")).alias("qid"), F.when(F.col("event_id") % 4 == 0, "A").otherwise("D").alias("tier"), "event_type", "value")


@query(f"""WITH {_SCORED} SELECT 'taxonomy' AS rule, event_id FROM s WHERE {_OK} AND event_type='purchase' UNION ALL SELECT 'legacy', event_id FROM s WHERE {_OK} AND event_type NOT IN ('error','signup')""")
def attempts(t):
    """Attempts by the taxonomy's column, and by the older flags."""
    s = _scored(t)
    new = op.attempts(s.withColumn("nonanswer", F.when(F.col("event_type") == "purchase", "attempt").otherwise(F.col("event_type"))))
    old = op.attempts(s.withColumn("errored", F.col("event_type") == "error").withColumn("unknown", F.when(F.col("event_type") == "signup", 1)))
    return new.select(F.lit("taxonomy").alias("rule"), "event_id").union(old.select(F.lit("legacy"), "event_id"))


@query("""SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_partkey%3=0) AS n_pre FROM lineitem WHERE l_returnflag='A' AND l_linestatus='F' AND l_partkey%5<>2 GROUP BY l_linenumber""")
def filtered_counts(t):
    """Equality on several columns, arms by a part of their name, leaked questions left out."""
    x = op.matching(t.lineitem, {"l_returnflag": "A", "l_linestatus": "F"}).where(~(F.col("l_partkey") % 5).isin(2))
    arm = F.when(F.col("l_partkey") % 3 == 0, "court_pre_cutoff").otherwise("court_post")
    return x.withColumn("arm", arm).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("arm").contains("pre")).alias("n_pre"))


_VERDICT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'exact' WHEN '2-HIGH' THEN 'match' WHEN '3-MEDIUM' THEN 'fetched_by_id' WHEN '5-LOW' THEN 'weak' END"


@query(f"""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_VERDICT}='weak') GROUP BY l_orderkey""")
def verified_matches(t):
    """Rows of the cases whose match isn't known to be wrong."""
    p = F.col("o_orderpriority")
    verdict = F.when(p == "1-URGENT", "exact").when(p == "2-HIGH", "match").when(p == "3-MEDIUM", "fetched_by_id").when(p == "5-LOW", "weak")
    m = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), verdict.alias("verdict"))
    return op.without_bad_matches(t.lineitem, m, "l_orderkey", "verdict").groupBy("l_orderkey").agg(F.count("*").alias("n"))


_GEN = "g AS (SELECT event_id, event_type AS dataset, user_id%12 AS model FROM events), z AS (SELECT *, CASE WHEN model IN (3,7) THEN 'excluded_model' WHEN dataset IN ('error','view') THEN 'unknown_dataset' WHEN event_id%2=1 THEN 'unwanted' ELSE 'kept' END AS state FROM g)"


def _generations(t):
    g = t.events.select("event_id", F.col("event_type").alias("dataset"), (F.col("user_id") % 12).alias("model"))
    known = t.spark.createDataFrame([("click",), ("purchase",), ("signup",)], "dataset string")
    return op.generation_state(g, "dataset", "model", known, [3, 7], F.col("event_id") % 2 == 0)


@query(f"WITH {_GEN} SELECT dataset, state, count(*) AS n FROM z GROUP BY ALL")
def generation_filter(t):
    """P10: generations kept and left out, with the reason."""
    return _generations(t).groupBy("dataset", "state").agg(F.count("*").alias("n"))


@query(f"WITH {_GEN} SELECT dataset, event_id, CAST(row_number() OVER (PARTITION BY dataset ORDER BY event_id) AS INTEGER) AS rank FROM z WHERE state='kept' QUALIFY rank<=25")
def generation_head(t):
    """The first generations of each data set, as a report of so many, with their rank."""
    return top_n(_generations(t).where("state = 'kept'"), ["dataset"], [F.col("event_id")], 25).select("dataset", "event_id", "rank")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE coalesce(toxic=0, false)) AS valid FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def valid_or_not(t):
    """A missing verdict counts as invalid."""
    x = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("valid"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL AND nullif(user_id%10,0) IS NOT NULL AND CASE WHEN event_id%13=0 THEN NULL ELSE ts END IS NOT NULL GROUP BY event_type""")
def malformed_keys(t):
    """Rows that lack a part of their key are left out."""
    x = t.events.withColumn("case", F.nullif(F.col("user_id") % 10, F.lit(0))).withColumn("model", F.when(F.col("event_id") % 13 != 0, F.col("ts")))
    return x.na.drop(subset=["event_type", "case", "model"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT 'other' AS gone, count(*) AS before, count(*) FILTER (WHERE trim(lower(CASE WHEN o_custkey%6=0 THEN ' Other' ELSE o_orderpriority END))<>'other') AS after, false AS no_op FROM orders
UNION ALL SELECT 'absent', count(*), count(*), true FROM orders""")
def class_dropped(t):
    """A class taken out, with a note where that changes nothing."""
    x = t.orders.withColumn("label", F.when(F.col("o_custkey") % 6 == 0, " Other").otherwise(F.col("o_orderpriority")))
    out = None
    for gone in ("other", "absent"):
        rows, told = op.drop_class(x, "label", gone)
        one = rows.agg(F.count("*").alias("after")).join(F.broadcast(told.select("before", "no_op"))).select(F.lit(gone).alias("gone"), "before", "after", "no_op")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT source, count(*) AS n, min(doc_id) AS first FROM documents WHERE len(text)>=500 AND DATE '2020-01-01' + CAST(doc_id%900 AS INTEGER) > DATE '2020-06-30' GROUP BY source""")
def long_and_late(t):
    """Long enough texts that came after a date."""
    date = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int"))
    x = t.documents.where((F.length("text") >= 500) & (date > F.lit("2020-06-30").cast("date")))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""SELECT conv_id AS id, turn AS run, upper(role) AS speaker, md5(text) AS answer, CASE WHEN turn<2 THEN 'opening' WHEN turn<5 THEN 'middle' ELSE 'late' END AS series, CASE role WHEN 'user' THEN 'asked' WHEN 'assistant' THEN 'answered' ELSE 'other' END AS label FROM conversations""")
def reshaped_rows(t):
    """Columns renamed and made anew, rows labelled by group."""
    c = t.conversations.withColumnsRenamed({"conv_id": "id", "turn": "run", "text": "answer"})
    series = F.when(F.col("run") < 2, "opening").when(F.col("run") < 5, "middle").otherwise("late")
    label = F.when(F.col("role") == "user", "asked").when(F.col("role") == "assistant", "answered").otherwise("other")
    return c.select("id", "run", F.upper("role").alias("speaker"), F.md5(F.col("answer").cast("binary")).alias("answer"), series.alias("series"), label.alias("label"))


@query("""SELECT event_id, CASE WHEN event_type<>'error' THEN value END AS similarity, CASE WHEN event_id%2=0 THEN CAST(json_extract(props,'$.k') AS BIGINT) END AS direction, CASE WHEN event_id%2=1 THEN CAST(json_extract(props,'$.k') AS BIGINT)>50 END AS exact FROM events""")
def flat_summary(t):
    """Nested results as flat columns, absent parts null."""
    k = F.get_json_object("props", "$.k").cast("long")
    x = t.events.select(
        "event_id", F.when(F.col("event_type") != "error", F.struct(F.col("value").alias("content"))).alias("similarity"),
        F.struct(F.when(F.col("event_id") % 2 == 0, F.struct(k.alias("value"))).alias("soft"), F.when(F.col("event_id") % 2 == 1, F.struct((k > 50).alias("exact"))).alias("binary")).alias("outcome"),
    )
    return op.flat_summary(x, ["event_id"], {"similarity": "similarity.content", "direction": "outcome.soft.value", "exact": "outcome.binary.exact"})


@query("""SELECT conv_id, 2*count(*)+1 AS strings, md5('case '||conv_id||'|'||string_agg(role||'|'||text,'|' ORDER BY turn)) AS joined, md5(replace('case '||conv_id||'|'||string_agg(role||'|'||text,'|' ORDER BY turn),'e','(e)')) AS mapped FROM conversations GROUP BY conv_id""")
def text_leaves(t):
    """P25: all strings of a nested record, collected and mapped."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["turn"].alias("turn")))
    r = t.conversations.groupBy("conv_id").agg(turns.alias("turns"))
    r = r.select("conv_id", F.struct(F.concat(F.lit("case "), F.col("conv_id").cast("string")).alias("title"), "turns").alias("r"))
    kind = r.schema["r"].dataType
    r = r.select("conv_id", "r", op.map_strings(F.col("r"), kind, lambda x: F.replace(x, F.lit("e"), F.lit("(e)"))).alias("up"))
    joined = lambda c: F.md5(F.array_join(op.text_leaves(F.col(c), kind), "|").cast("binary"))
    return r.select("conv_id", F.size(op.text_leaves(F.col("r"), kind)).cast("long").alias("strings"), joined("r").alias("joined"), joined("up").alias("mapped"))


@query("""WITH n AS (SELECT DISTINCT needle FROM (SELECT substr(n_name, 8) AS needle FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT 'nowhere')),
h AS (SELECT needle, count(n_name) AS hits, min(n_name) AS m FROM n LEFT JOIN (SELECT DISTINCT n_name FROM nation) ON contains(lower(n_name), lower(needle)) GROUP BY needle)
SELECT needle, hits, CASE WHEN hits=1 THEN m END AS match, CASE WHEN hits=0 THEN 'none' WHEN hits>1 THEN 'several' END AS problem FROM h""")
def unique_match(t):
    """The only name that contains what was typed."""
    n = t.nation.select(F.substring("n_name", 8, 100).alias("needle")).union(t.nation.select(F.lower("n_name"))).union(t.spark.range(1).select(F.lit("nowhere")))
    return op.unique_match(n, "needle", t.nation, "n_name")


@query("""SELECT 'c'||c_custkey AS id, 'customer' AS kind, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT 'p'||p_partkey, 'part', NULL, p_brand FROM part""")
def heterogeneous_union(t):
    """Records of two kinds in one table."""
    c = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    p = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("kind"), F.col("p_brand").alias("brand"))
    return op.union_all([c, p]).select("id", "kind", "segment", "brand")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text),'[a-z]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w,1) AS i FROM w), f AS (SELECT doc_id, t, min(i) AS i FROM u GROUP BY ALL)
SELECT doc_id, count(t) AS n, md5(coalesce(string_agg(t,' ' ORDER BY i),'')) AS words FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def ordered_distinct(t):
    """The different words of a text in the order of their first occurrence."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ").cast("binary")).alias("words"))
