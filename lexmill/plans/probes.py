"""Queries on probe questions, prompts, judges' matrices and name swaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import headings, names
from lexmill.functions.numbers import millionths
from lexmill.operators import questions as op
from lexmill.operators import stats
from lexmill.plans.registry import query
from lexmill.plans.texts import _WEIGHT, _ab, _mil


def _m(df, *cols):
    return df.withColumns({c: millionths(c) for c in cols})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, id FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag||printf('%04d', row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey)) AS id FROM lineitem)""")
def span_ids(t):
    """Ids that count within a group."""
    x = t.lineitem
    return op.span_ids(x, "l_returnflag", F.col("l_returnflag"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "id")


@query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS number, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)-1)//10 AS INTEGER) AS batch FROM part""")
def batch_numbering(t):
    """Numbers and batches of ten within a brand."""
    return op.batches(t.part, "p_brand", ["p_partkey"], 10).select("p_partkey", "number", "batch")


@query("""WITH x AS (SELECT l_suppkey%4 AS g, l_partkey%4 AS j, l_quantity AS s FROM lineitem) SELECT g, CAST(floor(avg(s) FILTER (WHERE j=0)*1e6+0.5) AS BIGINT) AS by_0, CAST(floor(avg(s) FILTER (WHERE j=1)*1e6+0.5) AS BIGINT) AS by_1, CAST(floor(avg(s) FILTER (WHERE j=2)*1e6+0.5) AS BIGINT) AS by_2, CAST(floor(avg(s) FILTER (WHERE j=3)*1e6+0.5) AS BIGINT) AS by_3, CAST(floor(avg(s)*1e6+0.5) AS BIGINT) AS mean, CAST(floor(avg(s) FILTER (WHERE j=g)*1e6+0.5) AS BIGINT) AS own FROM x GROUP BY g""")
def generator_judge_matrix(t):
    """Mean scores by generator and judge, own judging apart."""
    x = t.lineitem.select((F.col("l_suppkey") % 4).alias("g"), (F.col("l_partkey") % 4).alias("j"), F.col("l_quantity").alias("s"))
    return _m(op.judge_matrix(x, "g", "j", "s", [0, 1, 2, 3]), "by_0", "by_1", "by_2", "by_3", "mean", "own")


@query("""SELECT l_partkey, count(l_quantity) AS runs, CAST(floor(avg(l_quantity)*1e6+0.5) AS BIGINT) AS mean, CAST(floor(stddev_samp(l_quantity)*1e6+0.5) AS BIGINT) AS sd, CAST(floor(var_samp(l_quantity)*1e6+0.5) AS BIGINT) AS var FROM lineitem GROUP BY l_partkey""")
def run_variance(t):
    """Variance over runs."""
    return _m(op.run_variance(t.lineitem, ["l_partkey"], "l_quantity"), "mean", "sd", "var")


@query("""SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey%4) AS n, count(DISTINCT l_suppkey%4)||'v'||(4-count(DISTINCT l_suppkey%4)) AS split FROM lineitem GROUP BY ALL""")
def family_split(t):
    """By how many families a feature is named."""
    return op.family_split(t.lineitem.withColumn("fam", F.col("l_suppkey") % 4), "l_partkey", "l_linenumber", "fam", 4)


@query("""WITH u AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) SELECT conv_id, turn, md5('QUESTION:'||chr(10)||q||chr(10)||chr(10)||'ANSWER:'||chr(10)||a) AS prompt FROM u WHERE q IS NOT NULL AND a IS NOT NULL""")
def judge_prompts(t):
    """Prompts for a judge from neighbouring turns."""
    from pyspark.sql import Window

    x = t.conversations.withColumn("a", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("text is not null and a is not null")
    return x.select("conv_id", "turn", F.md5(op.judge_prompt(F.col("text"), F.col("a")).cast("binary")).alias("prompt"))


@query("""WITH a AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500), b AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500) SELECT count(*) AS shared, CAST(floor(count(*)/500.0*1e6+0.5) AS BIGINT) AS share FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def top_overlap(t):
    """What two rankings' first 500 share."""
    return _m(op.overlap_of_tops(t.orders, "o_orderkey", F.desc("o_totalprice"), F.col("o_orderdate"), 500), "share")


@query("""SELECT DISTINCT string_split(p_name,' ')[2] AS feature FROM part""")
def distinct_features(t):
    """H2: all features over all cases."""
    return t.part.select(F.explode(F.slice(F.split("p_name", " "), 2, 1)).alias("feature")).distinct()


@query("""SELECT p_brand, md5(string_agg(rn||'. '||p_name, chr(10) ORDER BY rn)) AS lines FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS rn FROM (SELECT DISTINCT p_brand, p_name FROM part)) GROUP BY p_brand""")
def numbered_lists(t):
    """A group's features as a numbered list."""
    g = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("f"))
    return g.select("p_brand", F.md5(op.numbered(F.col("f")).cast("binary")).alias("lines"))


@query()
def probe_questions(t):
    """D9 in part: first and last sentence and completions at seven depths; see questions_of_documents for all ids."""
    asked = [q for q in op.ON_TEXTS if q.qid < "Q14"]
    q = op.questions(t.documents, "doc_id", "text", index=F.col("doc_id"), asked=asked)
    return q.select("doc_id", "qid", "prompt", "answer", "found")


def _swapped(t):
    text = F.concat(F.lit("Mr. Ann Lee said that he and "), F.col("c_name"), F.lit(" met Lee; His view was that Leeway, he said himself, matters. "), F.when(F.col("c_custkey") % 5 == 0, "Annie saw Ann.").otherwise("No more."))
    x = t.customer.select("c_custkey", text.alias("before"))
    return x.withColumn("after", names.swapped(F.col("before"), {"Mr. Ann Lee": "Ms. Eve Roe", "Lee": "Roe", "Ann": "Eve"}, "female"))


_SWAPPED = "x AS (SELECT c_custkey, 'Ms. Eve Roe said that she and '||c_name||' met Roe; Her view was that Leeway, she said herself, matters. '||CASE WHEN c_custkey%5=0 THEN 'Annie saw Eve.' ELSE 'No more.' END AS after FROM customer)"


@query(f"WITH {_SWAPPED} SELECT c_custkey, after AS text FROM x")
def name_swaps(t):
    """Names swapped in texts, with pronouns."""
    return _swapped(t).select("c_custkey", F.col("after").alias("text"))


@query("""SELECT c_custkey, 'met' AS word, 1 AS n_a, 0 AS n_b, false AS leak FROM customer WHERE c_custkey%7=0 UNION ALL SELECT c_custkey, 'knew', 0, 1, false FROM customer WHERE c_custkey%7=0 UNION ALL SELECT c_custkey, 'lee', NULL, NULL, true FROM customer WHERE c_custkey%11=0""")
def name_swap_check(t):
    """Words that a swap should not have touched, and old names that it left."""
    x = _swapped(t).withColumn("after", F.when(F.col("c_custkey") % 7 == 0, F.replace("after", F.lit(" met "), F.lit(" knew "))).otherwise(F.col("after")))
    x = x.withColumn("after", F.when(F.col("c_custkey") % 11 == 0, F.concat("after", F.lit(" Mrs. Lee"))).otherwise(F.col("after")))
    changed = names.changed_words(x, ["c_custkey"], "before", "after", names.may_change(t.spark, ["Ann Lee", "Eve Roe"], True))
    of = lambda *w: t.spark.createDataFrame([(v,) for v in w], "word string")
    leaks = names.leaked_words(x, ["c_custkey"], "after", of("ann", "lee"), of("eve", "roe"))
    none = F.lit(None).cast("bigint")
    return changed.withColumn("leak", F.lit(False)).union(leaks.select("c_custkey", "word", none, none, F.lit(True)))


@query(r"""WITH h AS (SELECT page_id, array_to_string(regexp_extract_all(html,'<li><a[^>]*>([^<]+)</a>',1),'; ') AS t FROM pages), l AS (SELECT page_id, list_filter(list_transform(string_split_regex(t,'[\n;]+'), lambda p: trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(p),'^\s*(?:[IVXL]+|[A-Za-z]|\d{1,2})[.)]\s*','')),'[^\p{L}\p{N}_\s]',' ','g'),'\s+',' ','g'))), lambda x: len(x)>=3) AS h FROM h),
x AS (SELECT g.page_id, g.h AS g, p.h AS p FROM l g JOIN l p ON p.page_id+8=g.page_id WHERE len(g.h)>0), y AS (SELECT *, len(list_filter(g, lambda a: len(list_filter(p, lambda b: contains(b,a) OR contains(a,b) OR len(list_intersect(list_distinct(string_split(a,' ')),list_distinct(string_split(b,' '))))>=0.6*len(list_distinct(string_split(a,' ')))))>0)) AS f, list_distinct(flatten(list_transform(g, lambda a: string_split(a,' ')))) AS k, flatten(list_transform(p, lambda a: string_split(a,' '))) AS s FROM x),
z AS (SELECT *, f*1.0/len(g) AS r, least(1.0, len(list_filter(s, lambda w: NOT list_contains(k,w)))*1.0/len(k)) AS m FROM y) SELECT page_id, CAST(floor(r*1e6+0.5) AS BIGINT) AS recall, CAST(greatest(0,len(p)-f) AS INTEGER) AS extras, CAST(floor(greatest(0.0,r-0.5*m)*1e6+0.5) AS BIGINT) AS score, CAST(len(g) AS INTEGER) AS n_gold, CAST(len(p) AS INTEGER) AS n_pred FROM z""")
def heading_scores(t):
    """headings of each page against those of the page eight before."""
    h = t.pages.select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"<li><a[^>]*>([^<]+)</a>"), 1), "; ").alias("gold"))
    x = h.join(h.select((F.col("page_id") + 8).alias("page_id"), F.col("gold").alias("pred")), "page_id")
    return _m(headings.heading_scores(x, ["page_id"], "pred", "gold"), "recall", "score")


@query(f"""WITH x AS (SELECT l_suppkey%12 AS model, l_orderkey AS c, abs(l_quantity-25) AS d FROM lineitem), c AS (SELECT model, c, sum(d) AS s, count(d) AS n FROM x GROUP BY ALL), e AS (SELECT model, s, n, {_ab('c', '2')} FROM c),
w AS (SELECT model, r, {_WEIGHT} AS w, s, n FROM e, (SELECT unnest(range(0,2000)) AS r)), m AS (SELECT model, r, sum(w*s)/sum(w*n) AS m FROM w GROUP BY ALL HAVING sum(w*n)>0), b AS (SELECT r, arg_min(model, (m, model)) AS model FROM m GROUP BY r), v AS (SELECT model, count(*) AS won FROM b GROUP BY 1),
l AS (SELECT model, list_sort(list(m)) AS m, stddev_samp(m) AS sd FROM m GROUP BY 1), g AS (SELECT model, avg(d) AS mean FROM x GROUP BY 1)
SELECT l.model, {_mil('mean')} AS mean, {_mil('m[1+CAST(floor(0.025*len(m)) AS INTEGER)]')} AS lo, {_mil('m[1+CAST(floor(0.975*len(m)) AS INTEGER)]')} AS hi, {_mil('sd')} AS sd, {_mil('coalesce(won,0)/2000.0')} AS wins FROM l JOIN g USING (model) LEFT JOIN v USING (model)""")
def gold_ranking(t):
    """Each model's mean distance, its interval over orders drawn anew 2,000 times, and how often it is the best."""
    x = t.lineitem.select((F.col("l_suppkey") % 12).alias("model"), F.col("l_orderkey").alias("c"), F.abs(F.col("l_quantity") - 25).alias("d"))
    return _m(stats.ranking(x, "model", "c", "d", 2_000, 2), "mean", "lo", "hi", "sd", "wins")
