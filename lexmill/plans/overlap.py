"""Queries on verbatim overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import overlap as fn
from lexmill.functions.numbers import millionths
from lexmill.functions.rules import containment_verdict
from lexmill.functions.text import WORD, normalize
from lexmill.operators import shingle
from lexmill.operators.relational import By, place_in_group
from lexmill.plans.registry import query


def _words(text="text"):
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def _next(t, order):
    """(doc_id, next): each document and the one behind it in its language."""
    d = place_in_group(t.documents.select("doc_id", "lang"), "lang", [*map(By, order), "doc_id"], "k")
    return d.join(d.select("lang", (F.col("k") - 1).alias("k"), F.col("doc_id").alias("next")), ["lang", "k"]).select("doc_id", "lang", "next")


def _pairs(t):
    """Each document's words 11 to 30 (the span that the floor is measured on) with those of the next document in md5 order in its language."""
    d = t.documents.select("doc_id", "lang", F.slice(_words(), 11, 20).alias("g")).where(F.size("g") > 0)
    k = place_in_group(d, "lang", [By(F.md5(F.col("doc_id").cast("string").cast("binary"))), "doc_id"], "k")
    return k.join(k.select("lang", (F.col("k") - 1).alias("k"), F.col("g").alias("p")), ["lang", "k"]).drop("k")


_PAIRS = """d AS (SELECT doc_id, lang, list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+'),11,30) AS g FROM documents),
p AS (SELECT doc_id, lang, g, lead(g) OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS p FROM d WHERE len(g)>0),
q AS (SELECT * FROM p WHERE p IS NOT NULL),
a AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p,1) AS i FROM q), b AS (SELECT doc_id, unnest(g) AS t, generate_subscripts(g,1) AS j FROM q),
h AS (SELECT doc_id, i, i-j AS d FROM a JOIN b USING (doc_id, t)), k AS (SELECT doc_id, d, i-row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS s FROM h),
r AS (SELECT doc_id, max(n) AS longest_run FROM (SELECT doc_id, d, s, count(*) AS n FROM k GROUP BY ALL) GROUP BY doc_id)"""


@query(f"""WITH {_PAIRS} SELECT coalesce(lang,'ALL') AS lang, count(*) AS n, CAST(floor(avg(coalesce(longest_run,0))*1e6+0.5) AS BIGINT) AS mean_run, max(coalesce(longest_run,0)) AS max_run FROM q LEFT JOIN r USING (doc_id) GROUP BY GROUPING SETS ((lang),())""")
def overlap_null_floor(t):
    """The longest common run of unrelated passages, by language and pooled."""
    pairs = _pairs(t)
    runs = pairs.select("doc_id", "lang").join(fn.longest_runs(pairs, "doc_id", "p", "g"), "doc_id")
    out = runs.groupingSets([[F.col("lang")], []], F.col("lang")).agg(F.count("*").alias("n"), F.avg("longest_run").alias("mean_run"), F.max("longest_run").alias("max_run"))
    return out.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "n", millionths("mean_run").alias("mean_run"), "max_run")


@query(f"""WITH {_PAIRS}, c AS (SELECT doc_id, t, count(*) AS n FROM a GROUP BY ALL), e AS (SELECT doc_id, t, count(*) AS n FROM b GROUP BY ALL), o AS (SELECT doc_id, sum(least(c.n, e.n)) AS o FROM c JOIN e USING (doc_id, t) GROUP BY doc_id),
x AS (SELECT doc_id, list_transform(range(1, greatest(len(p),len(g))+1), lambda i: p[i] IS NOT DISTINCT FROM g[i]) AS s, p, g FROM q)
SELECT doc_id, CAST(CASE WHEN list_position(s, false)>0 THEN list_position(s,false)-1 ELSE least(len(p),len(g)) END AS BIGINT) AS prefix, CAST(floor(coalesce(2.0*coalesce(o,0)/(len(p)+len(g)),0)*1e6+0.5) AS BIGINT) AS f1, coalesce(longest_run,0) AS longest_run
FROM x LEFT JOIN o USING (doc_id) LEFT JOIN r USING (doc_id)""")
def overlap_scores_native(t):
    """Prefix, longest run and F1 of the same pairs."""
    pairs = _pairs(t)
    out = pairs.join(fn.longest_runs(pairs, "doc_id", "p", "g"), "doc_id")
    p, g = F.col("p"), F.col("g")
    return out.select("doc_id", fn.prefix_tokens(p, g).alias("prefix"), millionths(fn.token_f1(p, g)).alias("f1"), "longest_run")


@query()
def overlap_scores_full(t):
    """All scores of each document's whole text against the next one's of its language."""
    after = _next(t, []).select(F.col("doc_id").alias("id"), "next")
    texts = t.documents.where("text is not null").select("doc_id", normalize(F.col("text"), compat=True).alias("n"))
    a, b = texts.alias("a"), texts.alias("b")  # alike, so that texts are normalised and dealt by doc_id once for both
    pairs = after.join(a, F.col("id") == F.col("a.doc_id")).select("id", "next", F.col("a.n").alias("gold")).join(b, F.col("next") == F.col("b.doc_id"))
    return fn.normalized_scores(pairs.select(F.col("id").alias("doc_id"), F.col("b.n").alias("pred"), "gold"), "doc_id", "pred", "gold")


_SH = """list_distinct(list_transform(range(1, greatest(len(w)-6,1)), lambda i: array_to_string(list_slice(w,i,i+7),' ')))"""
_WORDS = """list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text),'[^\\p{L}\\p{N}_\\s§]',' ','g'),'\\s+',' ','g')),' '), lambda x: x<>'')"""


@query(f"""WITH b AS (SELECT item_id, unnest({_SH}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)), d AS (SELECT doc_id, unnest({_SH}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id), h AS (SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (s) GROUP BY ALL)
SELECT item_id, doc_id, shared, CAST(floor(shared*1.0/n*1e6+0.5) AS BIGINT) AS share, CASE WHEN shared*1.0/n>=0.5 THEN 'match' WHEN shared*1.0/n>=0.2 THEN 'partial' ELSE 'none' END AS verdict FROM h JOIN n USING (item_id)""")
def shingle_containment(t):
    """Benchmark items against documents by shared shingles of eight words."""
    out = shingle.containment(t.benchmark, t.documents, "item_id", "text", "doc_id", "text")
    return out.select("item_id", "doc_id", "shared", millionths("share").alias("share"), containment_verdict(F.col("share")).alias("verdict"))


@query(f"""WITH w AS (SELECT doc_id, CASE WHEN doc_id%2=0 THEN 'pre' ELSE 'post' END AS arm, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, arm, len(w) AS n, p-1 AS p, array_to_string(w[p:p+7],' ') AS s FROM w, unnest(range(1, greatest(len(w)-6,1))) AS t(p)),
f AS (SELECT doc_id, s, min(p) AS p FROM s GROUP BY ALL), c AS (SELECT s, min(doc_id) FILTER (WHERE arm='post') AS ol, max(doc_id) FILTER (WHERE arm='post') AS oh, min(doc_id) FILTER (WHERE arm='pre') AS rl, max(doc_id) FILTER (WHERE arm='pre') AS rh FROM s GROUP BY s),
x AS (SELECT DISTINCT doc_id, p-p%60 AS start, s FROM s WHERE p%60<=22 AND p-p%60+30<=n)
SELECT doc_id, CAST(start AS INTEGER) AS start, count(*) AS shingles, CAST(floor(avg(CASE WHEN ol<>doc_id OR oh<>doc_id THEN 1.0 ELSE 0.0 END)*1e6+0.5) AS BIGINT) AS in_post, CAST(floor(avg(CASE WHEN rl<>doc_id OR rh<>doc_id THEN 1.0 ELSE 0.0 END)*1e6+0.5) AS BIGINT) AS in_other_pre, CAST(floor(avg(CASE WHEN p+8<=start THEN 1.0 ELSE 0.0 END)*1e6+0.5) AS BIGINT) AS in_own
FROM x JOIN c USING (s) JOIN f USING (doc_id, s) GROUP BY ALL""")
def recurrence_fractions(t):
    """How much of spans of thirty words, one every sixty, recurs in other documents of either arm, and earlier in their own."""
    d = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "pre").otherwise("post").alias("arm"))
    out = shingle.recurrence_at(d, "doc_id", "text", "arm", 30, 60)
    return out.withColumns({c: millionths(c) for c in ("in_post", "in_other_pre", "in_own")})
