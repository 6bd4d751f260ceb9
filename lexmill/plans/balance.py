"""Queries on balance and diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.numbers import millionths
from lexmill.operators import balance as op
from lexmill.plans.registry import query

_LANGS = ["de", "en", "es", "fr"]


def _labelled(t):
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")


@query("""SELECT source, count(*) FILTER (WHERE lang='de') AS n_de, count(*) FILTER (WHERE lang='en') AS n_en,
count(*) FILTER (WHERE lang='es') AS n_es, count(*) FILTER (WHERE lang='fr') AS n_fr FROM documents GROUP BY source""")
def crosstab_source_lang(t):
    """Documents by source and language."""
    return op.crosstab(t.documents, "source", "lang", _LANGS)


@query("""WITH c AS (SELECT source, count(*) FILTER (WHERE lang='de') AS a, count(*) FILTER (WHERE lang='en') AS b,
count(*) FILTER (WHERE lang='es') AS c, count(*) FILTER (WHERE lang='fr') AS d FROM documents GROUP BY source)
SELECT source, CAST(floor(a*1.0/(a+b+c+d)*1e6+0.5) AS BIGINT) AS n_de, CAST(floor(b*1.0/(a+b+c+d)*1e6+0.5) AS BIGINT) AS n_en,
CAST(floor(c*1.0/(a+b+c+d)*1e6+0.5) AS BIGINT) AS n_es, CAST(floor(d*1.0/(a+b+c+d)*1e6+0.5) AS BIGINT) AS n_fr FROM c""")
def crosstab_row_normalised(t):
    """The same as shares of a source."""
    cols = [f"n_{v}" for v in _LANGS]
    out = op.normalised(op.crosstab(t.documents, "source", "lang", _LANGS), cols)
    return out.withColumns({c: millionths(c) for c in cols})


@query("""SELECT quality, count(*) AS n, CAST(floor(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE)*1e6+0.5) AS BIGINT) AS share
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality""")
def label_distribution_with_nulls(t):
    """Quality labels, unlabelled documents among them."""
    return op.label_distribution(_labelled(t), "quality").withColumn("share", millionths("share"))


@query("""SELECT lang, count(quality) AS labelled, count(*)-count(quality) AS unlabelled, count(*) AS total,
CAST(floor(count(quality)/CAST(count(*) AS DOUBLE)*1e6+0.5) AS BIGINT) AS fraction FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def completeness_by_type(t):
    """How many documents of a language are labelled."""
    return op.completeness(_labelled(t), "lang", "quality").withColumn("fraction", millionths("fraction"))


@query("""SELECT k, count(*) AS n FROM (SELECT doc_id // 8 AS k, toxic FROM documents LEFT JOIN labels USING (doc_id))
GROUP BY k HAVING sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) = 0""")
def zero_count_groups(t):
    """Runs of eight ids without a toxic document."""
    return op.zero_groups(_labelled(t).withColumn("k", F.floor(F.col("doc_id") / 8).cast("long")), "k", F.col("toxic") == 1)


@query("""WITH w AS (SELECT p_brand, unnest(string_split(p_name,' ')) AS w FROM part)
SELECT p_brand, count(w) AS tokens, count(DISTINCT w) AS types, CAST(floor(count(DISTINCT w)/CAST(count(w) AS DOUBLE)*1e6+0.5) AS BIGINT) AS ttr FROM w GROUP BY p_brand""")
def type_token_ratio(t):
    """Type-token ratio of part names by brand."""
    words = t.part.select("p_brand", F.explode(F.split("p_name", " ")).alias("w"))
    return op.type_token(words, ["p_brand"], "w").withColumn("ttr", millionths("ttr"))


@query("""SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 20""")
def top_words(t):
    """The 20 commonest words."""
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_']+)"), 1)).alias("w"))
    return op.top_k(words, "w", 20)


@query("""WITH p AS (SELECT string_split(p_name,' ')[1] AS a, string_split(p_name,' ')[2] AS b FROM part),
top AS (SELECT b FROM p GROUP BY b ORDER BY count(*) DESC, b LIMIT 3)
SELECT a, b, count(*) AS n FROM p WHERE b IN (SELECT b FROM top) GROUP BY a, b""")
def cooccurrence_top(t):
    """First words of part names against the three commonest second words, in long form."""
    p = t.part.select(F.element_at(F.split("p_name", " "), 1).alias("a"), F.element_at(F.split("p_name", " "), 2).alias("b"))
    return p.join(F.broadcast(op.top_k(p, "b", 3).select("b")), "b", "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("""SELECT p_type, count(*) FILTER (WHERE p_size<=10) AS n_s, count(*) FILTER (WHERE p_size>10 AND p_size<=30) AS n_m, count(*) FILTER (WHERE p_size>30) AS n_l, count(*) AS total FROM part GROUP BY p_type""")
def cooccurrence_pivot(t):
    """Part types by size class, with totals."""
    size = F.when(F.col("p_size") <= 10, "s").when(F.col("p_size") <= 30, "m").otherwise("l")
    return op.cooccurrence(t.part.withColumn("size", size), "p_type", "size", ["s", "m", "l"])


@query("""WITH c AS (SELECT p_brand, p_name, count(*) AS c FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_name) AS k FROM c)
SELECT p_brand, CAST(sum(c) AS BIGINT) AS n, count(*) AS names, max(CASE WHEN k=1 THEN p_name END) AS top_name,
CAST(floor(max(CASE WHEN k=1 THEN c END)/CAST(sum(c) AS DOUBLE)*1e6+0.5) AS BIGINT) AS top_share FROM r GROUP BY p_brand""")
def concentration_report(t):
    """How much of a brand its commonest name holds."""
    return op.concentration(t.part, "p_brand", "p_name").withColumn("top_share", millionths("top_share"))


@query("""SELECT CASE WHEN trim(text)='' OR text IS NULL THEN 'missing' WHEN regexp_matches(lower(trim(text)),'^yes\\b') THEN 'yes' WHEN regexp_matches(lower(trim(text)),'^no\\b') THEN 'no' ELSE 'other' END AS label,
role, count(*) AS n FROM conversations GROUP BY ALL""")
def yes_no_labels(t):
    """K7: the first word of each turn as yes, no or other."""
    return t.conversations.select(op.yes_no(F.col("text")).alias("label"), "role").groupBy("label", "role").agg(F.count("*").alias("n"))
