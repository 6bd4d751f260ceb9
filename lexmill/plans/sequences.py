"""Queries on ordered data; an embedding's components stand in for token log-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.numbers import millionths
from lexmill.operators import sequence as op
from lexmill.plans.registry import query


def _m(df, *cols):
    return df.withColumns({c: millionths(c) for c in cols})


def _profile(t):
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("""WITH d AS (SELECT doc_id, CAST(n_chars AS BIGINT) AS n FROM documents), k AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n<=2048 THEN 0 ELSE CAST(ceil((n-2048)/1792.0) AS BIGINT) END + 1)) AS k FROM d WHERE n>0)
SELECT doc_id, k, k*1792 AS start, least(k*1792+2048, n) AS "end", k*1792+CASE WHEN k=0 THEN 0 ELSE 128 END AS score_from FROM k""")
def chunk_spans(t):
    """Overlapping chunks of documents by characters."""
    out = op.chunk_spans(t.documents.select("doc_id", F.col("n_chars").alias("n")), "n", 2048, 256, 128)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("k", "start", "end", "score_from")])


@query("""SELECT l_orderkey, l_linenumber, arg_min(l_partkey, l_suppkey*100000+l_partkey) AS l_partkey FROM lineitem GROUP BY ALL""")
def first_writer_wins(t):
    """Of several rows at a position, the first writer's."""
    x = t.lineitem.withColumn("w", F.col("l_suppkey") * 100000 + F.col("l_partkey"))
    return op.first_writer(x, ["l_orderkey", "l_linenumber"], "l_partkey", "w")


@query("""WITH w AS (SELECT vec_id, s AS start, list_transform(list_slice(embedding, s+1, s+16), lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings, (SELECT unnest([0,8,16,24,32,40,48]) AS s))
SELECT vec_id, start, len(w) AS n, CAST(floor(list_sum(w)/16*1e6+0.5) AS BIGINT) AS mean, CAST(floor(list_min(w)*1e6+0.5) AS BIGINT) AS min, CAST(floor(len(list_filter(w, lambda x: x< -0.1))/16.0*1e6+0.5) AS BIGINT) AS frac_low FROM w""")
def sliding_window_stats(t):
    """Windows of 16 components, 8 apart."""
    out = op.sliding_windows(_profile(t), "vec_id", "v", 16, 8, -0.1)
    return _m(out, "mean", "min", "frac_low").withColumn("n", F.col("n").cast("long")).withColumn("start", F.col("start").cast("int"))


@query("""WITH w AS (SELECT vec_id, t AS trunc, list_transform(CASE WHEN t>0 THEN list_slice(embedding,1,t) ELSE embedding END, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings, (SELECT unnest([10,25,50,0]) AS t))
SELECT vec_id, trunc, len(w) AS n, CAST(floor(list_sum(w)*1e6+0.5) AS BIGINT) AS total, CAST(floor(list_sum(w)/len(w)*1e6+0.5) AS BIGINT) AS mean, CAST(floor(exp(list_sum(w)/len(w))*1e6+0.5) AS BIGINT) AS p, CAST(floor(list_min(w)*1e6+0.5) AS BIGINT) AS min, len(list_filter(w, lambda x: x< -0.2)) AS n_low, CAST(list_position(w, list_min(w))-1 AS BIGINT) AS first_break FROM w""")
def truncation_stats(t):
    """Statistics of the first 10, 25, 50 and all components."""
    out = op.truncations(_profile(t), "vec_id", "v", [10, 25, 50], -0.2)
    return _m(out, "total", "mean", "p", "min").withColumns({c: F.col(c).cast("long") for c in ("n", "n_low", "first_break")})


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding,1) AS i FROM embeddings), y AS (SELECT vec_id, i, exp(sum(-abs(CAST(v AS DOUBLE))) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS p FROM x)
SELECT vec_id, max(CASE WHEN p>=0.1 AND p<=0.6 AND i>=2 THEN i END) AS n FROM y GROUP BY vec_id""")
def running_prefix_cutoff(t):
    """The longest prefix with a running probability from 0.1 to 0.6."""
    x = _profile(t).select("vec_id", F.posexplode("v").alias("i", "v")).withColumn("l", -F.abs("v"))
    return op.running_cutoff(x, "vec_id", "i", "l", 0.1, 0.6).withColumn("n", F.col("n").cast("long"))


@query("""WITH r AS (SELECT conv_id AS k, turn+1 AS n, min(turn) AS p FROM conversations GROUP BY ALL), w AS (SELECT k, n, CASE WHEN n=row_number() OVER (PARTITION BY k ORDER BY n) THEN 1 ELSE 0 END AS ok FROM r), a AS (SELECT k, min(ok) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) AS a FROM w) SELECT k, CAST(sum(a) AS BIGINT) AS run FROM a GROUP BY k""")
def sequential_run_validation(t):
    """How far turns go without a gap."""
    x = t.conversations.select(F.col("conv_id").alias("k"), (F.col("turn") + 1).alias("n"), F.col("turn").alias("p"))
    return op.unbroken_run(x, "k", "n", "p")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)),1)-1 AS p FROM documents), h AS (SELECT doc_id, p, t, (len(trim(t))<=40 AND regexp_matches(trim(t),'^\\p{Lu}')) AS h FROM l), s AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS n FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS section_no, coalesce(max(CASE WHEN h THEN trim(t) END),'preamble') AS heading, md5(coalesce(string_agg(t, chr(10) ORDER BY p) FILTER (WHERE NOT h),'')) AS body, count(*) FILTER (WHERE NOT h) AS n_lines FROM s GROUP BY doc_id, n""")
def section_split(t):
    """Short capitalised lines as headings of what follows."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    head = (F.length(F.trim("t")) <= 40) & F.trim("t").rlike(r"^\p{Lu}")
    out = op.sections(lines, "doc_id", "p", "t", head)
    return out.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "heading", F.md5(F.col("body").cast("binary")).alias("body"), F.col("n_lines").cast("long").alias("n_lines"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)),1)-1 AS p FROM documents), n AS (SELECT doc_id, count(DISTINCT p//5) AS n FROM l GROUP BY doc_id),
r AS (SELECT doc_id, trim(t) AS line, count(DISTINCT p//5) AS pages FROM l WHERE trim(t)<>'' AND len(trim(t))<90 GROUP BY ALL) SELECT doc_id, line, pages FROM r JOIN n USING (doc_id) WHERE pages>=greatest(2, floor(0.4*n))""")
def repeated_lines(t):
    """Lines that come back on many pages of five lines."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).withColumn("page", F.floor(F.col("p") / 5))
    return op.repeated_lines(lines, "doc_id", "page", "t")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), a AS (SELECT doc_id, w, len(w)//2 AS a FROM w), f AS (SELECT doc_id, w, a, unnest([6,12,24,48]) AS n FROM a)
SELECT doc_id, n, array_to_string(list_slice(w, a-n+1, a),' ') AS prompt, array_to_string(list_slice(w, a+1, a+20),' ') AS answer FROM f WHERE a>=n AND len(w)>=a+20""")
def nested_prefix_family(t):
    """Prompts of 6, 12, 24 and 48 words before the middle, the same 20 words after it."""
    d = t.documents.select("doc_id", F.explode(F.array(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))).alias("w")).withColumn("a", F.floor(F.size("w") / 2).cast("int"))
    return d.select("doc_id", F.explode(op.nested_prefixes(F.col("w"), F.col("a"), [6, 12, 24, 48], 20)).alias("x")).select("doc_id", "x.n", "x.prompt", "x.answer")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)),1)-1 AS p FROM documents), k AS (SELECT doc_id, p, t, row_number() OVER (PARTITION BY doc_id ORDER BY p<3, abs(p-3)) AS r FROM l WHERE len(t)>=60) SELECT doc_id, CAST(p AS INTEGER) AS p, t FROM k WHERE r=1""")
def closest_usable_line(t):
    """The first long line from the fourth on, else the last one before."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    return op.nearest_usable(lines, "doc_id", "p", 3, F.length("t") >= 60, "t")
