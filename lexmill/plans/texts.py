"""Queries on text hygiene, extraction and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import rules
from lexmill.functions import text as tx
from lexmill.functions.numbers import millionths
from lexmill.operators import resample, stats
from lexmill.plans.panel import _J
from lexmill.plans.registry import query

# literals that stand for model answers; conversations are added to them
_ANSWERS = [
    "UNKNOWN", "", "  ", "I cannot provide copyrighted text", "I do not have sufficient recall", "The Act cannot be superseded", "Some words\nunknown\n",
    "I cannot provide the text you ask for", "Sorry, I am not certain of the wording", "I can't reproduce it; it is not in the public domain", "*unknown.*",
]
_VALUES = ", ".join("('" + a.replace("'", "''").replace("\n", "'||chr(10)||'") + "')" for a in _ANSWERS)


def _re(p: str) -> str:
    return p.replace("'", "''")


@query(f"""WITH a AS (SELECT text FROM conversations WHERE role='assistant' UNION ALL SELECT * FROM (VALUES {_VALUES}) v(text)), t AS (SELECT trim(regexp_replace(coalesce(text,''),'^\\s+|\\s+$','','g')) AS t FROM a), h AS (SELECT t, substr(t,1,400) AS h FROM t),
c AS (SELECT CASE WHEN t='' THEN 'empty' WHEN upper(regexp_replace(t,'^[ ."''*]+|[ ."''*]+$','','g'))='UNKNOWN' THEN 'unknown_bare'
WHEN regexp_matches(h,'(?i){_re(rules.FIRST_PERSON)}') AND regexp_matches(h,'(?i){_re(rules.POLICY_EXPLICIT)}') THEN 'refusal_policy' WHEN regexp_matches(h,'(?i){_re(rules.FIRST_PERSON)}') AND regexp_matches(h,'(?i){_re(rules.EPISTEMIC)}') THEN 'unknown_explained'
WHEN regexp_matches(h,'(?i){_re(rules.FIRST_PERSON)}') AND regexp_matches(h,'(?i){_re(rules.POLICY_GENERIC)}') THEN 'refusal_policy' WHEN regexp_matches(t,'(?i){rules.UNKNOWN_LINE}') THEN 'unknown_other' ELSE 'attempt' END AS category FROM h)
SELECT category, count(*) AS n, CAST(floor(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE)*1e6+0.5) AS BIGINT) AS share FROM c GROUP BY category""")
def nonanswer_taxonomy(t):
    """Kinds of answers with their shares."""
    from lexmill.operators.balance import label_distribution

    a = t.conversations.where("role = 'assistant'").select("text").union(t.spark.createDataFrame([(x,) for x in _ANSWERS], "text string"))
    return label_distribution(a.select(rules.nonanswer(F.col("text")).alias("category")), "category").withColumn("share", millionths("share"))


def _cases(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text},'(?i){_re(p)}') THEN '{k}'" for k, p in rules.FURNITURE) + " END"


@query(f"""WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(len(text),1), 400)) AS lo FROM documents), s AS (SELECT 'item' AS kind, item_id AS id, 0 AS lo, text AS span, text AS near, item_id%7/10.0 AS self, item_id%5/10.0 AS post, CASE WHEN item_id%3=0 THEN 'post' ELSE 'pre' END AS arm FROM benchmark
UNION ALL SELECT 'document', doc_id, lo, substr(text,lo+1,400), substr(text,greatest(lo-400,0)+1,least(lo,400)+800), 0.0, 0.0, 'pre' FROM d)
SELECT kind, id, CAST(lo AS INT) AS lo, CASE WHEN self>=0.25 THEN 'in_document_repetition' WHEN post>=0.25 THEN 'recurring_furniture' WHEN arm LIKE '%post%' THEN 'post_cutoff_predictable' WHEN ({_cases("span")}) IS NOT NULL THEN 'furniture_by_pattern' WHEN ({_cases("near")}) IS NOT NULL THEN 'quoted_in_context' ELSE 'MEMORISATION_CANDIDATE' END AS verdict, coalesce(({_cases("span")}),'-') AS category, coalesce(({_cases("near")}),'-') AS category_near FROM s""")
def hotspot_verdicts(t):
    """K3: what makes a span unremarkable: items, and spans of 400 characters over every document with 400 on either side."""
    b = t.benchmark.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.lit(0).alias("lo"), F.col("text").alias("span"), F.col("text").alias("near"), (F.col("item_id") % 7 / 10).alias("self"), (F.col("item_id") % 5 / 10).alias("post"), F.when(F.col("item_id") % 3 == 0, "post").otherwise("pre").alias("arm"))
    d = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(400))).alias("lo"))
    near = F.substring("text", F.greatest(F.col("lo") - 400, F.lit(0)) + 1, F.least("lo", F.lit(400)) + 800)
    s = b.union(d.select(F.lit("document"), "doc_id", "lo", F.substring("text", F.col("lo") + 1, F.lit(400)), near, F.lit(0.0), F.lit(0.0), F.lit("pre")))
    category, category_near = rules.first_match(F.col("span"), rules.FURNITURE), rules.first_match(F.col("near"), rules.FURNITURE)
    verdict = rules.hotspot_verdict(F.col("self"), F.col("post"), F.col("arm"), category, category_near)
    return s.select("kind", "id", "lo", verdict.alias("verdict"), F.coalesce(category, F.lit("-")).alias("category"), F.coalesce(category_near, F.lit("-")).alias("category_near"))


@query("""SELECT source, sum(len(regexp_extract_all(text,'\\n[a-zà-öø-ÿ]'))) ::BIGINT AS wrapped, sum(len(regexp_extract_all(text,'\\n[^\\n]')))::BIGINT AS breaks, CAST(floor(avg(len(text))*1e6+0.5) AS BIGINT) AS mean_chars, sum(len(regexp_extract_all(text,'[A-Za-z]-\\n[a-z]')))::BIGINT AS hyphens FROM documents GROUP BY source""")
def hard_wrap_stats(t):
    """Line breaks inside sentences, by source."""
    wrapped, breaks = tx.hard_wraps(F.col("text"))
    return t.documents.groupBy("source").agg(F.sum(wrapped).alias("wrapped"), F.sum(breaks).alias("breaks"), millionths(F.avg(F.length("text"))).alias("mean_chars"), F.sum(F.regexp_count("text", F.lit(r"[A-Za-z]-\n[a-z]"))).alias("hyphens"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text,'([A-Za-z])-\\n([a-z])','\\1\\2','g'),'[ \\t]+',' ','g'),'\\n{3,}',chr(10)||chr(10),'g'))) AS tidy FROM documents""")
def tidy_text(t):
    """hyphenation undone, blanks and blank lines collapsed."""
    return t.documents.select("doc_id", F.md5(tx.tidy(tx.dehyphenate(F.col("text"))).cast("binary")).alias("tidy"))


@query("""WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(text,'([.!?”])\\s+([A-ZÀ-ÖØ-Þ“])','\\1'||chr(1)||'\\2','g'),chr(1)), lambda x: trim(regexp_replace(x,'\\s+',' ','g'))) AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS s FROM s) SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE len(string_split(s,' ')) BETWEEN 22 AND 70 AND regexp_matches(s,'^\\p{Lu}') AND NOT regexp_matches(s,'\\d') AND NOT regexp_matches(s,'\\b(Id\\.|supra|infra|Cir\\.|U\\.S\\.C\\.)|[§¶]') AND len(s)-len(replace(s,'(',''))=len(s)-len(replace(s,')','')) AND len(s)-len(replace(s,'“',''))=len(s)-len(replace(s,'”',''))) AS usable FROM u GROUP BY doc_id""")
def clean_sentences(t):
    """Sentences of each document, and how many can be used as they are."""
    s = t.documents.select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(tx.usable_sentence(F.col("s"))).alias("usable"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html,'<[^>]+>',' ','g'),'\\s+',' ','g'))) AS plain, regexp_extract(url,'^https?://([^/?#]+)',1) AS host, regexp_extract(url,'^https?://[^/?#]+([^?#]*)',1) AS path,
CASE WHEN ltrim(lower(substr(html,1,200)))='' THEN 'empty' WHEN starts_with(ltrim(lower(substr(html,1,200))),'%pdf') THEN 'pdf' WHEN regexp_matches(ltrim(lower(substr(html,1,200))),'^<(!doctype html|html)') THEN 'html' WHEN starts_with(ltrim(lower(substr(html,1,200))),'pk') THEN 'zip' ELSE 'other' END AS kind,
regexp_matches(lower(html),'<title>[^<]*(not found|404|access denied)') AS missing FROM pages""")
def html_strip_and_sniff(t):
    """Pages without tags, parts of the address, kind and soft 404."""
    return t.pages.select(
        "page_id", F.md5(tx.strip_tags(F.col("html")).cast("binary")).alias("plain"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"), tx.file_kind(F.col("html")).alias("kind"), tx.soft_404(F.col("html")).alias("missing"),
    )


@query("""SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events""")
def json_tolerant_extract(t):
    """a value from JSON in the midst of other text."""
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    return t.events.select("event_id", F.get_json_object(tx.first_json(wrapped), "$.k").cast("long").alias("k"))


@query("""SELECT conv_id, md5(string_agg(upper(role)||': '||text, chr(10) ORDER BY turn)) AS rendered FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def conversation_render(t):
    """Conversations as text."""
    turns = t.conversations.where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.md5(tx.render(F.col("t")).cast("binary")).alias("rendered"))


@query("""SELECT s_suppkey, substr(regexp_replace(regexp_replace(lower(s_name),'[^a-z0-9]+','_','g'),'^_+|_+$','','g'),1,60) AS slug FROM supplier""")
def slugify(t):
    """names as slugs."""
    return t.supplier.select("s_suppkey", tx.slug(F.col("s_name")).alias("slug"))


@query("""SELECT o_orderkey, CASE WHEN d=0 THEN 'same' WHEN d<=7 THEN 'close' ELSE 'off_by_'||d||'d' END AS agreement FROM (SELECT o_orderkey, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l AS DATE))) AS d FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS l FROM lineitem GROUP BY 1) ON o_orderkey=l_orderkey)""")
def date_agreement(t):
    """order dates against first ship dates."""
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("l"))
    j = t.orders.select("o_orderkey", "o_orderdate").join(first, "o_orderkey")
    return j.select("o_orderkey", tx.date_agreement(F.col("o_orderdate").cast("date"), F.col("l").cast("date")).alias("agreement"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text,'\\S+') AS w FROM documents) SELECT doc_id, CASE WHEN len(w)>=19 THEN array_to_string(list_slice(w,1,12),' ') END AS prompt, CASE WHEN len(w)>=19 THEN md5(array_to_string(list_slice(w,13,len(w)),' ')) END AS answer FROM w""")
def prompt_split(t):
    """the first twelve words and the rest."""
    d = t.documents.select("doc_id", F.explode(F.array(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))).alias("w"))
    x = d.select("doc_id", tx.split_prompt(F.col("w"), 12).alias("x"))
    return x.select("doc_id", "x.prompt", F.md5(F.col("x.answer").cast("binary")).alias("answer"))


@query("""SELECT doc_id, CASE WHEN trim(text)='' THEN 'empty' WHEN len(trim(text))<300 THEN 'short' WHEN regexp_matches(substr(trim(text),1,200),'(?i)\\b(see (above|below|attached)|as (stated|noted) above)\\b') THEN 'pointer' END AS problem FROM documents""")
def answer_validity(t):
    """Answers that can't be used."""
    return t.documents.select("doc_id", tx.answer_problem(F.col("text")).alias("problem"))


@query()
def unwrapped_lines(t):
    """Documents with lines joined that the margin broke, and how many breaks went."""
    out = t.documents.select("doc_id", "text", tx.unwrap_lines()(F.col("text")).alias("clean"))
    n = lambda c: F.regexp_count(c, F.lit("\n"))
    return out.select("doc_id", n("text").alias("before"), n("clean").alias("after"), F.md5(F.col("clean").cast("binary")).alias("clean"))


def _ab(case: str, seed: str) -> str:
    """The two numbers of a case, a and b."""
    d = f"md5({case}||'|{seed}')"
    return f"CAST('0x'||substr({d},1,8) AS BIGINT) AS a, CAST('0x'||substr({d},9,8) AS BIGINT) | 1 AS b"


#: A case's draw in replicate r, and its Poisson weight.
_DRAW = "((a+r*b)%4294967296)"
_WEIGHT = "(" + "+".join(f"CAST({_DRAW}>={x} AS INTEGER)" for x in resample.poisson_steps()) + ")"


def _mil(x: str) -> str:
    return f"CAST(floor(({x})*1e6+0.5) AS BIGINT)"


@query(f"""WITH {_J}, fm AS (SELECT range AS m, range%3 AS fam, row_number() OVER (ORDER BY range) AS k FROM range(12)), zz AS (SELECT r, m, row_number() OVER (PARTITION BY r ORDER BY md5(m||'|'||r||'|0'), m) AS k FROM fm, (SELECT unnest(range(1,2001)) AS r)),
e AS (SELECT r, zz.m, fm.fam FROM zz JOIN fm USING (k) UNION ALL SELECT 0, m, fam FROM fm), g AS (SELECT x.r, avg(CASE WHEN x.fam<>y.fam THEN d END)-avg(CASE WHEN x.fam=y.fam THEN d END) AS gap FROM d JOIN e x ON x.m=d.a JOIN e y ON y.m=d.b AND y.r=x.r GROUP BY x.r), o AS (SELECT gap AS observed FROM g WHERE r=0)
SELECT {_mil('observed')} AS observed, {_mil('(count(*) FILTER (WHERE gap>=observed)+1)/(count(*)+1.0)')} AS p FROM g, o WHERE r>0 GROUP BY observed""")
def permutation_test(t):
    """Within-family divergence against families dealt anew, 2,000 times."""
    from lexmill.plans.panel import _families, _jsd

    return stats.permutation_p(_jsd(t), _families(t), "model", "family", 2000, 0).select(millionths("observed").alias("observed"), millionths("p").alias("p"))


@query(f"""WITH c AS (SELECT event_type, user_id, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL), e AS (SELECT event_type, s, n, {_ab('user_id', '0')} FROM c), w AS (SELECT event_type, s, n, r, {_WEIGHT} AS w FROM e, (SELECT unnest(range(0,20000)) AS r)),
m AS (SELECT event_type, r, sum(w*s)/sum(w*n) AS m FROM w GROUP BY ALL HAVING sum(w*n)>0), l AS (SELECT event_type, list_sort(list(m)) AS m FROM m GROUP BY 1)
SELECT event_type, {_mil('mean')} AS mean, {_mil('m[1+CAST(floor(0.025*len(m)) AS INTEGER)]')} AS lo, {_mil('m[1+CAST(floor(0.975*len(m)) AS INTEGER)]')} AS hi FROM l JOIN (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) USING (event_type)""")
def bootstrap_mean_ci(t):
    """Percentile intervals of means by type, from 20,000 replicates over users."""
    out = stats.bootstrap_ci(t.events.select("event_type", "user_id", "value"), "event_type", "user_id", "value", 20_000, 0)
    return out.withColumns({c: millionths(c) for c in ("mean", "lo", "hi")})


@query("""SELECT g, up, down FROM (SELECT l_suppkey%5 AS g, count(*) FILTER (WHERE l_quantity>25) AS up, count(*) FILTER (WHERE l_quantity<25) AS down FROM lineitem GROUP BY 1)""")
def sign_test_counts(t):
    """Counts up and down of the sign test."""
    x = t.lineitem.select((F.col("l_suppkey") % 5).alias("g"), (F.col("l_quantity") - 25).alias("d"))
    return stats.sign_test(x, ["g"], "d").select("g", "up", "down")


@query(f"""WITH x AS (SELECT l_suppkey%5 AS g, l_linenumber-4 AS d FROM lineitem), c AS (SELECT g, count(*) FILTER (WHERE d>0) AS up, count(*) FILTER (WHERE d<0) AS down FROM x GROUP BY g),
p AS (SELECT g, sum(exp(lgamma(up+down+1)-lgamma(i+1)-lgamma(up+down-i+1)-(up+down)*ln(2))) AS p FROM c, unnest(range(0,least(up,down)+1)) AS t(i) GROUP BY g) SELECT g, up, down, {_mil('least(1,2*p)')} AS sign_p FROM c JOIN p USING (g)""")
def sign_test_p(t):
    """Exact two-sided sign test of line numbers against 4."""
    x = t.lineitem.select((F.col("l_suppkey") % 5).alias("g"), (F.col("l_linenumber") - 4).alias("d"))
    return stats.sign_test(x, ["g"], "d").withColumn("sign_p", millionths("sign_p"))


@query(f"""WITH x AS (SELECT l_suppkey%5 AS g, l_quantity-25.5 AS d FROM lineitem) SELECT g, count(d) AS n, {_mil('avg(d)/(stddev_samp(d)/sqrt(count(d)))')} AS t FROM x GROUP BY g""")
def t_test(t):
    """One-sample t of quantities against 25.5."""
    x = t.lineitem.select((F.col("l_suppkey") % 5).alias("g"), (F.col("l_quantity") - 25.5).alias("d"))
    return stats.t_test(x, ["g"], "d").select("g", "n", millionths("t").alias("t"))


@query()
def t_test_p(t):
    """The same with its two-sided p."""
    x = t.lineitem.select((F.col("l_suppkey") % 5).alias("g"), (F.col("l_quantity") - 25.5).alias("d"))
    return stats.t_test(x, ["g"], "d")


@query(f"""WITH x AS (SELECT l_quantity-24 AS d FROM lineitem WHERE l_quantity<>24), k AS (SELECT abs(d) AS s, count(*) AS c, count(*) FILTER (WHERE d>0) AS up FROM x GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY s)-(c-1)/2.0 AS rank FROM k),
a AS (SELECT CAST(sum(c) AS DOUBLE) AS n, CAST(sum(rank*up) AS DOUBLE) AS w, CAST(sum(c*c*c-c) AS DOUBLE) AS t FROM r) SELECT CAST(n AS BIGINT) AS n, CAST(floor(w*10+0.5) AS BIGINT) AS w10, {_mil('(w-n*(n+1)/4)/sqrt(n*(n+1)*(2*n+1)/24-t/48)')} AS z FROM a""")
def wilcoxon_ranks(t):
    """Signed ranks of quantities against 24."""
    out = stats.wilcoxon(t.lineitem.select((F.col("l_quantity") - 24).alias("d")), "d")
    return out.select("n", F.floor(F.col("w") * 10 + 0.5).cast("long").alias("w10"), millionths("z").alias("z"))


@query()
def mds_embedding(t):
    """Two coordinates of each model from divergences."""
    from lexmill.plans.panel import _jsd

    return stats.mds(_jsd(t), squared=False)  # the root of the divergence is a metric


def _guesses(t):
    return t.orders.withColumn("guess", F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).otherwise("1-URGENT"))


@query()
def prior_matched_null(t):
    """How often guesses hit, against 10,000 trials of guesses drawn from the labels' own shares, by status."""
    return stats.matched_null(_guesses(t), "o_orderstatus", "o_orderpriority", "guess")


@query(f"""SELECT o_orderstatus, CAST(sum(c) AS BIGINT) AS n, {_mil('sum(c*c)*1.0/(sum(c)*sum(c))')} AS expected FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY ALL) GROUP BY o_orderstatus""")
def prior_matched_chance(t):
    """The same null's mean in closed form."""
    return stats.chance_of_hit(t.orders, "o_orderstatus", "o_orderpriority").withColumn("expected", millionths("expected"))


_SEL = "s0 AS (SELECT DISTINCT l_suppkey%12 AS m, l_partkey%40 AS f, l_orderkey AS c FROM lineitem)"


def _jsd_by(by: str, counts: str) -> str:
    """d1: divergences of pairs of models in each group of `by`, from counts (by, m, f, n)."""
    on = " AND ".join(f"x.{b}=y.{b}" for b in by.split(", "))
    cols = ", ".join(f"x.{b}" for b in by.split(", "))
    return f"""p1 AS (SELECT {by}, m, f, n/CAST(sum(n) OVER (PARTITION BY {by}, m) AS DOUBLE) AS p FROM {counts} WHERE n>0), m1 AS (SELECT DISTINCT {by}, m FROM p1), e1 AS (SELECT {cols}, x.m AS a, y.m AS b FROM m1 x JOIN m1 y ON {on} AND x.m<y.m),
h1 AS (SELECT {cols}, x.m AS a, y.m AS b, sum(x.p*log2(x.p/((x.p+y.p)/2))/2+y.p*log2(y.p/((x.p+y.p)/2))/2)+(1-sum(x.p))/2+(1-sum(y.p))/2 AS d FROM p1 x JOIN p1 y ON {on} AND x.f=y.f AND x.m<y.m GROUP BY ALL),
d1 AS (SELECT {', '.join(f'e1.{b}' for b in by.split(', '))}, e1.a, e1.b, coalesce(h1.d,1.0) AS d FROM e1 LEFT JOIN h1 USING ({by}, a, b))"""


def _selected(t):
    return t.lineitem.select((F.col("l_suppkey") % 12).alias("model"), F.col("l_orderkey").alias("c"), (F.col("l_partkey") % 40).alias("f"))


@query(f"""WITH {_SEL}, o0 AS (SELECT c, row_number() OVER (ORDER BY md5(c||'|0order'), CAST(c AS VARCHAR))-1 AS p FROM (SELECT DISTINCT c FROM s0)), g0 AS (SELECT c, p%2 AS odd, {_ab('(p//2)', '0')} FROM o0),
c1 AS (SELECT r, xor(CAST({_DRAW}>=2147483648 AS INTEGER), CAST(odd AS INTEGER)) AS side, m, f, count(*) AS n FROM s0 JOIN g0 USING (c), (SELECT unnest(range(0,200)) AS r) GROUP BY ALL), {_jsd_by('r, side', 'c1')},
mm AS (SELECT DISTINCT r, m FROM c1), i1 AS (SELECT r, m, row_number() OVER (PARTITION BY r ORDER BY m) AS i FROM mm), i2 AS (SELECT r, m AS z, row_number() OVER (PARTITION BY r ORDER BY md5(m||'|'||r||'|0null'), m) AS i FROM mm), mt AS (SELECT r, m, z FROM i1 JOIN i2 USING (r, i)),
q1 AS (SELECT x.r, corr(x.d, y.d) AS c FROM d1 x JOIN d1 y ON x.r=y.r AND x.a=y.a AND x.b=y.b AND x.side=0 AND y.side=1 GROUP BY 1), dz AS (SELECT y.r, least(p.z,q.z) AS a, greatest(p.z,q.z) AS b, y.d FROM d1 y JOIN mt p ON p.r=y.r AND p.m=y.a JOIN mt q ON q.r=y.r AND q.m=y.b WHERE side=1),
q2 AS (SELECT x.r, corr(x.d, y.d) AS z FROM d1 x JOIN dz y ON x.r=y.r AND x.a=y.a AND x.b=y.b AND x.side=0 GROUP BY 1), l AS (SELECT count(c) AS n, avg(c) AS r, list_sort(list(c)) AS c, avg(z) AS nr, list_sort(list(z)) AS z FROM q1 LEFT JOIN q2 USING (r))
SELECT n AS replicates, {_mil('r')} AS r, {_mil('c[1+CAST(floor(0.05*len(c)) AS INTEGER)]')} AS r05, {_mil('c[1+CAST(floor(0.95*len(c)) AS INTEGER)]')} AS r95, {_mil('nr')} AS null_r, {_mil('z[1+CAST(floor(0.95*len(z)) AS INTEGER)]')} AS null_r95 FROM l""")
def split_half_replication(t):
    """Correlations of divergences from two even halves of the orders, 200 times, and with models shuffled."""
    out = stats.split_half(_selected(t), "model", "c", "f", 200, 0)
    return out.withColumns({c: millionths(c) for c in ("r", "r05", "r95", "null_r", "null_r95")})


@query(f"""WITH {_SEL}, c0 AS (SELECT m, f, {_ab('c', '0')} FROM s0), c1 AS (SELECT r, m, f, sum({_WEIGHT}) AS n FROM c0, (SELECT unnest(range(0,500)) AS r) GROUP BY ALL UNION ALL SELECT -1, m, f, count(*) FROM s0 GROUP BY ALL), {_jsd_by('r', 'c1')},
s1 AS (SELECT r, a, b, d FROM d1 UNION ALL SELECT r, b, a, d FROM d1), k1 AS (SELECT r, a, b, row_number() OVER (PARTITION BY r, a ORDER BY d, b) AS i FROM s1), o AS (SELECT a, b FROM k1 WHERE i=1 AND r=-1)
SELECT o.a AS model, o.b AS nearest, {_mil('avg(CASE WHEN k1.b=o.b THEN 1.0 ELSE 0.0 END)')} AS stable FROM o LEFT JOIN k1 ON k1.a=o.a AND k1.i=1 AND k1.r>=0 GROUP BY ALL""")
def edge_stability(t):
    """How often a model's nearest neighbour stays the same when orders are drawn anew, 500 times."""
    return stats.edge_stability(_selected(t), "model", "c", "f", 500, 0).withColumn("stable", millionths("stable"))


@query()
def distance_drivers(t):
    """Divergence explained by a gap and by family."""
    from lexmill.plans.panel import _families, _jsd

    f = _families(t)
    size = f.select("model", (F.col("model") * 1.0).alias("x"))
    return stats.distance_drivers(_jsd(t), size, f, "model", "x", "family")
