"""Queries on text functions, one or more to a query, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import headings, rules, templates
from lexmill.functions import text as tx
from lexmill.plans.registry import query


def _md5(c):
    return F.md5(c.cast("binary"))


_FOLD = f"translate(text,'{tx.FOLD_FROM}','{tx.FOLD_TO.replace(chr(39), 2 * chr(39))}')"
_NORM = "trim(regexp_replace(lower(replace(replace(replace(replace({},'­',''),'​',''),'…','...'),'§','section')),'\\s+',' ','g'))"


@query(f"""WITH n AS (SELECT doc_id, {_NORM.format(_FOLD)} AS n FROM (SELECT doc_id, replace(replace(replace(text,'the','th–e'),'and','“and”'),' is ',' § ') AS text FROM documents))
SELECT doc_id, md5(n) AS plain, md5(trim(regexp_replace(regexp_replace(n,'[^\\p{{L}}\\p{{N}}_\\s]',' ','g'),'\\s+',' ','g'))) AS bare, len(regexp_extract_all(n,'[\\p{{L}}\\p{{N}}_'']+')) AS tokens FROM n""")
def normalised_texts(t):
    """typographic characters, case and white space folded, with and without punctuation, and the number of words."""
    text = F.replace(F.replace(F.replace("text", F.lit("the"), F.lit("th–e")), F.lit("and"), F.lit("“and”")), F.lit(" is "), F.lit(" § "))
    x = t.documents.select("doc_id", text.alias("text"))
    return x.select("doc_id", _md5(tx.normalize(F.col("text"))).alias("plain"), _md5(tx.normalize(F.col("text"), drop_punct=True)).alias("bare"), F.size(tx.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text),'[a-z0-9'']+') AS w FROM documents), s AS (SELECT doc_id, list_distinct(list_transform(range(1,greatest(len(w)-6,1)), lambda i: array_to_string(w[i:i+7],' '))) AS s FROM w)
SELECT doc_id, len(s) AS shingles, md5(coalesce(list_min(s),'')) AS first FROM s""")
def token_shingles(t):
    """shingles of eight plain words, the last one included."""
    w = t.documents.select("doc_id", F.explode(F.array(tx.plain_words(F.col("text")))).alias("w"))  # made once
    x = w.select("doc_id", F.explode(F.array(tx.shingles(F.col("w"), 8))).alias("s"))
    return x.select("doc_id", F.size("s").cast("long").alias("shingles"), _md5(F.coalesce(F.array_min("s"), F.lit(""))).alias("first"))


_NOISE = "(?mi)^[ \\t]*(?:page\\s+\\d+(?:\\s+of\\s+\\d+)?|-[ \\t]*\\d+[ \\t]*-|\\d{1,4})[ \\t]*$"


@query(f"""SELECT doc_id, md5(regexp_replace('12'||chr(10)||replace(text,'. ',chr(10)||'Page 3 of 9'||chr(10))||chr(10)||'- 7 -','{_NOISE}','','g')) AS clean FROM documents""")
def page_noise(t):
    """F8: page numbers between the lines taken out."""
    s = F.concat(F.lit("12\n"), F.replace("text", F.lit(". "), F.lit("\nPage 3 of 9\n")), F.lit("\n- 7 -"))
    return t.documents.select("doc_id", _md5(tx.without_noise(s)).alias("clean"))


@query("""SELECT c_custkey, trim(regexp_replace(regexp_replace(replace(lower(c_name||' Inc. v. S.E.C. '||c_mktsegment||' Co.'),'.',''),'\\b(inc|llc|corp|co|ltd|lp|et al)\\b',' ','g'),'[^a-z0-9]+',' ','g')) AS caption FROM customer""")
def case_keys(t):
    """captions folded for comparison."""
    caption = F.concat("c_name", F.lit(" Inc. v. S.E.C. "), "c_mktsegment", F.lit(" Co."))
    return t.customer.select("c_custkey", tx.case_key(caption).alias("caption"))


@query("""SELECT doc_id, len(regexp_extract_all(text,'\\S+')) AS n, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text,'\\S+'), lambda x: len(x))),0) AS BIGINT) AS letters, CASE WHEN len(regexp_extract_all(text,'\\S+'))>0 THEN CAST(len(string_split_regex(text,'\\S+')[1]) AS INTEGER) END AS first FROM documents""")
def word_spans(t):
    """places of all words: how many, their characters in all, and where the first begins."""
    x = t.documents.select("doc_id", headings.word_spans("text", r"[^\t\n\f\r ]+").alias("s"))  # DuckDB's \S
    letters = F.coalesce(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])), F.lit(0).cast("long"))
    return x.select("doc_id", F.size("s").cast("long").alias("n"), letters.alias("letters"), F.get("s", 0)["start"].alias("first"))


@query("""SELECT doc_id, md5(regexp_replace(text,'^\\s+|\\s+$','','g')) AS body FROM documents""")
def between_marks(t):
    """a licence's header and footer taken off."""
    s = F.concat(F.lit("some licence\n*** START OF THIS BOOK ***\n"), "text", F.lit("\n*** END OF THIS BOOK ***\nmore licence\n*** END OF THIS BOOK ***"))
    return t.documents.select("doc_id", _md5(tx.between_marks(s, r"\*\*\* START OF [^*]*\*\*\*", r"\*\*\* END OF [^*]*\*\*\*")).alias("body"))


_PROFESSIONS = ["teacher", "retired engineer", "nurse", "widget maker"]


@query("""SELECT p_partkey, [CAST(p_size AS VARCHAR)] AS ages, ['$'||CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)||'.50'] AS dollars, CASE p_partkey%3 WHEN 0 THEN ['nurse'] WHEN 1 THEN ['teacher','nurse'] ELSE CAST([] AS VARCHAR[]) END AS professions, CASE WHEN p_partkey%2=0 THEN 'Anna' END AS name FROM part WHERE p_size BETWEEN 1 AND 120""")
def entities(t):
    """ages, amounts, professions and first names in texts."""
    who = F.when(F.col("p_partkey") % 3 == 0, "a Nurse").when(F.col("p_partkey") % 3 == 1, "a nurse, once a teacher").otherwise("a person")
    name = F.when(F.col("p_partkey") % 2 == 0, "Anna Lee is").otherwise("this is")
    s = F.concat(name, F.lit(" "), who, F.lit(", a "), F.col("p_size").cast("string"), F.lit("-year-old with $"), F.col("p_retailprice").cast("long").cast("string"), F.lit(".50 at hand"))
    x = t.part.where("p_size between 1 and 120").select("p_partkey", s.alias("s"))
    return x.select("p_partkey", tx.ages(F.col("s")).alias("ages"), tx.dollars(F.col("s")).alias("dollars"), tx.professions(F.col("s"), _PROFESSIONS).alias("professions"), tx.first_name(F.col("s")).alias("name"))


@query("""SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN '20-'||o_custkey WHEN 1 THEN 'A '||o_custkey END AS docket FROM orders""")
def dockets(t):
    """a docket number by the first pattern that fits."""
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    s = F.when(k == 0, F.concat(F.lit("Docket A  7, No. 20-"), c)).when(k == 1, F.concat(F.lit("see Docket A \n "), c)).otherwise("none here")
    return t.orders.select("o_orderkey", tx.first_of(s, [r"No\.\s*(\d+-\d+)", r"Docket\s+(A\s+\d+)"]).alias("docket"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey%4=0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, CASE WHEN o_custkey%4=0 THEN '' ELSE 'ca'||o_custkey%12 END AS court, CASE WHEN o_custkey%4=0 THEN 'other x'||o_orderkey ELSE 'Smith v. Roe '||o_orderkey END AS caption FROM orders""")
def file_names(t):
    """year, court and caption from file names."""
    k = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("other_x"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("cl_"), F.year("o_orderdate").cast("string"), F.lit("_ca"), (F.col("o_custkey") % 12).cast("string"), F.lit("_Smith_v._Roe_"), k, F.lit(".PDF")))
    return t.orders.select("o_orderkey", tx.file_name_parts(name).alias("p")).select("o_orderkey", "p.year", "p.court", "p.caption")


@query("""SELECT conv_id, turn, CASE turn%4 WHEN 0 THEN 'recalled' WHEN 1 THEN 'inferred' WHEN 2 THEN 'recalled' ELSE '' END AS recall, md5(trim(text)) AS answer FROM conversations""")
def split_recalls(t):
    """source and answer of replies in the protocol, and of others."""
    k = F.col("turn") % 4
    head = F.when(k == 0, "SOURCE: recalled\nANSWER: ").when(k == 1, "source: no\nAnswer: ").when(k == 2, " Source: YES\nANSWER:").otherwise("")
    return t.conversations.select("conv_id", "turn", tx.split_recall(F.concat(head, "text")).alias("r")).select("conv_id", "turn", "r.recall", _md5(F.col("r.answer")).alias("answer"))


@query("""SELECT doc_id, md5(array_to_string(list_transform(string_split(text,chr(10)), lambda x: CASE WHEN regexp_matches(x,'(?i)the|der') THEN '> ' ELSE '  ' END||x),chr(10))) AS marked FROM documents""")
def highlighted_lines(t):
    """lines that hold a pattern, marked."""
    return t.documents.select("doc_id", _md5(tx.highlighted(F.col("text"), "the|der")).alias("marked"))


@query("""SELECT p_brand, list_sort(list(c)) AS flagged FROM (SELECT DISTINCT p_brand, p_type||' § '||p_size AS c FROM part WHERE NOT regexp_matches(lower(p_type),'economy|promo')) GROUP BY p_brand""")
def flagged_citations(t):
    """Citations that no known pattern covers."""
    c = t.part.select("p_brand", F.concat("p_type", F.lit(" § "), F.col("p_size").cast("string")).alias("c")).groupBy("p_brand").agg(F.array_sort(F.collect_set("c")).alias("c"))
    return c.select("p_brand", tx.flagged(F.col("c"), ["economy", "promo"]).alias("flagged")).where(F.size("flagged") > 0)


@query("""SELECT event_id, CASE WHEN k BETWEEN 0 AND 49 THEN k END AS place, CASE WHEN k BETWEEN 0 AND 49 THEN 'entry '||k END AS entry FROM (SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT)-10 AS k FROM events)""")
def guarded_indices(t):
    """F29 in part, F30: indices into a vocabulary of fifty entries, nothing where they are out of range."""
    k = F.get_json_object("props", "$.k").cast("long") - 10
    vocabulary = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("entry "), i.cast("string")))
    x = t.events.select("event_id", tx.in_range(k, F.size(vocabulary)).alias("place"))
    return x.select("event_id", "place", F.when(F.col("place").isNotNull(), F.get(vocabulary, F.col("place").cast("int"))).alias("entry"))


@query("""SELECT page_id, regexp_replace(url,'[^\\p{L}\\p{N}_.\\-]','_','g') AS name FROM pages""")
def safe_names(t):
    """file names from addresses."""
    return t.pages.select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("""SELECT event_id, CASE WHEN p<0.001 THEN '<.001' ELSE regexp_replace(format('{:.3f}', p),'^0+','') END AS p FROM (SELECT event_id, (event_id*event_id%10007)/10007.0::DOUBLE AS p FROM events)""")
def p_values(t):
    """F32: p values as texts."""
    return t.events.select("event_id", tx.p_text((F.col("event_id") * F.col("event_id") % 10007) / F.lit(10007.0)).alias("p"))


@query("""SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(s AS INTEGER) AS size, CAST(len(w)//s + CASE WHEN len(w)%s>=20 THEN 1 ELSE 0 END AS BIGINT) AS blocks FROM (SELECT doc_id, w, greatest(20, len(w)//4) AS s FROM (SELECT doc_id, regexp_extract_all(text,'\\S+') AS w FROM documents))""")
def word_blocks(t):
    """Texts in four blocks of words, of twenty words at least; a shorter rest is left out."""
    x = t.documents.select("doc_id", F.explode(F.array(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))).alias("w"))
    size = F.greatest(F.lit(20), F.floor(F.size("w") / 4).cast("int"))
    return x.select("doc_id", F.size("w").cast("long").alias("words"), size.alias("size"), F.size(tx.word_blocks(F.col("w"), 4, 20)).cast("long").alias("blocks"))


@query("""WITH RECURSIVE h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id AS p FROM events), r AS (SELECT user_id, k, p, p AS kept, true AS keep FROM h WHERE k=1
UNION ALL SELECT h.user_id, h.k, h.p, CASE WHEN h.p-r.kept>=20 THEN h.p ELSE r.kept END, h.p-r.kept>=20 FROM r JOIN h ON h.user_id=r.user_id AND h.k=r.k+1) SELECT user_id, count(*) AS n, CAST(sum(p) AS BIGINT) AS places FROM r WHERE keep GROUP BY user_id""")
def spaced_headings(t):
    """Headings that stand too near the last one kept are dropped; events stand for headings, their ids for places."""
    h = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("place"), F.col("event_type").alias("heading")))).alias("h"))
    x = h.select("user_id", tx.spaced_headings(F.col("h")).alias("h"))
    return x.select("user_id", F.size("h").cast("long").alias("n"), F.aggregate("h", F.lit(0).cast("long"), lambda a, v: a + v["place"]).alias("places"))


_STOP = ["small", "large"]


@query("""WITH w AS (SELECT p_partkey, c, list_filter(string_split_regex(c,'[^A-Za-z0-9'']+'), lambda x: x<>'') AS w FROM (SELECT p_partkey, p_name||' v. '||p_type||' li' AS c FROM part)),
z AS (SELECT p_partkey, c, w, list_transform(list_sort(list_transform(list_filter(range(1,len(w)+1), lambda i: len(w[i])>3 AND lower(w[i]) NOT IN ('small','large')), lambda i: {'n': -len(w[i]), 'i': i, 'w': w[i]})), lambda x: x.w)[1:3] AS d FROM w),
v AS (SELECT p_partkey, [c, array_to_string(w[1:len(w)-1],' '), array_to_string(d,' '), coalesce(d[1],'')] AS v FROM z) SELECT p_partkey, list_filter(v, lambda x, i: len(x)>=3 AND list_position(list_transform(v, lambda y: lower(y)), lower(x))=i) AS variants FROM v""")
def query_variants(t):
    """S19 in part: the phrases to search for a caption by."""
    caption = F.concat("p_name", F.lit(" v. "), "p_type", F.lit(" li"))
    return t.part.select("p_partkey", tx.query_variants(caption, _STOP).alias("variants"))


@query("""SELECT conv_id, turn, count(*) FILTER (WHERE w IN ('she','She','SHE')) AS she, count(*) FILTER (WHERE w IN ('her','Her')) AS her, count(*) AS words FROM (SELECT conv_id, turn, unnest(['He','him','HE','his','they']||regexp_extract_all(text,'[A-Za-z]+')) AS w0 FROM conversations), LATERAL (SELECT CASE w0 WHEN 'he' THEN 'she' WHEN 'He' THEN 'She' WHEN 'HE' THEN 'SHE' WHEN 'him' THEN 'her' WHEN 'his' THEN 'her' WHEN 'Him' THEN 'Her' WHEN 'His' THEN 'Her' ELSE w0 END AS w) GROUP BY ALL""")
def flipped_pronouns(t):
    """Pronouns turned, with their capitals."""
    w = F.concat(F.array(*[F.lit(x) for x in ("He", "him", "HE", "his", "they")]), F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1))
    x = t.conversations.select("conv_id", "turn", F.explode(F.transform(w, lambda v: tx.flipped(v, {"he": "she", "him": "her", "his": "her"}))).alias("w"))
    return x.groupBy("conv_id", "turn").agg(F.count_if(F.col("w").isin("she", "She", "SHE")).alias("she"), F.count_if(F.col("w").isin("her", "Her")).alias("her"), F.count("*").alias("words"))


@query("""SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN 'no_suffix_tokens' WHEN 1 THEN 'boundary_merge' ELSE '' END AS warning FROM orders""")
def alignment_warnings(t):
    """Whether a prefix's tokens are the beginning of the whole's."""
    k = F.col("o_orderkey") % 3
    whole = F.array(F.col("o_orderkey"), F.col("o_custkey"), F.lit(7).cast("long"))
    prefix = F.when(k == 1, F.array(F.col("o_orderkey"), F.lit(-1).cast("long"))).otherwise(F.slice(whole, 1, 2))
    return t.orders.select("o_orderkey", rules.alignment_warning(prefix, whole, F.when(k == 0, F.lit(None).cast("int")).otherwise(2)).alias("warning"))


@query(r"""WITH t AS (SELECT conv_id, list({'role': coalesce(role,''), 'text': coalesce(text,'')} ORDER BY turn) AS l FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, l[1:len(l)-1] AS l, l[-1].text AS last FROM t WHERE len(l)>1),
q AS (SELECT conv_id, array_to_string(list_transform(l, lambda x: x.text||chr(10)), '') AS raw, array_to_string(list_transform(l, lambda x: '<|im_start|>'||x.role||chr(10)||x.text||'<|im_end|>'||chr(10)), '')||'<|im_start|>assistant'||chr(10) AS marked,
'<|begin_of_text|>'||array_to_string(list_transform(l, lambda x: '<|start_header_id|>'||x.role||'<|end_header_id|>'||chr(10)||chr(10)||x.text||'<|eot_id|>'), '')||'<|start_header_id|>assistant<|end_header_id|>'||chr(10)||chr(10) AS headed, rtrim(raw, chr(10)) AS cut, last FROM p),
m AS (SELECT *, regexp_matches(cut,'\S$') AND regexp_matches(last,'^\S') AS merged FROM q), n AS (SELECT *, CASE WHEN merged THEN regexp_replace(last,'^\S+','') ELSE last END AS rest FROM m)
SELECT conv_id, md5(raw) AS raw, md5(marked) AS marked, md5(headed) AS headed, CASE WHEN regexp_matches(last,'\S') THEN CAST(len(regexp_extract_all(headed,'\S+')) AS INTEGER) END AS first, CASE WHEN NOT regexp_matches(rest,'\S') THEN 'no_suffix_tokens' WHEN merged THEN 'boundary_merge' ELSE '' END AS warning FROM n""")
def prefix_texts(t):
    """What goes before a conversation's last turn, as it is and in two chat templates, where the turn's first token is behind
    the latter, and what happens at the seam if the former has no line break at its end."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    x = turns.where(F.size("t") > 1).select("conv_id", F.slice("t", F.lit(1), F.size("t") - 1).alias("p"), F.element_at("t", -1)["text"].alias("last"))
    x = x.select("conv_id", "last", templates.raw(F.col("p")).alias("raw"), templates.chat(F.col("p"), templates.MARKED).alias("marked"), templates.chat(F.col("p"), templates.HEADED).alias("headed"))
    first = templates.seam(F.col("headed"), F.col("last"))["first"]
    joined = templates.seam(F.regexp_replace("raw", r"\n+\z", ""), F.col("last"))["warning"]
    return x.select("conv_id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("raw", "marked", "headed")], first.alias("first"), joined.alias("warning"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(l,'^[IVXL]{1,5}\\.(\\s+[A-Z].{0,58})?$') THEN 'roman' WHEN regexp_matches(l,'^[A-Z][A-Z .\\-''&]{5,50}$') THEN 'caps' WHEN regexp_matches(l,'^[A-Z]\\.\\s+[A-Z].{2,58}$') THEN 'lettered' END AS kind FROM
(SELECT conv_id, turn, trim(CASE turn%4 WHEN 0 THEN 'IV. Standing' WHEN 1 THEN 'STATEMENT OF FACTS' WHEN 2 THEN 'B. The second claim' ELSE substr(text,1,60) END) AS l FROM conversations)""")
def heading_kinds(t):
    """kinds of headings."""
    k = F.col("turn") % 4
    line = F.when(k == 0, "IV. Standing").when(k == 1, "STATEMENT OF FACTS").when(k == 2, "B. The second claim").otherwise(F.substring("text", 1, 60))
    return t.conversations.select("conv_id", "turn", tx.heading_kind(line).alias("kind"))


@query("""WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(text,'([.!?”])\\s+([A-ZÀ-ÖØ-Þ“])','\\1'||chr(1)||'\\2','g'),chr(1)), lambda x: trim(regexp_replace(x,'\\s+',' ','g'))) AS s FROM documents)
SELECT doc_id, md5(s[1]) AS first, md5(s[-1]) AS last, CASE WHEN len(s)>=3 THEN md5(s[3]) END AS third FROM s""")
def nth_sentences(t):
    """First, last and third sentence."""
    x = t.documents.select("doc_id", F.explode(F.array(tx.sentences(F.col("text")))).alias("s"))
    return x.select("doc_id", _md5(F.get("s", 0)).alias("first"), _md5(F.element_at("s", -1)).alias("last"), _md5(F.get("s", 2)).alias("third"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name||' small cold steel widget',' ') AS w FROM part), f AS (SELECT p_partkey, array_to_string(list_transform(w, lambda x: CASE x WHEN 'cold steel' THEN 'X' WHEN 'cold' THEN 'warm' WHEN 'small' THEN 'big' ELSE x END),' ') AS s FROM w) SELECT p_partkey, replace(s,'warm steel widget','hot iron gadget') AS text FROM f""")
def longest_first(t):
    """Forms replaced longest first, so that none is taken for a part of another."""
    from lexmill.functions import names

    s = F.concat("p_name", F.lit(" small cold steel widget"))
    return t.part.select("p_partkey", names.replaced(s, {"cold": "warm", "cold steel widget": "hot iron gadget", "small": "big"}).alias("text"))
