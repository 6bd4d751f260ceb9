"""Queries on questions made from documents: the whole set of ids, and control passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import questions as op
from lexmill.operators.relational import place_in_group
from lexmill.plans.registry import query
from lexmill.plans.scalars import _NOISE

_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_CITES = r"\b(Id\.|supra|infra|Cir\.|U\.S\.C\.)|[§¶]"
_USABLE = rf"len(string_split(x, ' ')) BETWEEN 22 AND 70 AND regexp_matches(x, '^\p{{Lu}}') AND NOT regexp_matches(x, '\d') AND NOT regexp_matches(x, '{_CITES}') AND len(x) - len(replace(x, '(', '')) = len(x) - len(replace(x, ')', '')) AND len(x) - len(replace(x, '“', '')) = len(x) - len(replace(x, '”', ''))"


def _clean(text: str) -> str:
    return f"regexp_replace({text}, '{_NOISE}', '', 'g')"


def _sentences(text: str) -> str:
    return rf"list_transform(string_split(regexp_replace({text}, '([.!?”])\s+([A-ZÀ-ÖØ-Þ“])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_SQUEEZE.format('x')})"


def _nearest(first: str, least: str, end: str, fits: str) -> str:
    return f"coalesce(list_filter(range({first}, {end}), lambda i: {fits})[1], list_filter(range({first} - 1, {least} - 1, -1), lambda i: {fits})[1])"


_HEAD = r"(regexp_matches(trim(x), '^[IVXL]{1,5}\.(\s+[A-Z].{0,58})?$') OR regexp_matches(trim(x), '^[A-Z][A-Z .\-''&]{5,50}$') OR regexp_matches(trim(x), '^[A-Z]\.\s+[A-Z].{2,58}$'))"


def _context(source: str, percent: int) -> str:
    """CTEs up to c (id, t, idx, b, s, w, h, a): source has (id, t, idx)."""
    name = _SQUEEZE.format("x")
    lines = f"list_transform(string_split(substr(t, s0 + 1), chr(10)), lambda x, k: {{'pos': len(x) + 1, 'last': -1000, 'out': CASE WHEN {_HEAD} AND len({name}) >= 4 AND NOT (k = 1 AND s0 > 0 AND substr(t, s0, 1) <> chr(10)) THEN [{{'heading': {name}, 'at': 0, 'nxt': len(x) + 1}}] ELSE [] END}})"
    step = "CASE WHEN len(e.out) > 0 AND st.pos - st.last >= 20 THEN {'pos': st.pos + e.pos, 'last': st.pos, 'out': list_append(st.out, {'heading': e.out[1].heading, 'at': st.pos, 'nxt': st.pos + e.pos})} ELSE {'pos': st.pos + e.pos, 'last': st.last, 'out': st.out} END"
    around = "array_to_string(w[i - 47:i + 20], ' ')"
    fits = rf"""regexp_matches(w[i + 1], '^\p{{Lu}}') AND regexp_matches(w[i], '[.]["”]?$') AND NOT regexp_matches({around}, '\d|{_CITES}')"""
    return f"""
p0 AS ({source}),
p1 AS (SELECT *, CAST(floor(len(t) * 5 / 100) AS BIGINT) AS s0, {_SQUEEZE.format(_clean("t"))} AS b, list_filter({_sentences(_clean("t"))}, lambda x: {_USABLE}) AS s FROM p0),
p2 AS (SELECT *, list_filter(string_split(b, ' '), lambda x: x <> '') AS w, {lines} AS l FROM p1),
p3 AS (SELECT *, list_reduce(list_prepend({{'pos': s0, 'last': -1000, 'out': []}}, l), lambda st, e: {step}).out AS h FROM p2),
c AS (SELECT id, t, idx, b, s, w, h, len(s) AS ns, len(w) AS nw, CASE WHEN len(w) - 20 > 48 THEN {_nearest(f"least(greatest(len(w) * {percent} // 100, 48), len(w) - 21)", "48", "len(w) - 20", fits)} END AS a FROM p3)"""


def _row(qid: str, prompt: str, answer: str, evidence: str) -> str:
    return f"SELECT id, '{qid}' AS qid, {prompt} AS prompt, {answer} AS answer, {evidence} AS evidence FROM c"


def _completion(qid: str, percent: int, words: str) -> str:
    pick = _nearest(f"least(ns - 1, ns * {percent} // 100)", "0", "ns", "len(string_split(s[i + 1], ' ')) > want + 6")
    return f"""SELECT id, '{qid}' AS qid, CASE WHEN j IS NULL THEN '' ELSE array_to_string(string_split(s[j + 1], ' ')[1:want], ' ') END AS prompt, array_to_string(string_split(s[j + 1], ' ')[want + 1:], ' ') AS answer,
  CASE WHEN ns < 6 THEN 'too few sentences' WHEN j IS NULL THEN 'no sentence for a prompt of ' || want ELSE 'sentence ' || (j + 1) || '/' || ns || ', prompt ' || want END AS evidence
  FROM (SELECT *, CASE WHEN ns >= 6 THEN {pick} END AS j FROM (SELECT *, {words} AS want FROM c))"""


def _anchored(qid: str, n: int) -> str:
    return _row(qid, f"CASE WHEN a IS NULL THEN '' ELSE array_to_string(w[a - {n} + 1:a], ' ') END", "array_to_string(w[a + 1:a + 20], ' ')", f"CASE WHEN a IS NULL THEN 'no anchor' ELSE 'word ' || a || '/' || nw || ', prompt {n}' END")


def _after(qid: str, k: int) -> str:
    found = f"list_filter({_sentences(_clean(f'substr(t, h[{k}].nxt + 1)'))}, lambda x: len(string_split(x, ' ')) >= 8 AND regexp_matches(x, '^\\p{{Lu}}'))[1]"
    return _row(qid, "''", f"CASE WHEN len(h) >= {k} THEN {found} END", f"CASE WHEN len(h) < {k} THEN len(h) || ' headings' ELSE 'after ' || h[{k}].heading END")


def _long() -> str:
    body = "array_to_string(w[i + 1:i + 90], ' ')"
    fits = rf"regexp_matches(w[i + 1], '^\p{{Lu}}') AND NOT regexp_matches({body}, '\d|{_CITES}')"
    return f"""SELECT id, 'Q14' AS qid, coalesce(array_to_string(w[z + 1:z + 30], ' '), '') AS prompt, array_to_string(w[z + 31:z + 90], ' ') AS answer,
  CASE WHEN nw < 290 THEN 'text too short' WHEN z IS NULL THEN 'no clean stretch' ELSE 'words ' || z || '-' || (z + 90) || '/' || nw END AS evidence
  FROM (SELECT *, CASE WHEN nw >= 290 THEN list_filter(range(nw // 3, least(nw - 90, nw * 80 // 100), 10), lambda i: {fits})[1] END AS z FROM c)"""


_DEPTHS = (2, 15, 30, 45, 60, 75, 90)
_FAMILY = [_anchored(f"Q{21 + i}", n) for i, n in enumerate((6, 12, 24, 48))]
_OUT = """q.id, q.qid, prompt, CAST(CASE WHEN prompt = '' THEN 0 ELSE len(string_split(prompt, ' ')) END AS INTEGER) AS prompt_words, md5(coalesce(answer, '')) AS answer, CAST(coalesce(answer, '') <> '' AS INTEGER) AS found, evidence,
  CAST(CASE WHEN q.qid > 'Q04' AND coalesce(answer, '') <> '' AND contains(c.b, answer) THEN strpos(c.b, answer) - 1 END AS INTEGER) AS lo"""
_SOURCE = "SELECT doc_id AS id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents"
_FACTS = [("Q01", "source"), ("Q02", "CAST(1990 + doc_id % 35 AS VARCHAR)"), ("Q03", "lower(lang || ' v. ' || source)"), ("Q04", "CAST(DATE '1990-01-01' + CAST(doc_id % 12000 AS INTEGER) AS VARCHAR)")]
_ALL = [
    *[f"SELECT doc_id AS id, '{q}' AS qid, '' AS prompt, {a} AS answer, 'from the record' AS evidence FROM documents" for q, a in _FACTS],
    _row("Q05", "''", "s[1]", "'first sentence'"), _row("Q06", "''", "s[-1]", "'last sentence'"),
    *[_completion(f"Q{7 + i:02d}", p, "[6, 12, 24, 48][idx % 4 + 1]") for i, p in enumerate(_DEPTHS)],
    _long(), _row("Q15", "''", "h[1].heading", "len(h) || ' headings'"),
    _row("Q16", "''", "CASE WHEN len(h) >= 2 THEN array_to_string(list_transform(h[1:8], lambda x: x.heading), ' | ') END", "len(h) || ' headings'"),
    _after("Q17", 1), _after("Q18", 2), _completion("Q19", 50, "6"), _completion("Q20", 50, "48"), *_FAMILY,
]
_QUESTIONS = f"WITH {_context(_SOURCE, 45)}, q AS ({' UNION ALL '.join(_ALL)}) SELECT {_OUT.replace('q.id', 'q.id AS doc_id', 1)}, CAST(c.ns AS INTEGER) AS n_sentences, CAST(len(c.h) AS INTEGER) AS n_headings FROM q JOIN c USING (id)"


@query(_QUESTIONS)
def questions_of_documents(t):
    """All twenty ids and the anchored family for every document, answered or not, with where answers stand."""
    d = place_in_group(t.documents, None, ["doc_id"], "n")
    facts = {
        "Q01": ("Where is this from?", F.col("source")), "Q02": ("In what year was it filed?", (1990 + F.col("doc_id") % 35).cast("string")),
        "Q03": ("Who are the parties?", F.lower(F.concat("lang", F.lit(" v. "), "source"))), "Q04": ("On what date?", F.date_add(F.lit("1990-01-01").cast("date"), (F.col("doc_id") % 12000).cast("int"))),
    }
    q = op.questions(d, "doc_id", "text", facts, F.col("n"))
    return q.select("doc_id", "qid", "prompt", "prompt_words", F.md5(F.col("answer").cast("binary")).alias("answer"), "found", "evidence", "lo", "n_sentences", "n_headings")


_WORKS = f"""WITH w0 AS (SELECT doc_id, list_filter(string_split({_SQUEEZE.format(_clean("coalesce(text, '')"))}, ' '), lambda x: x <> '') AS w FROM documents),
w1 AS (SELECT doc_id, w, greatest(150, len(w) // 4) AS z FROM w0), w2 AS (SELECT doc_id, list_filter(list_transform(range(0, len(w), z), lambda k: w[k + 1:k + z]), lambda x: len(x) >= 150) AS b FROM w1 WHERE len(w) > 0),
w3 AS (SELECT doc_id, unnest(b) AS w, generate_subscripts(b, 1) AS k FROM w2),
w4 AS (SELECT doc_id, k, 'positive' AS arm, w FROM w3 UNION ALL SELECT doc_id, k, 'negative', list_transform(list_sort(list_transform(range(1, len(w) + 1), lambda i: {{'b': (i - 1) // 40, 'h': md5(doc_id || '|' || k || '|' || (i - 1)), 'w': w[i]}})), lambda x: x.w) FROM w3 WHERE doc_id % 3 = 0)"""
_CONTROL_ROWS = [*[_completion(f"Q{7 + i:02d}", p, "12") for i, p in enumerate(_DEPTHS)], *_FAMILY]
_CONTROLS = f"{_WORKS}, {_context('''SELECT doc_id || CASE WHEN arm = 'negative' THEN '_shuf' ELSE '' END || printf('_ch%02d', k) AS id, array_to_string(w, ' ') AS t, 0 AS idx FROM w4''', 50)}, q AS ({' UNION ALL '.join(_CONTROL_ROWS)}) SELECT {_OUT.replace('q.id', 'q.id AS case_id', 1)} FROM q JOIN c USING (id)"


@query(_CONTROLS)
def control_questions(t):
    """Control passages of documents as works, a third of them shuffled besides, with a row for each passage and question."""
    q = op.control_set(t.documents, "doc_id", "text", 4, 150, F.col("doc_id") % 3 == 0)
    return q.select("case_id", "qid", "prompt", "prompt_words", F.md5(F.col("answer").cast("binary")).alias("answer"), "found", "evidence", "lo")
