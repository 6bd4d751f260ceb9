"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

#: A-Z as a-z, other characters as they are.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components of links (a, b), given both ways, over the nodes of a table: the smallest node within reach.
_REACH = "reach(a, b) AS (SELECT {node}, {node} FROM {nodes} UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: int, pattern: str, value_group: int, least: int) -> str:
    """(doc_id, source, kind, start, end, value) of a pattern's matches: where a match starts follows from what stands between."""
    return f"""
    SELECT doc_id, source, {kind} AS kind, p0 AS a, p0 + length(m[i]) AS b, v[i] AS v FROM (
      SELECT doc_id, source, m, v, i, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS p0 FROM (
        SELECT doc_id, source, string_split_regex(text, '{pattern}') AS s, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {value_group}) AS v
        FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{pattern}')
      ), unnest(range(1, len(m) + 1)) AS t(i)
    ) WHERE length(v[i]) >= {least}"""


_SECRETS = f"""
WITH base AS ({_found(0, _ASSIGN, 2, 6)} UNION ALL {_found(1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_found(2, "[0-9a-f]{24,}", 0, 24)}),
loose AS (
  SELECT * FROM ({_found(3, "[A-Za-z0-9+/_=-]{24,}", 0, 24)}) l
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND list_aggregate(string_split(v, ''), 'entropy') >= 3.5
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = l.doc_id AND base.a < l.b AND l.a < base.b)
),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
owners AS (SELECT v, count(DISTINCT split_part(source, '/', 1)) AS n, count(DISTINCT source) AS repos FROM spans GROUP BY v),
kept AS (
  SELECT doc_id, kind, a, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b AS s, n = 1 AND repos < 10 AS live
  FROM spans JOIN owners USING (v) WHERE kind < 3 OR (n = 1 AND repos < 10)
),
each AS (
  SELECT doc_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, count_if(live) AS n_live,
    string_agg(s, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS b, string_agg(s, ',' ORDER BY a, kind) AS s
  FROM kept GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live
FROM (SELECT doc_id FROM documents) d LEFT JOIN each USING (doc_id)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0
),
met AS (
  SELECT doc_id, k, x.n, item FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM wins), unnest(range(1, len(w) - n + 2)) AS t(k)) x
  JOIN wins ON wins.n = x.n AND wins.s = x.s
),
hit AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM met, unnest(range(0, n)) AS t(o) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAR_DUP = rf"""
WITH RECURSIVE texts AS (
  SELECT text, min(doc_id) AS rep, regexp_extract_all({_LOWER.replace("coalesce(text, '')", "text")}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL GROUP BY text
),
shingles AS (
  SELECT DISTINCT rep, array_to_string(w[k:k + 4], ' ') AS s FROM texts, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0
),
sizes AS (SELECT rep, count(*) AS n FROM shingles GROUP BY rep),
pairs AS (SELECT x.rep AS a, y.rep AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.rep <> y.rep GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.rep = a JOIN sizes n ON n.rep = b WHERE 100 * common >= 75 * (m.n + n.n - common)
),
{_REACH.format(node="rep", nodes="texts")},
comps AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN component ELSE doc_id END AS component_id, CASE WHEN n > 0 THEN component = doc_id ELSE true END AS kept
FROM (SELECT doc_id, text FROM documents) d LEFT JOIN texts USING (text) LEFT JOIN sizes USING (rep) LEFT JOIN comps USING (rep)
"""

_EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.9),
{_REACH.format(node="vec_id", nodes="v")},
comps AS (SELECT a AS vec_id, min(b) AS component FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM (SELECT vec_id FROM embeddings) e LEFT JOIN comps USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

#: Base32 of a SHA-1 digest: eight times five hexadecimal digits as four letters.
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda r: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((CAST('0x' || substr(h, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) >> r) & 31) + 1]), '')), '')"
_WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p
"""

#: CRC-32 of a string of ASCII characters, bit by bit: a code is a step of its own, then eight shifts (-1).
_CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"
_TRIE = rf"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
each AS (SELECT c, c - c % 20 AS base, {_CRC32.format(c="c")} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
turns AS (
  SELECT each.c, 0 AS own, k, role, text FROM each JOIN own ON own.c = each.base WHERE k <= h
  UNION ALL SELECT c, 1, k, role, text FROM own JOIN each USING (c) WHERE k > h
),
paths AS (
  SELECT c, d, text, l[1:d] AS path, d = len(l) AS last FROM (
    SELECT c, row_number() OVER w AS d, text, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY own, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
    FROM turns WINDOW w AS (PARTITION BY c ORDER BY own, k)
  )
  UNION ALL SELECT c, 0, '', [], c NOT IN (SELECT c FROM turns) FROM each
),
nodes AS (
  SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends
  FROM paths GROUP BY path
),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (
  SELECT path[1:k] AS path, count_if(n_children = 0) AS n_leaves, sum(saved) AS saved FROM full_nodes, unnest(range(0, depth + 1)) AS t(k) GROUP BY 1
)
SELECT x.depth, x.conv_id, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x JOIN sums USING (path) LEFT JOIN nodes p ON x.depth > 0 AND p.path = x.path[1:x.depth - 1]
"""

ORACLE_SQL = {
    "op3_secret_scan": _SECRETS,
    "op5_decontamination": _DECONTAMINATION,
    "op6_near_dup": _NEAR_DUP,
    "op8_embedding_dup": _EMBEDDINGS,
    "op9_warc_zip": _WARC,
    "op12_prefix_trie": _TRIE,
}
