"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS width FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, width, array_to_string(w[s + 1:s + width], ' ') AS g FROM (SELECT item_id, w, width, unnest(generate_series(0, len(w) - width)) AS s FROM bl)),
dg AS (SELECT doc_id, s, width, array_to_string(w[s + 1:s + width], ' ') AS g
       FROM (SELECT doc_id, w, width, unnest(generate_series(0, len(w) - width)) AS s FROM dw, (SELECT DISTINCT width FROM bl) WHERE len(w) >= width)),
m AS (SELECT doc_id, s, dg.width, item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.width = bg.width),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + width - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM dw),
fr AS (SELECT term, count(*) AS n FROM dp GROUP BY term),
ip AS (SELECT item_id, width, len(w) AS len, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM bl),
st AS (SELECT item_id, width, unnest(generate_series(1, len(w) - width + 1)) AS s FROM bl),
rk AS (SELECT item_id, s, width, ip.term, row_number() OVER (PARTITION BY item_id, s ORDER BY coalesce(n, 0), p) AS r
       FROM st JOIN ip USING (item_id, width) LEFT JOIN fr ON fr.term = ip.term WHERE p BETWEEN s AND s + width - 1),
pr AS (SELECT DISTINCT a.item_id, a.term AS t0, b.term AS t1 FROM rk a JOIN rk b ON a.item_id = b.item_id AND a.s = b.s AND a.r = 1 AND b.r = 2),
nr AS (SELECT DISTINCT x.doc_id, item_id FROM pr JOIN dp x ON x.term = t0 JOIN dp y ON y.term = t1 AND y.doc_id = x.doc_id AND x.p <> y.p AND abs(x.p - y.p) <= 15
       UNION SELECT doc_id, item_id FROM rk JOIN dp ON dp.term = rk.term WHERE width = 1),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id LEFT JOIN nn ON dw.doc_id = nn.doc_id
"""

_OP5 = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM l),
b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(source, chr(0))) >= 5),
f AS (SELECT t.*, b.k IS NOT NULL AS gone FROM t LEFT JOIN b ON t.k = b.k),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, a.text
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""

_OP7 = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY k) AS g FROM n
      WINDOW w AS (PARTITION BY k ORDER BY c DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, g::BIGINT AS group_size, rn = 1 AS kept, sha256(k) AS text_sha256 FROM r
"""

_OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, b AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
c AS (SELECT v, min(u) AS m FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.v
"""

# (kind, pattern, group whose length counts, least length), in the order of the rules.
_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 0),  # a run's match starts where the run does, so this drops the short ones
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _op10() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(_KINDS):
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, st, st + length(m[i]) AS en FROM (
  SELECT doc_id, m, g, i, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS st
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS s,
               unnest(generate_series(1, len(regexp_extract_all(t, '{pattern}', 0)))) AS i FROM d)) WHERE length(g[i]) >= {least}""")
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({union}),
a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
      string_agg(kind || ':' || st::BIGINT || ':' || en::BIGINT, ',' ORDER BY st, rank) FILTER (rank < 3) AS base,
      string_agg(kind || ':' || st::BIGINT || ':' || en::BIGINT, ',' ORDER BY st, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


SQL = {
    "op3_decontamination": _OP3,
    "op5_line_dedup": _OP5,
    "op7_exact_dedup": _OP7,
    "op9_minhash_dedup": _OP9,
    "op10_secret_scans": _op10(),
}
