"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat, secrets

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2])) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n + b.n AS total, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM p WHERE 100 * shared >= 85 * (total - shared)),
r AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS least FROM r GROUP BY i)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id, doc_id <= coalesce(c.least, doc_id) AS kept FROM s LEFT JOIN c ON s.doc_id = c.i
"""


def _escaped(text: str, marks: str) -> str:
    """Characters of a text once each mark takes two."""
    return " + ".join([f"length({text})", *(f"(length({text}) - length(replace({text}, '{m}', '')))" for m in marks)])


OP3 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, sum({len("### : ") + len(chat.END)} + {_escaped("role", chr(92) + "#<:")} + {_escaped("text", chr(92) + "#<")}) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM t
), a AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
k AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM w SEMI JOIN k ON w.m = k.m),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM s),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
o AS (SELECT p.doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS last, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""


def _spans(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {k} AS ord, '{kind}' AS kind, {least} AS least, unnest(string_split_regex(text, {p})) AS gap, unnest(regexp_extract_all(text, {p}, 0)) AS m, unnest(regexp_extract_all(text, {p}, {group})) AS v,
  unnest(range(0, len(string_split_regex(text, {p})))) AS i FROM d"""


#: Letters in either case are spelt out: case folding in this engine knows more letters than ASCII's.
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_PARTS = [
    _spans(0, "assign", f"({_EITHER})[\"']?\\x20*[:=]\\x20*[\"']?{secrets.VALUE}", 2, 12),
    _spans(1, "access", secrets.BASE["access"][0], 0, 18),
    _spans(2, "hex", secrets.BASE["hex"][0], 0, 16),
    _spans(3, "key", secrets.MORE["key"][0], 0, 20),
]
OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(_PARTS)}),
q AS (SELECT *, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM m),
s AS (SELECT doc_id, ord, kind, v, e - length(m) AS a, e FROM q WHERE m IS NOT NULL AND length(v) >= least),
o AS (SELECT v FROM s JOIN documents USING (doc_id) GROUP BY v HAVING regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND count(DISTINCT split_part(coalesce(source, ''), '/', 1)) < {secrets.EXAMPLE_OWNERS} AND count(DISTINCT coalesce(source, '')) < {secrets.EXAMPLE_REPOSITORIES}),
x AS (SELECT doc_id, ord, kind, a, e FROM s UNION ALL (SELECT DISTINCT doc_id, 4, 'live', e - length(v), e FROM s SEMI JOIN o ON s.v = o.v)),
g AS (SELECT doc_id, count_if(ord = 0) AS n_assign, count_if(ord = 1) AS n_access, count_if(ord = 2) AS n_hex, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord, e) FILTER (ord < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord, e) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
