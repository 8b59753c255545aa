"""DuckDB SQL for the corpus queries that SQL can say.

It says what a query's rows are from scratch: windows joined as texts, spans by splitting, prefixes as lists.
The others - a trained model, a tokenizer, XXH64 fingerprints, an approximate index, iterated pattern scores - have none
and are held against brute force in tests/llm.
"""

from __future__ import annotations

import string

from .linededup import MIN_WORDS

_LOW = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = "regexp_extract_all(coalesce(" + _LOW + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wanted),
runs AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
hits AS (SELECT r.doc_id, r.k, r.i, w.item_id FROM runs r JOIN wanted w USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN found USING (doc_id)
"""

CHAT = """
WITH t AS (SELECT conv_id, turn, role, text, struct_pack(role := role, text := text) AS t FROM conversations),
p AS (SELECT conv_id, list(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT conv_id, p, n FROM p WHERE len(p) = n),
first AS (SELECT p, min(conv_id) AS conv_id, min(n) AS n FROM whole GROUP BY p),
stays AS (SELECT conv_id, n FROM first f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.p = f.p AND p.n > f.n))
SELECT conv_id, s.n AS n_turns, string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn) || '<|end|>' AS rendered
FROM stays s JOIN t USING (conv_id) GROUP BY conv_id, s.n
"""

LINES = rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
seq AS (SELECT doc_id, no, s, w, row_number() OVER d AS at, sum(w) OVER (d ROWS UNBOUNDED PRECEDING) AS upto FROM (
  SELECT doc_id, no, s, len(string_split_regex(s, '\s+')) AS w FROM (SELECT doc_id, no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM raw) WHERE s <> '') WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
onward AS (SELECT a.doc_id, a.at AS a, min(b.at) AS b FROM seq a JOIN seq b ON b.doc_id = a.doc_id AND b.at >= a.at AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY a.doc_id, a.at),
back AS (SELECT b.doc_id, max(a.at) AS a, b.at AS b FROM seq a JOIN seq b ON b.doc_id = a.doc_id AND b.at >= a.at AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.at),
runs AS (SELECT r.doc_id, min(s.no) AS first, max(s.no) AS last, string_agg(s.s, chr(10) ORDER BY s.at) AS run
  FROM (SELECT * FROM onward UNION SELECT * FROM back) r JOIN seq s ON s.doc_id = r.doc_id AND s.at BETWEEN r.a AND r.b GROUP BY r.doc_id, r.a, r.b),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS no FROM later),
islands AS (SELECT doc_id, min(no) AS a, max(no) AS b FROM (SELECT doc_id, no, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS g FROM gone) GROUP BY doc_id, g),
told AS (SELECT doc_id, CAST(sum(b - a + 1) AS BIGINT) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS deleted FROM islands GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM raw ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, coalesce(n, 0) AS n_deleted, coalesce(deleted, '') AS deleted,
       sha256(CASE WHEN n IS NULL THEN coalesce(d.text, '') ELSE coalesce(k.text, '') END) AS text_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


#: Kind, expression, group whose length counts, least length: the rules as SQL says them, apart from the operator's own.
_SECRET_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("url_login", r"://[^\s:@/]{1,256}:[^\s:@/]{1,256}@", 0, 0),
)


def _spans_of(no: int, kind: str, expression: str, group: int, length: int) -> str:
    pattern = expression.replace("'", "''")
    least = f"length(regexp_extract(m, '{pattern}', {group})) >= {length}"
    return f"""SELECT doc_id, {no} AS no, '{kind}' AS kind, before + coalesce(lag(upto) OVER d, 0) AS s, before + upto AS e, m FROM (
  SELECT doc_id, i, m, sum(length(p)) OVER d AS before, sum(length(m)) OVER d AS upto FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM documents)) WINDOW d AS (PARTITION BY doc_id ORDER BY i))
  WINDOW d AS (PARTITION BY doc_id ORDER BY i) QUALIFY {least}"""


def _secrets() -> str:
    base = "no < 3"
    count = lambda no, kind: f"count(*) FILTER (WHERE no = {no}) AS n_{kind}"
    return (
        "WITH spans AS (" + " UNION ALL ".join(_spans_of(i, *r) for i, r in enumerate(_SECRET_RULES)) + f"""),
each AS (SELECT doc_id, no, s, kind || ':' || s || ':' || e AS span FROM spans),
told AS (SELECT doc_id, {", ".join(count(i, r[0]) for i, r in enumerate(_SECRET_RULES[:3]))}, string_agg(span, ',' ORDER BY s, no) FILTER (WHERE {base}) AS base, string_agg(span, ',' ORDER BY s, no) AS spans FROM each GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r[0]}, 0) AS n_{r[0]}" for r in _SECRET_RULES[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN told USING (doc_id)"""
    )


SQL = {"op3_secret_scan": _secrets(), "op6_line_dedup": LINES, "op7_decontamination": DECONTAMINATION, "op10_chat_format": CHAT}
