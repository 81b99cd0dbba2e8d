"""DuckDB SQL with the results of the queries that SQL can express."""
from __future__ import annotations

import re

from postcast.llm.chat import CONTROLS, END, SEP, START
from postcast.llm.quality_rules import STOP_WORDS
from postcast.llm.url_filters import CANONICAL, HREF, REFRESH, REFRESH_URL


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PARTS = r"'(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)'"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), {_PARTS}, 1), {_UPPER}, {_LOWER})"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), {_PARTS}, 2)"


def _key(url: str) -> str:
    return (f"CASE WHEN contains({url}, '://') THEN {_host(url)} || {_path(url)} || "
            f"regexp_extract({url}, {_PARTS}, 3) END")


OP3 = f"""
WITH RECURSIVE rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
links AS (
  SELECT url, regexp_extract(regexp_extract(html, {_quote(CANONICAL)}, 0), {_quote(HREF)}, 1) AS target FROM pages
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, {_quote(REFRESH)}, 0), {_quote(REFRESH_URL)}, 1) FROM pages),
pairs AS (SELECT {_key('url')} AS a, {_key('target')} AS b FROM links WHERE contains(target, '://')),
edges AS (SELECT a, b FROM pairs WHERE a IS NOT NULL AND a <> b
          UNION SELECT b, a FROM pairs WHERE a IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
nodes AS (SELECT node, component, {_host("('//://' || node)")} AS host, {_path("('//://' || node)")} AS path FROM comp),
node_rule AS (
  SELECT node, component, arg_max(action, length(h || p)) AS action
  FROM nodes LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY node, component),
decided AS (SELECT component, CASE WHEN bool_or(action = 'allow') THEN 'allow'
              WHEN bool_or(action = 'block') THEN 'block' ELSE 'allow' END AS verdict
            FROM node_rule GROUP BY component),
page AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_key('url')} AS k FROM pages),
page_rule AS (
  SELECT page_id, host, path, k, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM page LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path, k)
SELECT page_id, host, path, rule, coalesce(r.action, d.verdict, 'allow') AS verdict
FROM page_rule r LEFT JOIN comp c ON c.node = r.k LEFT JOIN decided d ON d.component = c.component
"""

# A line goes where it occurred before; the windows of 1, 2, 4, ... lines by their content.
OP8 = rf"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM (
    SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS (SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS j
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
docs AS (SELECT doc_id, list(line ORDER BY j) AS ls FROM s GROUP BY doc_id),
sizes AS (SELECT doc_id, ls, unnest([CAST(2 ** t AS BIGINT) FOR t IN range(CAST(floor(log2(len(ls))) AS BIGINT) + 1)]) AS m
          FROM docs),
windows AS (SELECT doc_id, m, ls, unnest(range(len(ls) - m + 1)) AS j FROM sizes),
ranked AS (SELECT doc_id, m, row_number() OVER (PARTITION BY m, ls[j + 1:j + m] ORDER BY doc_id, j) AS nth FROM windows),
longest AS (SELECT doc_id, max(m) AS longest FROM ranked WHERE nth > 1 GROUP BY doc_id),
flagged AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, j) > 1 AS del FROM s),
tally AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (del) AS n_deleted FROM flagged GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.n) AS body
         FROM l LEFT JOIN flagged f ON f.doc_id = l.doc_id AND f.n = l.n WHERE NOT coalesce(f.del, false) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest,
  CASE WHEN coalesce(n_deleted, 0) = 0 THEN d.text WHEN n_deleted = n_lines THEN '' ELSE body END AS text
FROM documents d LEFT JOIN tally USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

_CONTROLS = "|".join([r"\\"] + [re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)])
OP6 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
        sum({len(START + SEP + END)} + length(role) + length(text)
          + len(regexp_extract_all(role, {_quote(_CONTROLS)})) + len(regexp_extract_all(text, {_quote(_CONTROLS)}))) AS chars
      FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
  CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS five
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len([x FOR x IN ws IF rtrim(lower(x), '.,;:!?') IN ({', '.join(_quote(s) for s in STOP_WORDS)})]) AS n_stop,
        len([x FOR x IN ls IF ends_with(x, '...') OR ends_with(x, '…')]) AS n_ellipsis,
        len([x FOR x IN ls IF regexp_matches(x, '^[\x20\x09]*[-•‣*]')]) AS n_bullet
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15
  AND n_symbols / greatest(n_words, 1) <= 0.3 AND n_exclamations / greatest(n_words, 1) <= 0.5
  AND (n_stop + 1) / greatest(n_words, 1) >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5
  AND n_ellipsis / greatest(n_lines, 1) <= 0.5 AND n_bullet / greatest(n_lines, 1) <= 0.9 AS kept
FROM b
"""

# All pairs of anchors and rows.
OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS nth
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
        AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE nth <= 5
"""

ORACLE_SQL = {"op3_url_filters": OP3, "op6_chat_formatting": OP6, "op8_line_dedup": OP8,
              "op10_quality_rules": OP10, "op12_hard_negatives": OP12}
