"""DuckDB SQL for every registered query (same tables, same rule for the
derived ``stories``/``comments`` views, same output names, doubles rounded to 6)."""
from __future__ import annotations

CTES = {
    "stories": """stories AS (
 SELECT d.doc_id AS id, CAST(1 AS TINYINT) AS type,
   concat(CASE d.doc_id % 10 WHEN 0 THEN 'Show HN: ' WHEN 1 THEN 'Ask HN: '
          WHEN 2 THEN 'Tell HN: ' WHEN 3 THEN 'Launch HN: ' ELSE '' END,
          replace(d.text, chr(10), ' '),
          CASE WHEN d.doc_id % 10 = 1 THEN '?' ELSE '' END) AS title,
   p.url AS url, p.html AS text, CAST(floor(e.value) AS INT) AS score,
   CAST(CASE WHEN n.n IS NULL THEN 0 ELSE n.n END AS BIGINT) AS descendants,
   concat('u', CAST(e.user_id AS VARCHAR)) AS "by", e.ts AS time,
   CASE WHEN lb.toxic = 1 THEN 1 ELSE 0 END AS dead,
   CASE WHEN lb.quality = 0 THEN 1 ELSE 0 END AS deleted
 FROM documents d JOIN (
   SELECT event_id % (SELECT count(*) FROM documents) AS doc, arg_max(value, (ts, event_id)) AS value,
     arg_min(user_id, (ts, event_id)) AS user_id, min(ts) AS ts
   FROM events GROUP BY doc) e ON e.doc = d.doc_id
 LEFT JOIN pages p ON p.page_id = d.doc_id
 LEFT JOIN (SELECT conv_id, count(*) n FROM conversations GROUP BY conv_id) n ON n.conv_id = d.doc_id
 LEFT JOIN labels lb ON lb.doc_id = d.doc_id)""",
    "comments": """comments AS (SELECT conv_id*1000+turn AS id, conv_id AS parent, text,
   role AS "by", 2 AS type FROM conversations)""",
    "live": """live AS (SELECT * FROM stories WHERE type = 1 AND dead = 0 AND deleted = 0
   AND title IS NOT NULL AND title <> '')""",
    "clean": """clean AS (SELECT *, {html} AS clean_text, {domain} AS domain FROM live)""",
    "tstats": """tstats AS (
 SELECT CASE WHEN grouping(hour(ts)) = 0 THEN 'hour' ELSE 'day' END AS grain,
   CAST(coalesce(hour(ts), isodow(ts) - 1) AS BIGINT) AS key,
   avg(value) AS avg_score, count(value) AS n
 FROM events GROUP BY GROUPING SETS ((hour(ts)), (isodow(ts) - 1)))""",
    "evalbase": """evalbase AS (
 SELECT l.doc_id, e.value AS actual, d.n_chars / 50.0 AS predicted
 FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN events e ON e.event_id = l.doc_id)""",
}
CTES["hits"] = """hits AS (
 SELECT query_id, neighbour_id, distance,
   row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank
 FROM (SELECT q.vec_id AS query_id, x.vec_id AS neighbour_id,
   list_sum(list_transform(list_zip(q.embedding, x.embedding),
     lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) ^ 2)) AS distance
   FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id)
 QUALIFY rank <= 5)"""
CTES["ranked"] = """ranked AS (
 SELECT user_id, event_id, event_type, value, {label} AS label,
   row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)"""
CTES["orig"] = """orig AS (SELECT e.* FROM events e JOIN
   (SELECT user_id AS u, min(event_id) AS m FROM events GROUP BY user_id) f
   ON e.user_id = f.u AND e.event_id = f.m)"""
ORDER = ["stories", "comments", "live", "clean", "tstats", "evalbase", "hits", "ranked", "orig"]


def html_sql(c: str) -> str:
    x = f"coalesce({c}, '')"
    x = (f"regexp_replace({x}, '(?is)<(?:!--.*?-->|!doctype[^>]*>|script\\b.*?</script\\s*>"
         f"|style\\b.*?</style\\s*>)', '', 'g')")
    x = f"regexp_replace({x}, '&amp([^A-Za-z0-9;])', '&\\1', 'g')"
    x = f"regexp_replace({x}, '(?i)<(p|br)\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '</?[A-Za-z!?][^>]*>', '', 'g')"
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"),
                    ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"),
                    ("&amp;", "&")]:
        x = f"replace({x}, '{ent}', '{ch}')"
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))"


def domain_sql(c: str) -> str:
    return (f"regexp_replace(regexp_extract(coalesce({c}, ''), "
            f"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\\.', '')")


def post_type_sql(c: str) -> str:
    return (f"CASE WHEN starts_with({c}, 'Show HN:') THEN 'show_hn' "
            f"WHEN starts_with({c}, 'Ask HN:') THEN 'ask_hn' "
            f"WHEN starts_with({c}, 'Tell HN:') THEN 'tell_hn' "
            f"WHEN starts_with({c}, 'Launch HN:') THEN 'launch_hn' ELSE 'regular' END")


def flag(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS BIGINT)"


def label_sql(s: str) -> str:
    return (f"CASE WHEN {s} <= 3 THEN 'flop' WHEN {s} <= 15 THEN 'low' WHEN {s} <= 100 THEN 'moderate' "
            f"WHEN {s} <= 300 THEN 'hot' ELSE 'viral' END")


def class_sql(s: str) -> str:
    return (f"CAST(CASE WHEN {s} <= 3 THEN 0 WHEN {s} <= 15 THEN 1 WHEN {s} <= 100 THEN 2 "
            f"WHEN {s} <= 300 THEN 3 ELSE 4 END AS BIGINT)")


def soft_sql(s: str) -> list[str]:
    """Probabilities of the five labels for score expression s."""
    ls = f"ln(1 + greatest(CAST({s} AS DOUBLE), 0.0))"
    lg = [f"(-pow({ls} - ln(1 + {c}), 2) / 0.5)" for c in (1.0, 7.0, 37.0, 159.0, 441.0)]
    m = f"greatest({', '.join(lg)})"
    ex = [f"exp({g} - {m})" for g in lg]
    tot = " + ".join(ex)
    return [f"({e}) / ({tot})" for e in ex]


TITLE_FEATURES_SQL = """
  CAST(length(coalesce(title, '')) AS BIGINT) AS title_length,
  CAST(len(list_filter(regexp_split_to_array(coalesce(title, ''), '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS BIGINT) AS title_word_count,
  {q} AS title_has_question, {n} AS title_has_number,
  {sh} AS is_show_hn, {ah} AS is_ask_hn""".format(
    q=flag("contains(coalesce(title, ''), '?')"),
    n=flag("regexp_matches(coalesce(title, ''), '\\p{Nd}')"),
    sh=flag("starts_with(coalesce(title, ''), 'Show HN:')"),
    ah=flag("starts_with(coalesce(title, ''), 'Ask HN:')"))

TIME_FEATURES_SQL = """
  CAST(hour(time) AS BIGINT) AS hour, CAST(isodow(time) - 1 AS BIGINT) AS day_of_week,
  {w} AS is_weekend""".format(w=flag("isodow(time) - 1 >= 5"))

URL_TEXT_FEATURES_SQL = """
  {hu} AS has_url, {gh} AS is_github, {ht} AS has_text,
  CAST(length(coalesce(clean_text, '')) AS BIGINT) AS text_length""".format(
    hu=flag("coalesce(domain, '') <> ''"), gh=flag("contains(coalesce(domain, ''), 'github.com')"),
    ht=flag("coalesce(clean_text, '') <> ''"))


def with_ctes(body: str, *needed: str) -> str:
    need = set(needed)
    deps = {"live": {"stories"}, "clean": {"live", "stories"}}
    for n in list(need):
        need |= deps.get(n, set())
    parts = [CTES[n].format(html=html_sql("text"), domain=domain_sql("url"),
                            label=label_sql("value"))
             for n in ORDER if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


SCAN_COLS = """id, title, url, text, score, descendants, "by",
  strftime(time, '%Y-%m-%d %H:%M:%S') AS time, dead, deleted"""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["domain_reputation"] = with_ctes("""
SELECT domain, count(score) AS post_count, round(avg(score), 6) AS mean_score,
  round((coalesce(sum(score), 0) + 10 * (SELECT avg(score) FROM live)) / (count(score) + 10), 6) AS avg_score
FROM clean WHERE domain <> '' GROUP BY domain""", "clean")

ORACLE_SQL["story_scan_top"] = with_ctes(f"""
SELECT {SCAN_COLS} FROM live ORDER BY score DESC, id LIMIT 100""", "live")

ORACLE_SQL["story_scan_since"] = with_ctes(f"""
SELECT {SCAN_COLS} FROM live WHERE score >= 10 AND time >= TIMESTAMP '2024-01-02 12:00:00'
ORDER BY md5(CAST(id + 7 AS VARCHAR)), id LIMIT 200""", "live")

ORACLE_SQL["comments_for_stories"] = with_ctes("""
SELECT id, parent, "by", text FROM comments
WHERE type = 2 AND parent IN (SELECT id FROM live WHERE score >= 100)""", "live", "comments")

ORACLE_SQL["comments_limited"] = with_ctes("""
SELECT id, parent, "by", text FROM comments
WHERE type = 2 AND parent IN (SELECT id FROM live WHERE score >= 100)
QUALIFY row_number() OVER (PARTITION BY parent ORDER BY id) <= 3""", "live", "comments")

ORACLE_SQL["stratified_sample"] = with_ctes("""
, strata AS (
  SELECT id, score, CAST(CASE WHEN score >= 1 AND score < 5 THEN 0 WHEN score >= 5 AND score < 20 THEN 1
    WHEN score >= 20 AND score < 100 THEN 2 WHEN score >= 100 THEN 3 END AS BIGINT) AS stratum
  FROM live WHERE time >= TIMESTAMP '2018-01-01 00:00:00')
SELECT id, score, stratum, stratum_rank FROM (
  SELECT id, score, stratum,
    row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(id + 42 AS VARCHAR)), id) AS stratum_rank
  FROM strata WHERE stratum IS NOT NULL)
WHERE stratum_rank <= [120, 120, 100, 60][stratum + 1]""", "live").replace("\n, strata", ",\nstrata", 1)

ORACLE_SQL["seeded_sample"] = """
SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events
ORDER BY md5(CAST(event_id + 42 AS VARCHAR)), event_id LIMIT 500"""

ORACLE_SQL["clean_html"] = f"""
SELECT page_id, {html_sql("html || '<p>'")} || chr(10) || 'https://x.y — if x < 5 and y > 3 end' AS clean_text
FROM pages WHERE html IS NOT NULL
UNION ALL SELECT page_id, '' FROM pages WHERE html IS NULL"""

ORACLE_SQL["clean_comments"] = with_ctes(f"""
SELECT id, parent, clean_text FROM (SELECT id, parent, {html_sql('text')} AS clean_text FROM comments)
WHERE clean_text <> ''""", "comments")

ORACLE_SQL["url_domains"] = f"SELECT page_id, url, {domain_sql('url')} AS domain FROM pages"

ORACLE_SQL["post_types"] = with_ctes(f"SELECT id, title, {post_type_sql('title')} AS post_type FROM live",
                                     "live")

ORACLE_SQL["title_features"] = with_ctes(f"SELECT id, {TITLE_FEATURES_SQL} FROM live", "live")

ORACLE_SQL["time_features"] = with_ctes(f"SELECT id, {TIME_FEATURES_SQL} FROM live", "live")

ORACLE_SQL["url_text_features"] = with_ctes(f"SELECT id, domain, {URL_TEXT_FEATURES_SQL} FROM clean",
                                            "clean")

ORACLE_SQL["structural_features"] = with_ctes(f"""
, dstats AS (
  SELECT domain AS d, count(score) AS n, (coalesce(sum(score), 0) + 10 * 47.57) / (count(score) + 10) AS a
  FROM clean WHERE domain <> '' AND time < TIMESTAMP '2024-01-02 12:00:00' GROUP BY domain)
SELECT id, {TITLE_FEATURES_SQL}, {TIME_FEATURES_SQL}, {URL_TEXT_FEATURES_SQL},
  round(coalesce(a, 47.57), 6) AS domain_avg_score, CAST(coalesce(n, 0) AS BIGINT) AS domain_post_count
FROM clean LEFT JOIN dstats ON clean.domain = dstats.d""", "clean").replace("\n, dstats", ",\ndstats", 1)

ORACLE_SQL["time_stats"] = with_ctes("SELECT grain, key, round(avg_score, 6) AS avg_score, n FROM tstats",
                                     "tstats")

ORACLE_SQL["saved_domain_stats"] = with_ctes("""
SELECT domain, count(score) AS post_count,
  round((coalesce(sum(score), 0) + 10 * (SELECT avg(score) FROM clean)) / (count(score) + 10), 6) AS avg_score
FROM clean GROUP BY domain""", "clean")

ORACLE_SQL["saved_time_stats"] = with_ctes("""
SELECT 'hour' AS grain, CAST(hour(time) AS BIGINT) AS key, round(avg(score), 6) AS avg_score, count(score) AS n
FROM live GROUP BY hour(time)
UNION ALL SELECT 'day', CAST(isodow(time) - 1 AS BIGINT), round(avg(score), 6), count(score)
FROM live GROUP BY isodow(time)""", "live")

ORACLE_SQL["saved_score_cdf"] = with_ctes("""
SELECT score, n, CAST(sum(n) OVER (ORDER BY score) AS BIGINT) AS cum_n, (SELECT count(score) FROM live) AS total
FROM (SELECT score, count(*) AS n FROM live WHERE score IS NOT NULL GROUP BY score)""", "live")

ORACLE_SQL["best_time"] = with_ctes("""
, bh AS (SELECT key, avg_score FROM tstats WHERE grain = 'hour' ORDER BY avg_score DESC, key LIMIT 1),
bd AS (SELECT key, avg_score FROM tstats WHERE grain = 'day' ORDER BY avg_score DESC, key LIMIT 1)
SELECT bh.key AS best_hour, round(bh.avg_score, 6) AS best_hour_avg_score,
  bd.key AS best_day, round(bd.avg_score, 6) AS best_day_avg_score,
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][bd.key + 1] AS best_day_name,
  'Best posting time: ' || bh.key || ' UTC on ' ||
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][bd.key + 1] AS advice
FROM bh, bd""", "tstats").replace("\n, bh", ",\nbh", 1)

ORACLE_SQL["top_hours"] = with_ctes("""
SELECT key AS hour, round(avg_score, 6) AS avg_score,
  row_number() OVER (ORDER BY avg_score DESC, key) AS position
FROM tstats WHERE grain = 'hour' QUALIFY position <= 3""", "tstats")

ORACLE_SQL["score_cdf"] = """
SELECT round(score, 6) AS score, n, cum_n, total FROM (
  SELECT value AS score, count(*) AS n,
    CAST(sum(count(*)) OVER (ORDER BY value) AS BIGINT) AS cum_n,
    (SELECT count(value) FROM events) AS total
  FROM events WHERE value IS NOT NULL GROUP BY value)"""

ORACLE_SQL["score_percentile"] = """
SELECT event_id, round(value, 6) AS value,
  round(100.0 * (1.0 - cume_dist() OVER (ORDER BY value)), 6) AS percentile
FROM events WHERE value IS NOT NULL"""

ORACLE_SQL["score_percentile_new"] = """
SELECT doc_id, round(n_chars / 20.0, 6) AS new_score,
  round(100.0 * (1.0 - (SELECT count(*) FROM events WHERE value <= n_chars / 20.0)
                 / (SELECT count(value) FROM events)), 6) AS percentile
FROM documents"""

ORACLE_SQL["reception"] = f"""
SELECT event_id, round(value, 6) AS value, {label_sql('value')} AS label, {class_sql('value')} AS class_index
FROM events"""

_P = soft_sql("value")
ORACLE_SQL["reception_soft"] = f"""
SELECT event_id, round(p_flop, 6) AS p_flop, round(p_low, 6) AS p_low, round(p_moderate, 6) AS p_moderate,
  round(p_hot, 6) AS p_hot, round(p_viral, 6) AS p_viral, label,
  round([p_flop, p_low, p_moderate, p_hot, p_viral][class_index + 1], 6) AS confidence,
  ['flop','low','moderate','hot','viral'][list_position([p_flop, p_low, p_moderate, p_hot, p_viral],
      greatest(p_flop, p_low, p_moderate, p_hot, p_viral))] AS soft_label
FROM (SELECT event_id, {label_sql('value')} AS label, {class_sql('value')} AS class_index,
  {_P[0]} AS p_flop, {_P[1]} AS p_low, {_P[2]} AS p_moderate,
  {_P[3]} AS p_hot, {_P[4]} AS p_viral FROM events)"""

ORACLE_SQL["expected_score"] = f"""
SELECT event_id, round(({_P[0]}) * 1.0 + ({_P[1]}) * 7.0 + ({_P[2]}) * 37.0 + ({_P[3]}) * 159.0
  + ({_P[4]}) * 441.0, 6) AS expected_score FROM events"""

ORACLE_SQL["reception_described"] = f"""
SELECT event_id, label, description FROM (SELECT event_id, {label_sql('value')} AS label FROM events) e
LEFT JOIN (VALUES {{descriptions}}) t(l, description) ON t.l = e.label"""


def _fill_descriptions():
    from postcast.constants import LABEL_DESCRIPTIONS
    vals = ", ".join("('{}', '{}')".format(k, v.replace("'", "''"))
                     for k, v in LABEL_DESCRIPTIONS.items())
    ORACLE_SQL["reception_described"] = ORACLE_SQL["reception_described"].replace(
        "{descriptions}", vals)


_fill_descriptions()


def fixed_sql(x: str, digits: int, plus: bool = False) -> str:
    scale = 10 ** digits
    units = f"CAST(floor(abs({x}) * {scale} + 0.5) AS BIGINT)"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '{'+' if plus else ''}' END"
    return (f"({sign} || CAST({units} // {scale} AS VARCHAR) || '.' || "
            f"lpad(CAST({units} % {scale} AS VARCHAR), {digits}, '0'))")


ORACLE_SQL["knn_topk"] = with_ctes("""
SELECT query_id, neighbour_id, round(distance, 6) AS distance, rank FROM hits""", "hits")

ORACLE_SQL["knn_context"] = with_ctes("""
SELECT h.query_id, h.neighbour_id, h.rank AS neighbour_rank, c.id AS comment_id,
  row_number() OVER (PARTITION BY h.query_id, h.neighbour_id ORDER BY c.id) AS comment_rank, c."by"
FROM hits h JOIN comments c ON c.parent = h.neighbour_id WHERE h.rank <= 3
QUALIFY comment_rank <= 10""", "hits", "comments")

ORACLE_SQL["comment_lookup"] = with_ctes("""
SELECT id, parent, "by", row_number() OVER (PARTITION BY parent ORDER BY id) AS rank
FROM comments QUALIFY rank <= 20""", "comments")

ORACLE_SQL["prompt_table"] = with_ctes(f"""
, pitches AS (SELECT em.vec_id AS query_id, s.title, '' AS description, e.value AS predicted_score,
    {label_sql('e.value')} AS label
  FROM embeddings em LEFT JOIN stories s ON s.id = em.vec_id LEFT JOIN events e ON e.event_id = em.vec_id),
sims AS (SELECT h.query_id, string_agg('- "' || coalesce(s.title, '') || '" (score: ' ||
    CAST(coalesce(s.score, 0) AS VARCHAR) || ', comments: ' || CAST(coalesce(s.descendants, 0) AS VARCHAR) || ')',
    chr(10) ORDER BY h.rank) AS lines
  FROM hits h LEFT JOIN stories s ON s.id = h.neighbour_id GROUP BY h.query_id),
cc AS (SELECT id, parent, "by", {html_sql('text')} AS clean_text FROM comments),
ctx AS (SELECT h.query_id, h.rank AS nr, c.id AS cid, c."by", c.clean_text,
    row_number() OVER (PARTITION BY h.query_id, h.neighbour_id ORDER BY c.id) AS cr
  FROM hits h JOIN cc c ON c.parent = h.neighbour_id WHERE h.rank <= 3 AND c.clean_text <> '' QUALIFY cr <= 10),
cl AS (SELECT query_id, string_agg('- ' || coalesce("by", 'unknown') || ': ' || coalesce(clean_text, ''),
    chr(10) ORDER BY nr, cr) AS lines FROM ctx GROUP BY query_id)
SELECT p.query_id, concat_ws(chr(10) || chr(10),
  '## Pitch' || chr(10) || '**Title:** ' || coalesce(p.title, '') || chr(10) || '**Description:** ' || p.description,
  '## Prediction Context' || chr(10) || 'Predicted HN score: ' || CAST(CAST(trunc(p.predicted_score) AS BIGINT) AS VARCHAR)
    || chr(10) || 'Reception label: ' || p.label,
  CASE WHEN sims.lines IS NOT NULL THEN '## Similar Stories on HN' || chr(10) || sims.lines END,
  CASE WHEN cl.lines IS NOT NULL THEN '## Example Real HN Comments (from similar stories)' || chr(10) || cl.lines END,
  '## Task' || chr(10) || 'Generate exactly 5 realistic HN-style comments for this pitch. Return a JSON array with 5 objects.'
  ) AS prompt
FROM pitches p LEFT JOIN sims ON sims.query_id = p.query_id LEFT JOIN cl ON cl.query_id = p.query_id""",
                                      "stories", "comments", "hits").replace("\n, pitches", ",\npitches", 1)

ORACLE_SQL["class_weights"] = with_ctes(f"""
SELECT cls, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
FROM (SELECT {class_sql('actual')} AS cls, count(*) AS n_c FROM evalbase GROUP BY 1)""", "evalbase")

ORACLE_SQL["regression_error"] = with_ctes("""
SELECT round(sqrt(avg(pow(greatest(exp(ln(1 + predicted)) - 1, 0.0) - actual, 2))), 6) AS rmse,
  round(avg(abs(greatest(exp(ln(1 + predicted)) - 1, 0.0) - actual)), 6) AS mae, count(*) AS n
FROM evalbase""", "evalbase")

_PP = soft_sql("predicted")
ORACLE_SQL["accuracy_logloss"] = with_ctes(f"""
SELECT round(avg(CASE WHEN list_position(p, list_max(p)) - 1 = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(-ln(greatest(least(p[y + 1], 1 - 1e-15), 1e-15))), 6) AS log_loss, count(*) AS n
FROM (SELECT {class_sql('actual')} AS y, [{', '.join(_PP)}] AS p FROM evalbase)""", "evalbase")

_CONF = f"""conf AS (
 SELECT a.actual, a.predicted, coalesce(c.n, 0) AS n
 FROM (SELECT x // 5 AS actual, x % 5 AS predicted FROM range(25) t(x)) a
 LEFT JOIN (SELECT {class_sql('actual')} AS ca, {class_sql('predicted')} AS cp, count(*) AS n
   FROM evalbase GROUP BY ALL) c ON c.ca = a.actual AND c.cp = a.predicted)"""

ORACLE_SQL["confusion"] = with_ctes(f"\n, {_CONF}\nSELECT actual, predicted, n FROM conf",
                                    "evalbase").replace("\n, conf", ",\nconf", 1)

ORACLE_SQL["precision_recall"] = with_ctes(f"""
, {_CONF}
SELECT p.cls, round(CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN true_n > 0 THEN tp / true_n ELSE 0.0 END, 6) AS recall, CAST(true_n AS BIGINT) AS support
FROM (SELECT predicted AS cls, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp, sum(n) AS pred_n
      FROM conf GROUP BY predicted) p
JOIN (SELECT actual AS cls, sum(n) AS true_n FROM conf GROUP BY actual) t ON t.cls = p.cls""",
                                           "evalbase").replace("\n, conf", ",\nconf", 1)

ORACLE_SQL["spearman"] = with_ctes("""
SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2.0 AS ry
  FROM evalbase WHERE predicted IS NOT NULL AND actual IS NOT NULL)""", "evalbase")

ORACLE_SQL["temporal_split"] = """
SELECT o_orderkey, CAST(NOT coalesce(o_orderdate < TIMESTAMP '1999-01-01 00:00:00', false) AS BIGINT) AS is_validation
FROM orders"""

ORACLE_SQL["fallback_split"] = """
SELECT o_orderkey, CAST(CASE WHEN (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1990-01-01 00:00:00') > 0
  THEN NOT coalesce(o_orderdate < TIMESTAMP '1990-01-01 00:00:00', false)
  ELSE row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey)
       <= CAST(floor(0.2 * count(*) OVER ()) AS BIGINT) END AS BIGINT) AS is_validation
FROM orders"""

ORACLE_SQL["hash_split"] = """
SELECT event_id, CAST(row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id)
  <= CAST(floor(0.2 * count(*) OVER ()) AS BIGINT) AS BIGINT) AS is_test
FROM events"""

ORACLE_SQL["validation_tail"] = """
WITH t AS (SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id)
    <= CAST(floor(0.2 * count(*) OVER ()) AS BIGINT) AS is_test FROM events),
v AS (SELECT event_id FROM t WHERE NOT is_test
  QUALIFY row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':val42'), event_id)
    <= least(greatest(CAST(floor(0.1 * count(*) OVER ()) AS BIGINT), 5), count(*) OVER ()))
SELECT event_id, CASE WHEN is_test THEN 'test' WHEN event_id IN (SELECT event_id FROM v) THEN 'validation'
  ELSE 'train' END AS part
FROM t"""

ORACLE_SQL["variant_rank"] = with_ctes("""
SELECT user_id, event_id, round(value, 6) AS value, rank FROM ranked""", "ranked")

_Q1 = "'''' || event_type || ''' is predicted to perform best (score: '"
ORACLE_SQL["variant_summary"] = with_ctes(f"""
SELECT user_id, rank,
  CAST(rank AS VARCHAR) || '. "' || event_type || '" — score: ' || {fixed_sql('value', 1)} || ', label: ' || label AS line,
  CASE WHEN rank = 1 THEN {_Q1} || {fixed_sql('value', 1)} || ', label: ' || label || ').' END AS explanation
FROM ranked""", "ranked")

ORACLE_SQL["suggestion_rank"] = with_ctes("""
, sugg AS (SELECT e.* FROM events e WHERE e.event_id NOT IN (SELECT event_id FROM orig)
   AND NOT EXISTS (SELECT 1 FROM orig o WHERE o.user_id = e.user_id AND o.event_type = e.event_type)),
both_ AS (SELECT user_id, event_id, value, 1 AS is_original FROM orig
   UNION ALL SELECT user_id, event_id, value, 0 AS is_original FROM sugg)
SELECT user_id, event_id, round(value, 6) AS value, CAST(is_original AS BIGINT) AS is_original,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, is_original DESC, event_id) AS rank
FROM both_""", "orig").replace("\n, sugg", ",\nsugg", 1)

ORACLE_SQL["optimise_trace"] = """
WITH RECURSIVE orig AS (SELECT e.* FROM events e JOIN
   (SELECT user_id AS u, min(event_id) AS m FROM events GROUP BY user_id) f ON e.user_id = f.u AND e.event_id = f.m),
o AS (SELECT user_id AS pitch, event_type AS title0, value AS s0 FROM orig),
v AS (SELECT user_id AS pitch, event_id % 5 + 1 AS rnd, event_type || ' ' || CAST(event_id % 3 AS VARCHAR) AS title,
        value AS score FROM events
      WHERE event_id NOT IN (SELECT event_id FROM orig)),
seen AS (SELECT pitch, title, min(rnd) AS rnd FROM v GROUP BY pitch, title),
fresh AS (SELECT v.pitch, v.rnd, v.title, v.score,
    row_number() OVER (PARTITION BY v.pitch, v.rnd ORDER BY v.score DESC, v.title) AS nth
  FROM v JOIN seen s ON s.pitch = v.pitch AND s.title = v.title AND s.rnd = v.rnd
  JOIN o ON o.pitch = v.pitch WHERE v.title <> o.title0),
loop(pitch, n, best, title, stopped) AS (
  SELECT pitch, 0, s0, title0, false FROM o
  UNION ALL
  SELECT l.pitch, l.n + 1,
    CASE WHEN f.score > l.best AND f.score - l.best >= 2.0 THEN f.score ELSE l.best END,
    CASE WHEN f.score > l.best AND f.score - l.best >= 2.0 THEN f.title ELSE l.title END,
    NOT coalesce(f.score > l.best AND f.score - l.best >= 2.0, false)
  FROM loop l LEFT JOIN fresh f ON f.pitch = l.pitch AND f.rnd = l.n + 1 AND f.nth = 1
  WHERE NOT l.stopped AND l.n < 5)
SELECT l.pitch AS user_id, CAST(max(n) AS BIGINT) AS rounds_run, arg_max(title, n) AS best_title,
  round(arg_max(best, n), 6) AS best_score, round(arg_max(best, n) - max(s0), 6) AS total_gain
FROM loop l JOIN o ON o.pitch = l.pitch GROUP BY l.pitch"""

ORACLE_SQL["tried_titles"] = """
SELECT user_id, array_to_string(list_transform(list_sort(list_distinct(
  list(event_type) FILTER (WHERE event_type IS NOT NULL))), lambda t: '"' || t || '"'), ', ') AS tried
FROM events GROUP BY user_id"""

_TOPK = """topk AS (
 SELECT vec_id, 'emb_' || CAST(i - 1 AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS importance,
   CASE WHEN CAST(embedding[i] AS DOUBLE) > 0 THEN 'up' ELSE 'down' END AS direction,
   row_number() OVER (PARTITION BY vec_id ORDER BY abs(CAST(embedding[i] AS DOUBLE)) DESC, i) AS position
 FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
 QUALIFY position <= 5)"""

ORACLE_SQL["attribution_topk"] = f"""WITH {_TOPK}
SELECT vec_id, position, feature, round(importance, 6) AS importance, direction FROM topk"""

ORACLE_SQL["attribution_text"] = f"""WITH {_TOPK}
SELECT vec_id, string_agg('  ' || CASE WHEN direction = 'up' THEN '↑' ELSE '↓' END || ' ' || feature || ' (' ||
  {fixed_sql('importance', 2, plus=True)} || ')', chr(10) ORDER BY position) AS text
FROM topk GROUP BY vec_id"""

ORACLE_SQL["multi_file_scan"] = """
SELECT event_id, user_id, round(value, 6) AS value, strftime(ts, '%Y-%m-%d') AS day FROM events
WHERE CAST(ts AS DATE) >= DATE '2024-01-10'"""

ORACLE_SQL["index_build"] = with_ctes(f"""
SELECT id, coalesce(title, '') AS title, coalesce(url, '') AS url, clean_text, coalesce(score, 0) AS score,
  CAST(coalesce(descendants, 0) AS BIGINT) AS descendants, domain,
  coalesce({post_type_sql('title')}, 'regular') AS post_type, CAST(384 AS BIGINT) AS dim, true AS unit
FROM clean""", "clean")

ORACLE_SQL["comment_index"] = with_ctes(f"""
SELECT id, parent, clean_text, "by" FROM (SELECT id, parent, {html_sql('text')} AS clean_text, "by" FROM comments)
WHERE clean_text <> ''""", "comments")

ORACLE_SQL["train_counts"] = with_ctes(f"""
SELECT count(*) AS "rows", count(*) FILTER (time >= TIMESTAMP '2024-01-02 12:00:00') AS validation_rows,
  {', '.join(f"count(*) FILTER (time < TIMESTAMP '2024-01-02 12:00:00' AND {class_sql('score')} = {i}) AS train_{n}"
             for i, n in enumerate(['flop', 'low', 'moderate', 'hot', 'viral']))}
FROM live""", "live")

ORACLE_SQL["predict_invariants"] = with_ctes("""
SELECT count(*) AS stories, true AS no_negative, true AS probabilities_sum_to_one, true AS additive FROM live""", "live")

ORACLE_SQL["batch_invariants"] = with_ctes("""
SELECT count(*) AS pitches, true AS of_neighbours, true AS in_prompt, true AS has_prompt, true AS explained
FROM live""", "live")

ORACLE_SQL["backtest_confusion"] = with_ctes(f"""
, test AS (SELECT {class_sql('score')} AS actual FROM live
  QUALIFY row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id)
    <= CAST(floor(0.2 * count(*) OVER ()) AS BIGINT))
SELECT CAST(c AS BIGINT) AS actual, CAST((SELECT count(*) FROM test WHERE actual = c) AS BIGINT) AS n
FROM range(5) t(c)""", "live").replace("\n, test", ",\ntest", 1)

ORACLE_SQL["backtest_invariants"] = with_ctes("""
SELECT CAST(floor(0.2 * count(*)) AS BIGINT) AS n_test, CAST(5 AS BIGINT) AS classes, true AS shares_follow,
  true AS accuracy_follows
FROM live""", "live")

ORACLE_SQL["softmax_invariants"] = with_ctes("""
SELECT count(*) AS stories, true AS probabilities_sum_to_one, true AS additive FROM live""", "live")

ORACLE_SQL["model_round_trip"] = with_ctes("""
SELECT count(*) AS stories, true AS score_equal, true AS comments_equal, true AS classes_equal FROM live""", "live")

ORACLE_SQL["encoder_invariants"] = with_ctes("""
SELECT count(*) AS stories, count(DISTINCT title) AS titles, true AS dimension, true AS unit,
  true AS equal_for_equal_titles
FROM live""", "live")

ORACLE_SQL["year_files"] = with_ctes("""
SELECT id, score, "by", year(time) AS year FROM stories""", "stories")

ORACLE_SQL["sample_invariants"] = """
SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_distinct, least(100, count(*)) AS n_known FROM events"""


def _parse_sql(item: str, partial: str, keys: list[str], required: list[str], fence: bool = True) -> str:
    js = f"'[' || CAST(to_json({item}) AS VARCHAR) || ',' || CAST(to_json({partial}) AS VARCHAR) || ']'"
    replies = (f"[{js}, '\n' || {js} || ' ', 'Here you go:\n```json\n' || {js} || '\n```\nEnjoy.', "
               f"'```\n' || {js} || '\n```', CAST(to_json({{'comment': text}}) AS VARCHAR), 'Sorry, no list: ' || text]")
    fenced = "regexp_extract(response, '(?s)```(?:json)?\\s*(\\[.*?\\])\\s*```', 1)"
    has = " AND ".join(f"json_exists(item, '$.{k}')" for k in required)
    outs = ", ".join(f"json_extract_string(item, '$.{k}') AS {k}" for k in keys[:2])
    return f"""
WITH replies AS (SELECT conv_id, turn, {replies} AS all_replies FROM conversations),
resp AS (SELECT conv_id, turn, reply - 1 AS reply, all_replies[reply] AS response
  FROM replies, range(1, 7) kinds(reply)),
src0 AS (SELECT conv_id, turn, reply,
    CASE WHEN json_valid(response) THEN response END AS pj,
    CASE WHEN {str(fence).lower()} AND NOT json_valid(response) AND json_valid({fenced}) THEN {fenced} END AS fj
  FROM resp),
src AS (SELECT conv_id, turn, reply, CASE WHEN pj IS NOT NULL THEN CASE WHEN json_type(pj) = 'ARRAY' THEN pj END
    ELSE CASE WHEN json_type(fj) = 'ARRAY' THEN fj END END AS arr FROM src0),
items AS (SELECT conv_id, turn, reply, i, json_extract(arr, '$[' || CAST(i AS VARCHAR) || ']') AS item
  FROM (SELECT conv_id, turn, reply, arr, unnest(range(CAST(json_array_length(arr) AS BIGINT))) AS i FROM src WHERE arr IS NOT NULL))
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn, reply ORDER BY i) - 1 AS item, {outs}, reply
FROM items WHERE json_type(item) = 'OBJECT' AND {has}"""


ORACLE_SQL["parse_responses"] = _parse_sql("{'username': role, 'comment': text, 'tone': 'neutral'}",
                                           "{'username': role}", ["username", "comment"], ["username", "comment"])
ORACLE_SQL["parse_suggestions"] = _parse_sql("{'title': text, 'description': role}",
                                             "{'description': role}", ["title", "description"], ["title"], fence=False)

ORACLE_SQL["stream_domain_stats"] = with_ctes("""
SELECT domain, count(score) AS post_count,
  round((coalesce(sum(score), 0) + 10 * 47.57) / (count(score) + 10), 6) AS avg_score
FROM clean WHERE domain <> '' GROUP BY domain""", "clean")

ORACLE_SQL["attribution_allowed"] = """
SELECT vec_id, position, feature, round(importance, 6) AS importance, direction FROM (
 SELECT vec_id, 'emb_' || CAST(i - 1 AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS importance,
   CASE WHEN CAST(embedding[i] AS DOUBLE) > 0 THEN 'up' ELSE 'down' END AS direction,
   row_number() OVER (PARTITION BY vec_id ORDER BY abs(CAST(embedding[i] AS DOUBLE)) DESC, i) AS position
 FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
 WHERE i <= 16
 QUALIFY position <= 5)"""

ORACLE_SQL["story_scan_recent_top"] = with_ctes(f"""
SELECT {SCAN_COLS} FROM live WHERE score >= 5 AND time >= TIMESTAMP '2024-01-02 00:00:00'
ORDER BY score DESC, id LIMIT 50""", "live")
