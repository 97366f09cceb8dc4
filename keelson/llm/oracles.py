"""SQL for the queries that SQL can express; the values of the contracts are written out."""

from __future__ import annotations

# Escaping adds a backslash before every backslash, every # behind a #, and in every end mark.
_ADDED = """(len(t) - len(replace(t, chr(92), ''))
    + len(regexp_replace(t, '[^#]', '', 'g')) - len(regexp_extract_all(t, '#+'))
    + (len(t) - len(replace(t, '</turn>', ''))) // 7)"""

CHAT_FORMAT = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(len(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' ELSE '### Assistant: ' END)
    + len(t) + {_ADDED} + len('</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

# The given pages hold one article element; its text is found here by patterns alone.
HTML_TEXT = """
WITH bodies AS (
  SELECT page_id, url, regexp_split_to_array(
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)[^>]*>') AS parts
  FROM pages),
lines AS (
  SELECT page_id, url, [trim(regexp_replace(
      replace(replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'),
      '[ \\t\\n\\r]+', ' ', 'g')) for part in parts] AS lines
  FROM bodies)
SELECT page_id, url, array_to_string([line for line in lines if line <> ''], chr(10)) AS text,
  CAST(len(array_to_string([line for line in lines if line <> ''], chr(10))) AS BIGINT) AS n_chars
FROM lines"""

NEAR_DUPLICATES = """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS shingle
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id,
  d.doc_id = min(r.other) AS kept
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id"""

# Links are read in their plainest spelling only: absolute targets, quoted, in the usual order.
URL_FILTER = """
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
links AS (
  SELECT DISTINCT regexp_replace(url, '#.*$', '') AS a, regexp_replace(target, '#.*$', '') AS b FROM (
    SELECT url, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]*)"', 1)
      || regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]*; ?url=([^"]*)"', 1)) AS target
    FROM pages)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, l.b FROM reached r JOIN edges l ON l.a = r.b),
nodes AS (
  SELECT a, b, regexp_extract(b, '^.*?://([^/?#]*)', 1) AS host,
    regexp_extract(b, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM reached),
rules(rule_host, rule_path, allow) AS (VALUES ('com', '/', true), ('example.com', '/en/', false),
  ('www.example.com', '/en/', true), ('net', '/es/', false), ('net', '/fr/', false)),
own AS (
  SELECT page_id, url, host, path, max(struct_pack(n := len(rule_host || rule_path), allow, rule := rule_host || rule_path)) AS r
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL),
aliases AS (
  SELECT a, bool_or(r.allow) AS allow FROM (
    SELECT a, b, max(struct_pack(n := len(rule_host || rule_path), allow)) AS r
    FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY ALL) GROUP BY a)
SELECT page_id, host, path, r.rule AS rule,
  CASE WHEN coalesce(r.allow, x.allow, true) THEN 'allow' ELSE 'block' END AS verdict
FROM own LEFT JOIN aliases x ON x.a = regexp_replace(url, '#.*$', '')"""

FILTER_AUDIT = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    [w for w in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w
  FROM documents),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
filters(f, flag) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM filters a JOIN filters b ON b.f <> a.f JOIN filters c ON c.f NOT IN (a.f, b.f)
    JOIN filters d ON d.f NOT IN (a.f, b.f, c.f) JOIN filters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, f, flag, (
    SELECT coalesce(sum(g.flag), 0) FROM filters g WHERE contains(left(filter_order, step - 1), g.f)) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) JOIN filters ON f = filter_order[step]),
counts AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & CAST(before + flag AS INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & flag <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & CAST(before AS INT) <> 0 AND mask & flag <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = flag THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & flag <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & flag <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counts"""

# Forward over the rows: of each state the least (cost, audit, repaired turns); first inserts, then the row.
TURN_REPAIR = """
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t, list_reduce(
    [4294967295] || [CAST(ord(c) AS BIGINT) for c in string_split(
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
    lambda a, b: list_reduce([xor(a, b)] || range(8),
      lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS c
  FROM conversations),
hit AS (
  SELECT conv_id, turn, xor(c, 4294967295) % 20 AS d, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t
  FROM drawn),
damaged AS (
  SELECT conv_id, turn, role, t FROM hit WHERE d <> 0
  UNION ALL SELECT conv_id, turn, role, t FROM hit WHERE d = 3),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS c, rtrim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t)),
faults AS (
  SELECT *, CASE WHEN stripped = '' THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, t ORDER BY i) > 1 THEN 'd'
      WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault,
    coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed),
walk(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {'c': 0, 'l': '', 'r': CAST([] AS VARCHAR[])},
    {'c': 1000000, 'l': '', 'r': CAST([] AS VARCHAR[])}, {'c': 1000000, 'l': '', 'r': CAST([] AS VARCHAR[])},
    {'c': 1000000, 'l': '', 'r': CAST([] AS VARCHAR[])}
  FROM conversations
  UNION ALL
  SELECT conv_id, i, e1, s1, u1, a1 FROM (
    SELECT y.conv_id, y.i, x.fault IN ('b', 'd') AS must, CASE x.fault WHEN 't' THEN 3 ELSE 0 END AS more, x.c AS first,
      x.role || ':' || x.t AS kept,
      list_min([u, {'c': e.c + 3, 'l': e.l || 'I', 'r': e.r || ['user:']}, {'c': s.c + 3, 'l': s.l || 'I', 'r': s.r || ['user:']},
        {'c': a.c + 3, 'l': a.l || 'I', 'r': a.r || ['user:']}]) AS u0,
      list_min([a, {'c': u0['c'] + 3, 'l': u0['l'] || 'I', 'r': u0['r'] || ['assistant:']}]) AS a0,
      CASE WHEN must THEN 1000000 ELSE more + 3 END AS re,
      {'c': e.c + 4, 'l': e.l || 'D', 'r': e.r} AS e1,
      list_min([{'c': s.c + 4, 'l': s.l || 'D', 'r': s.r},
        {'c': e.c + CASE WHEN must OR first <> 's' THEN 1000000 ELSE more END, 'l': e.l || 'K', 'r': e.r || [kept]}]) AS s1,
      list_min([{'c': u0['c'] + 4, 'l': u0['l'] || 'D', 'r': u0['r']}] || [
        {'c': p.c + CASE WHEN must OR first <> 'u' THEN 1000000 ELSE more END, 'l': p.l || 'K', 'r': p.r || [kept]} for p in [e, s, a0]] || [
        {'c': p.c + re, 'l': p.l || 'R', 'r': p.r || ['user:' || x.t]} for p in [e, s, a0]]) AS u1,
      list_min([{'c': a0['c'] + 4, 'l': a0['l'] || 'D', 'r': a0['r']},
        {'c': u0['c'] + CASE WHEN must OR first <> 'a' THEN 1000000 ELSE more END, 'l': u0['l'] || 'K', 'r': u0['r'] || [kept]},
        {'c': u0['c'] + re, 'l': u0['l'] || 'R', 'r': u0['r'] || ['assistant:' || x.t]}]) AS a1
    FROM (SELECT conv_id, i + 1 AS i, e, s, u, a FROM walk) y
      JOIN faults x ON x.i = y.i AND x.conv_id IS NOT DISTINCT FROM y.conv_id)),
ends AS (
  SELECT conv_id, i, list_min([e, a, {'c': u.c + 3, 'l': u.l || 'I', 'r': u.r || ['assistant:']},
    {'c': s.c + 6, 'l': s.l || 'II', 'r': s.r || ['user:', 'assistant:']}]) AS best
  FROM walk),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faults GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost,
  best.l AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM ends x LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM x.conv_id
WHERE x.i = coalesce(n.n, 0)"""

ORACLES = {
    "op4_chat_format": CHAT_FORMAT,
    "op5_html_text": HTML_TEXT,
    "op9_near_duplicates": NEAR_DUPLICATES,
    "op11_url_filter": URL_FILTER,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_turn_repair": TURN_REPAIR,
}
