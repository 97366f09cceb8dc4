"""The SQL each query is checked against, on the same Parquet tables."""

from __future__ import annotations

from keelson.sources.driver_tables import DOC_EVENTS, DOC_NEGATIONS, DOC_SEVERITY, DOC_TERMS

ORACLES: dict[str, str] = {}


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


HISTORY = """
months AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS supplier_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS observation_date,
         avg(l_quantity) / 5 AS avg_delay_days,
         1000 * avg(l_discount) AS risk_score,
         avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS on_time_delivery_rate,
         0.1::DOUBLE * avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS quality_defect_rate,
         10 * max(l_tax) AS external_event_severity,
         sum(l_extendedprice * (1 - l_discount)) / 30 AS daily_revenue_exposure,
         avg(l_quantity) / 5 + 5 AS expected_delay_days,
         100 * avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS backup_capacity_pct,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS returned
  FROM lineitem GROUP BY 1, 2),
history AS MATERIALIZED (
  SELECT * EXCLUDE (returned), 'Supplier ' || supplier_id AS supplier_name,
         CASE WHEN lead(returned) OVER (PARTITION BY supplier_id ORDER BY observation_date) > 0.4
              THEN 1 ELSE 0 END AS disruption_next_30d
  FROM months)"""

SUPPLIERS = (
    HISTORY
    + """,
means AS (
  SELECT supplier_id, avg(avg_delay_days) AS avg_delay_days, avg(risk_score) AS risk_score,
         avg(on_time_delivery_rate) AS on_time_delivery_rate,
         avg(quality_defect_rate) AS quality_defect_rate,
         avg(daily_revenue_exposure) AS daily_revenue_exposure,
         avg(expected_delay_days) AS expected_delay_days,
         avg(backup_capacity_pct) AS backup_capacity_pct
  FROM history GROUP BY 1),
title_words AS (
  SELECT doc_id, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+') AS w
  FROM documents),
suppliers AS MATERIALIZED (
  SELECT CAST(s_suppkey AS VARCHAR) AS supplier_id, m.* EXCLUDE (supplier_id), s_suppkey AS row_pos,
         CASE WHEN doc_id IS NOT NULL
              THEN coalesce(w[1], '') || ' ' || coalesce(w[2], '') || ' Ltd.' END AS supplier_name,
         CASE WHEN doc_id IS NOT NULL THEN coalesce(w[3], '') || '|' || coalesce(w[4], '') END AS aliases,
         CASE WHEN doc_id IS NOT NULL THEN coalesce(w[5], '') END AS location
  FROM supplier LEFT JOIN title_words ON doc_id = s_suppkey
  LEFT JOIN means m ON m.supplier_id = CAST(s_suppkey AS VARCHAR))"""
)

NEWS = """
news AS MATERIALIZED (
  SELECT doc_id AS article_pos, split_part(text, chr(10), 1) AS title, '' AS snippet,
         text AS full_text, 'https://example.org/' || doc_id AS url, source,
         CASE WHEN doc_id % 13 = 0 THEN ''
              WHEN doc_id % 17 = 0 THEN '2 days ago'
              WHEN doc_id % 3 = 0 THEN day
              WHEN doc_id % 3 = 1 THEN day || 'T01:00:00+02:00'
              ELSE day || 'T01:00:00Z' END AS published_at
  FROM (SELECT *, strftime(DATE '2026-09-10' - CAST(doc_id % 120 AS INTEGER), '%Y-%m-%d') AS day
        FROM documents))"""

BODY = "trim(title || ' ' || snippet || ' ' || full_text, ' ' || chr(10) || chr(9) || chr(13))"
MICROS = "epoch_us(try_cast(published_at AS TIMESTAMPTZ))"
CUTOFF = "epoch_us(TIMESTAMPTZ '2026-07-12 00:00:00+00:00')"
RECENT = f"coalesce({MICROS} >= {CUTOFF}, true)"


def tokens(column: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'))"


def signal(column: str) -> str:
    cleaned = f"lower({column})"
    for pattern in DOC_NEGATIONS:
        # Twice: two denials in a row share the character between them.
        for _ in range(2):
            cleaned = (
                f"regexp_replace({cleaned}, '(^|[^\\p{{L}}\\p{{N}}_])(?:{pattern})"
                f"([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\2', 'g')"
            )
    return (
        f"list_has_any(regexp_extract_all({cleaned}, '[a-z0-9]+'), [{quoted(DOC_TERMS)}])"
    )


def name_words(column: str) -> str:
    return (
        f"list_filter(string_split_regex(regexp_replace(lower(coalesce({column}, '')), "
        f"'[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x NOT IN ('', 'limited', 'ltd', 'inc', 'corp', 'corporation', 'company', 'co'))"
    )


def name(column: str) -> str:
    return f"array_to_string({name_words(column)}, ' ')"


def greedy(source: str) -> str:
    """Titles read in order: ``kept_rows`` holds the numbers of the kept ones."""
    return f"""
titles AS MATERIALIZED (
  SELECT article_pos, {tokens("title")} AS tk, row_number() OVER (ORDER BY article_pos) AS rn
  FROM {source}),
alike AS MATERIALIZED (
  SELECT a.rn, list(b.rn) AS earlier
  FROM titles a JOIN titles b ON b.rn < a.rn
   AND (len(a.tk) + len(b.tk) = 0
        OR len(list_intersect(a.tk, b.tk))::DOUBLE
           / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) >= 0.72)
  GROUP BY a.rn),
graph AS MATERIALIZED (
  SELECT t.rn, coalesce(s.earlier, []) AS earlier FROM titles t LEFT JOIN alike s ON s.rn = t.rn),
walk(rn, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT g.rn, CASE WHEN list_has_any(kept, g.earlier) THEN kept ELSE list_append(kept, g.rn) END
  FROM walk JOIN graph g ON g.rn = walk.rn + 1),
kept_rows AS MATERIALIZED (
  SELECT unnest(kept) AS rn FROM walk WHERE rn = (SELECT max(rn) FROM walk))"""


def event(column: str) -> str:
    """``hits`` and ``label`` of the winning class."""
    counted = []
    for label, terms in DOC_EVENTS.items():
        single = [t for t in terms if " " not in t]
        hits = f"len(list_intersect(words, [{quoted(single)}]))"
        for phrase in (t for t in terms if " " in t):
            hits += (
                f" + regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){phrase}"
                f"([^\\p{{L}}\\p{{N}}_]|$)')::INTEGER"
            )
        counted.append(f"{{'hits': {hits}, 'label': '{label}'}}")
    return (
        f"(SELECT list_aggregate([{', '.join(counted)}], 'max') FROM (SELECT "
        f"lower({column}) AS low, list_distinct(regexp_extract_all(lower({column}), "
        f"'[\\p{{L}}\\p{{N}}_]+')) AS words))"
    )


def severity(column: str) -> str:
    words = ", ".join(
        f"CASE WHEN contains(lower({column}), '{w}') THEN {s}::DOUBLE END" for w, s in DOC_SEVERITY.items()
    )
    return f"greatest({words}, {duration(f'lower({column})')}, 0.35::DOUBLE)"


def duration(column: str) -> str:
    pattern = r"'([0-9]+)\s*(day|week|month)'"
    return (
        f"least(1.0::DOUBLE, CASE WHEN regexp_matches({column}, {pattern}) "
        f"THEN try_cast(regexp_extract({column}, {pattern}, 1) AS DOUBLE) "
        f"* CASE regexp_extract({column}, {pattern}, 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 "
        f"ELSE 30 END / 30 ELSE 0.0::DOUBLE END)"
    )


def unit(value: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {value}))"


INTERNAL = unit(
    f"0.35::DOUBLE * {unit('avg_delay_days / 20')} + 0.30::DOUBLE * {unit('risk_score / 100')}"
    f" + 0.20::DOUBLE * (1 - {unit('on_time_delivery_rate')})"
    f" + 0.15::DOUBLE * {unit('quality_defect_rate / 0.10::DOUBLE')}"
)


def py_round(value: str, digits: int) -> str:
    """Rounded by the exact binary value, halves to even; ``round`` rounds the shortest decimal."""
    return f"CAST(format('{{:.{digits}f}}', {value}) AS DOUBLE)"


def scored(source: str, sev: str, conf: str) -> str:
    return f"""
part_risk AS (
  SELECT *, {INTERNAL} AS raw_internal, {unit(sev)} * {unit(conf)} AS raw_external FROM {source}),
whole_risk AS (
  SELECT *, {unit('0.62::DOUBLE * raw_internal + 0.38::DOUBLE * raw_external')} AS raw_combined
  FROM part_risk),
likely AS (SELECT *, 1 / (1 + exp(-5 * (raw_combined - 0.48::DOUBLE))) AS raw_probability FROM whole_risk),
losses AS (
  SELECT *, raw_probability * greatest(daily_revenue_exposure, 0.0::DOUBLE)
            * greatest(expected_delay_days, 1.0::DOUBLE)
            * (1 - {unit('backup_capacity_pct / 100')} * 0.55::DOUBLE) AS raw_loss FROM likely),
scored AS (
  SELECT *,
    CASE WHEN raw_loss >= 250000 OR raw_probability >= 0.78 THEN 'Critical'
         WHEN raw_loss >= 100000 OR raw_probability >= 0.62 THEN 'High'
         WHEN raw_loss >= 25000 OR raw_probability >= 0.45 THEN 'Medium' ELSE 'Low' END AS priority,
    CASE WHEN raw_loss >= 250000 OR raw_probability >= 0.78 THEN 'Escalate and activate backup'
         WHEN raw_loss >= 100000 OR raw_probability >= 0.62 THEN 'Contact supplier and prepare backup'
         WHEN raw_loss >= 25000 OR raw_probability >= 0.45 THEN 'Monitor closely'
         ELSE 'Continue routine monitoring' END AS recommended_action
  FROM losses)"""


MONTH_RISK = f"WITH {HISTORY}, {scored('history', 'external_event_severity', '0.8::DOUBLE')}"
TERMS = f"[{quoted(DOC_TERMS)}]"


def share(tk: str, wanted: str) -> str:
    return f"len(list_intersect({tk}, {wanted}))::DOUBLE / greatest(len({wanted}), 1)"


def relevance(tk: str, names: str, places: str) -> str:
    return py_round(
        f"0.50::DOUBLE * ({share(tk, names)}) + 0.30::DOUBLE * ({share(tk, places)}) "
        f"+ 0.20::DOUBLE * least(len(list_intersect({tk}, {TERMS})) / 2.0::DOUBLE, 1.0::DOUBLE)",
        4,
    )


def ranked(source: str) -> str:
    return f"""
wanted AS (
  SELECT supplier_id, {tokens("supplier_name")} AS names, {tokens("location")} AS places FROM suppliers),
bags AS MATERIALIZED (SELECT article_pos, {tokens(BODY)} AS tk FROM {source}),
pairs AS (
  SELECT supplier_id, article_pos, {relevance("tk", "names", "places")} AS relevance_score
  FROM wanted, bags),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY supplier_id ORDER BY relevance_score DESC, article_pos) AS article_rank
  FROM pairs WHERE relevance_score > 0.2
  QUALIFY article_rank <= 3)"""


def matches(source: str) -> str:
    """Named or located. The similarity test cannot pass for these names: they are too short."""
    return f"""
spelled AS (
  SELECT *, {name(BODY)} AS body, {name_words("location")} AS places,
    list_transform(list_concat([supplier_name], list_filter(list_transform(
      string_split(aliases, '|'), lambda a: trim(a)), lambda a: a <> '')),
      lambda n: {name("n")}) AS names
  FROM {source}),
identified AS MATERIALIZED (
  SELECT *, len(list_filter(names, lambda n: n <> '' AND contains(body, n))) > 0
    OR (len(places) > 0 AND len(list_filter(places, lambda p:
        NOT list_contains(string_split(body, ' '), p))) = 0) AS matches
  FROM spelled)"""


NEIGHBOURS = """
neighbours AS (
  SELECT n.*, s.* EXCLUDE (row_pos) FROM news n JOIN suppliers s ON n.article_pos // 10 = s.row_pos)"""

QUEUE = f"""WITH RECURSIVE {SUPPLIERS}, {NEWS},
relevant AS MATERIALIZED (SELECT * FROM news WHERE {RECENT} AND {signal(BODY)}),
{greedy("relevant")},
unique_news AS MATERIALIZED (
  SELECT r.* FROM relevant r JOIN titles t USING (article_pos) JOIN kept_rows k ON k.rn = t.rn),
{ranked("unique_news")},
candidates AS MATERIALIZED (
  SELECT r.relevance_score, r.article_rank, u.*, s.* EXCLUDE (row_pos)
  FROM ranked r JOIN unique_news u USING (article_pos) JOIN suppliers s USING (supplier_id)),
{matches("candidates")},
evidence AS (
  SELECT *, CASE WHEN ev.hits > 0 THEN ev.label ELSE 'Other disruption' END AS event_type,
    CASE WHEN ev.hits > 0 THEN least(0.50::DOUBLE + ev.hits * 0.12::DOUBLE, 0.92::DOUBLE)
         ELSE 0.35::DOUBLE END AS event_confidence,
    round(sev, 3) AS event_severity
  FROM (SELECT *, {event(BODY)} AS ev, {severity(BODY)} AS sev FROM identified WHERE matches)),
strongest AS (
  SELECT *, row_number() OVER (PARTITION BY supplier_id
      ORDER BY event_severity * event_confidence DESC, article_rank) AS nth,
    count(*) OVER (PARTITION BY supplier_id) AS matched
  FROM evidence QUALIFY nth = 1),
exposed AS (
  SELECT s.*, coalesce(e.event_type, 'No relevant external event') AS top_event_type,
    coalesce(e.url, '') AS top_event_url, coalesce(e.event_confidence, 0.0::DOUBLE) AS event_confidence,
    coalesce(e.event_severity, 0.0::DOUBLE) AS event_severity, coalesce(e.matched, 0) AS matched_articles
  FROM suppliers s LEFT JOIN strongest e ON e.supplier_id = s.supplier_id),
{scored("exposed", "event_severity", "event_confidence")}
"""

DIRTY = f"""{SUPPLIERS},
texts AS (
  SELECT supplier_id, supplier_name, location,
    CASE WHEN row_pos % 7 = 3 THEN NULL ELSE avg_delay_days END AS avg_delay_days,
    CASE WHEN row_pos % 5 = 2 THEN NULL WHEN row_pos % 11 = 4 THEN 140.5::DOUBLE
         ELSE risk_score END AS risk_score,
    CASE WHEN row_pos % 6 = 1 THEN NULL ELSE on_time_delivery_rate END AS on_time_delivery_rate,
    daily_revenue_exposure, row_pos * 2 AS row_pos
  FROM suppliers),
dirty AS (
  SELECT * FROM texts
  UNION ALL
  SELECT * REPLACE (61.25::DOUBLE AS risk_score, row_pos + 1 AS row_pos) FROM texts WHERE row_pos % 9 = 0),
latest AS (
  SELECT *, count(*) OVER (PARTITION BY supplier_id) AS copies,
    row_number() OVER (PARTITION BY supplier_id ORDER BY row_pos DESC) AS nth
  FROM dirty QUALIFY nth = 1)"""

REPORT = f"""{DIRTY},
report AS (
  SELECT 'duplicates_removed' AS "check", 'supplier_id' AS "column", sum(copies) - count(*) AS n,
         NULL::DOUBLE AS "value" FROM latest
  UNION ALL SELECT 'invalid_to_missing', 'avg_delay_days', count(*) FILTER (avg_delay_days IS NULL), NULL FROM latest
  UNION ALL SELECT 'invalid_to_missing', 'on_time_delivery_rate', count(*) FILTER (on_time_delivery_rate IS NULL), NULL FROM latest
  UNION ALL SELECT 'default_added', 'quality_defect_rate', count(*), 0.02 FROM latest
  UNION ALL SELECT 'default_added', 'expected_delay_days', count(*), 7.0 FROM latest
  UNION ALL SELECT 'default_added', 'backup_capacity_pct', count(*), 0.0 FROM latest
  UNION ALL SELECT 'missing_filled', 'avg_delay_days', count(*) FILTER (avg_delay_days IS NULL), median(avg_delay_days) FROM latest
  UNION ALL SELECT 'missing_filled', 'risk_score', count(*) FILTER (risk_score IS NULL), median(risk_score) FROM latest
  UNION ALL SELECT 'missing_filled', 'on_time_delivery_rate', count(*) FILTER (on_time_delivery_rate IS NULL), median(on_time_delivery_rate) FROM latest)"""

ARTICLE_FIELDS = "title, snippet, full_text, url, source, published_at"
ITEMS = """
items AS (
  SELECT doc_id, source AS src, unnest(string_split(text, chr(10))[:5]) AS line,
         generate_subscripts(string_split(text, chr(10))[:5], 1) - 1 AS spot
  FROM documents),
articles AS (
  SELECT doc_id, CAST(spot AS INTEGER) AS "at", line AS title,
    CASE WHEN spot % 2 = 0 THEN substring(line, 1, 20) ELSE '' END AS snippet,
    CASE WHEN spot % 2 = 0 THEN substring(line, 1, 20) ELSE '' END AS full_text,
    'https://example.org/' || spot AS url,
    CASE WHEN spot % 3 <> 0 THEN src ELSE 'Web' END AS source,
    CASE WHEN spot > 0 THEN '2026-09-01' ELSE '' END AS published_at
  FROM items)"""

# --- sources, checks, text --------------------------------------------------------------------
ORACLES["csv_suppliers"] = f"""WITH {DIRTY}
SELECT supplier_id, supplier_name || chr(10) || '(supplier)' AS supplier_name, nullif(location, '') AS location, false AS no_delay,
  risk_score IS NULL AS no_risk, on_time_delivery_rate IS NULL AS no_rate, round(risk_score, 7) AS risk_score
FROM dirty"""
ORACLES["parquet_report"] = MONTH_RISK + """
SELECT supplier_id, observation_date, round(raw_internal, 9) AS raw_internal, round(raw_loss, 4) AS raw_loss, priority FROM scored"""
ORACLES["json_news"] = f"""WITH {NEWS}
SELECT CAST(row_number() OVER (PARTITION BY article_pos // 100 ORDER BY article_pos) - 1 AS INTEGER) AS "at",
  title, url, published_at FROM news"""
ORACLES["json_line_news"] = f"WITH {NEWS} SELECT {ARTICLE_FIELDS} FROM news"
ORACLES["payload_articles"] = f"WITH {ITEMS} SELECT * FROM articles"
ORACLES["payload_stream"] = ORACLES["payload_articles"]
ORACLES["supplier_quality"] = f"""WITH {DIRTY},
fills AS (SELECT median(avg_delay_days) AS d, median(risk_score) AS r, median(on_time_delivery_rate) AS o FROM latest)
SELECT supplier_id, supplier_name, location, round(coalesce(avg_delay_days, d), 7) AS avg_delay_days,
  round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(risk_score, r))), 7) AS risk_score,
  round({unit("coalesce(on_time_delivery_rate, o)")}, 9) AS on_time_delivery_rate,
  round(greatest(0.0::DOUBLE, daily_revenue_exposure), 4) AS daily_revenue_exposure, row_pos,
  0.02::DOUBLE AS quality_defect_rate, 7.0::DOUBLE AS expected_delay_days, 0.0::DOUBLE AS backup_capacity_pct
FROM latest, fills"""
ORACLES["supplier_quality_report"] = f"""WITH {REPORT}
SELECT "check", "column", CAST(n AS BIGINT) AS n, round("value", 7) AS "value" FROM report WHERE n > 0"""
ORACLES["supplier_quality_warnings"] = f"""WITH {REPORT}
SELECT "check", "column", CASE "check"
    WHEN 'duplicates_removed' THEN 'Removed ' || n || ' duplicate supplier IDs.'
    WHEN 'invalid_to_missing' THEN 'Converted ' || n || ' invalid values in ' || "column" || ' to missing.'
    WHEN 'default_added' THEN 'Added ' || "column" || ' using default value ' || "value" || '.'
    ELSE 'Filled ' || n || ' missing values in ' || "column" || ' with ' || format('{{:.2f}}', "value") || '.'
  END AS warning FROM report WHERE n > 0"""
CHECKED = {
    "supplier": (
        "supplier_id", "supplier_name", "location", "avg_delay_days", "risk_score", "daily_revenue_exposure",
    ),
    "lineitem": (
        "supplier_id", "observation_date", "avg_delay_days", "risk_score", "on_time_delivery_rate",
        "quality_defect_rate", "external_event_severity",
    ),
    "documents": ("title", "text", "event_type", "split"),
    "labels": ("doc_id", "quality", "toxic"),
}
ORACLES["table_problems"] = " UNION ALL ".join(
    f"""SELECT '{table}' AS "table", 'missing_column' AS "check", c AS "column"
FROM (SELECT unnest({list(columns)}) AS c)
WHERE c NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM {table}))
UNION ALL SELECT '{table}', 'empty', NULL WHERE NOT EXISTS (FROM {table})"""
    for table, columns in CHECKED.items()
) + """ UNION ALL SELECT 'late orders', 'empty', NULL
WHERE NOT EXISTS (FROM orders WHERE o_orderdate > DATE '2100-01-01')"""
ORACLES["latest_suppliers"] = f"WITH {DIRTY} SELECT supplier_id, row_pos, copies FROM latest"
ORACLES["token_sets"] = f"""
SELECT doc_id, md5(array_to_string(list_sort({tokens("text")}), ' ')) AS tokens FROM documents"""
ORACLES["article_texts"] = f"WITH {NEWS} SELECT article_pos, md5({BODY}) AS article_text FROM news"
ORACLES["risk_signals"] = f"SELECT doc_id, {signal('text')} AS risk_signal FROM documents"
ORACLES["published_instants"] = f"WITH {NEWS} SELECT article_pos, {MICROS} AS micros FROM news"
ORACLES["normalized_names"] = f"WITH {SUPPLIERS} SELECT supplier_id, {name('supplier_name')} AS name FROM suppliers"
ORACLES["supplier_name_variants"] = f"""WITH {SUPPLIERS}, v AS (
  SELECT supplier_id, list_concat([supplier_name], list_filter(list_transform(
    string_split(aliases, '|'), lambda a: trim(a)), lambda a: a <> '')) AS vs FROM suppliers)
SELECT supplier_id, CAST(generate_subscripts(vs, 1) - 1 AS INTEGER) AS "at", unnest(vs) AS variant FROM v"""
ORACLES["leading_title_words"] = f"""
SELECT doc_id, array_to_string(({name_words("text")})[:12], ' ') AS opening FROM documents"""
PAIRS = f"""
pairs AS (
  SELECT m.p_partkey AS case_id, m.p_name || ' Co.' AS mention,
    upper(c.p_name[1]) || regexp_extract(c.p_name, '^.([^ ]*)', 1) || ' '
      || upper(split_part(c.p_name, ' ', 2)[1]) || substring(split_part(c.p_name, ' ', 2), 2) AS candidate_name,
    c.p_type || ', depot' AS candidate_location, m.p_type || ', ' || m.p_brand AS context_location,
    c.p_type AS ct, m.p_type AS mt, c.p_name AS cn, m.p_name AS mn, c.p_brand AS cb
  FROM part m JOIN part c ON m.p_partkey = c.p_partkey + 1)"""


def longest_block(a: str, b: str) -> str:
    """Size and (negative) places of the longest common run, the first one of equal ones."""
    size = (
        f"CASE WHEN {a}[i] = {b}[j] THEN list_max([q for q in range(1, least(len({a}) - i, len({b}) - j) + 2) "
        f"if substr({a}, i, q) = substr({b}, j, q)]) ELSE 0 END"
    )
    inner = f"[struct_pack(n := {size}, i := -i, j := -j) for j in range(1, len({b}) + 1)]"
    return f"list_max(flatten([{inner} for i in range(1, len({a}) + 1)]))"


def block_ratio(source: str) -> str:
    """``ratio`` per key ``k`` of ``source`` (k, a, b): blocks are taken out of stretches, in turn."""
    return f"""
seg(k, a, b, m) AS (
  SELECT k, a, b, {longest_block("a", "b")} FROM {source} WHERE a <> b AND a <> '' AND b <> ''
  UNION ALL
  SELECT k, part.a, part.b, {longest_block("part.a", "part.b")}
  FROM (SELECT k, unnest([
      struct_pack(a := substr(a, 1, -m.i - 1), b := substr(b, 1, -m.j - 1)),
      struct_pack(a := substr(a, -m.i + m.n), b := substr(b, -m.j + m.n))]) AS part
    FROM seg WHERE m.n > 0)
  WHERE part.a <> '' AND part.b <> ''),
blocks AS (SELECT k, sum(m.n) AS n FROM seg GROUP BY k),
ratios AS (
  SELECT s.k, CASE WHEN a = b THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * coalesce(n, 0) / (len(a) + len(b)) END AS ratio
  FROM {source} s LEFT JOIN blocks USING (k))"""


ORACLES["name_similarities"] = f"""WITH RECURSIVE {PAIRS},
named AS MATERIALIZED (SELECT case_id AS k, {name("mention")} AS a, {name("candidate_name")} AS b FROM pairs),
{block_ratio("named")}
SELECT k AS case_id, ratio AS similarity FROM ratios"""
ORACLES["name_candidates"] = f"""WITH RECURSIVE
names AS (SELECT {name("p_name")} AS s, count(*) AS n FROM part GROUP BY 1),
named AS MATERIALIZED (
  SELECT row_number() OVER () AS k, x.s AS a, y.s AS b, x.n AS n_mentions, y.n AS n_candidates FROM names x, names y),
{block_ratio("named")}
SELECT a AS mention, b AS candidate, ratio AS similarity, n_mentions, n_candidates
FROM named JOIN ratios USING (k) WHERE ratio >= 0.78"""
RESOLVED = f"""WITH RECURSIVE {PAIRS},
spelled AS MATERIALIZED (
  SELECT case_id, mention, unnest([candidate_name, cb, cn || ' Inc']) AS spelling, unnest([0, 1, 2]) AS nth FROM pairs),
named AS MATERIALIZED (
  SELECT case_id * 3 + nth AS k, case_id, spelling, {name("mention")} AS a, {name("spelling")} AS b FROM spelled),
{block_ratio("named")},
best AS (
  SELECT case_id, max(struct_pack(similarity := ratio, spelling := spelling)) AS best
  FROM named JOIN ratios USING (k) GROUP BY case_id),
places AS (
  SELECT case_id, list_distinct({name_words("context_location")}) AS ctx, {name_words("candidate_location")} AS cand FROM pairs),
resolved AS MATERIALIZED (
  SELECT case_id, best.spelling AS best_alias,
    -- Formatting rounds by the exact binary value, as the engine does.
    CAST(format('{{:.4f}}', 0.85::DOUBLE * best.similarity + 0.15::DOUBLE *
      CASE WHEN len(ctx) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(ctx, cand))::DOUBLE / len(ctx) END) AS DOUBLE) AS resolver_score
  FROM best JOIN places USING (case_id))"""
ORACLES["resolved_entities"] = RESOLVED + """
SELECT case_id, resolver_score >= 0.78 AS matched, resolver_score, best_alias FROM resolved"""


def f1_of(precision: str, recall: str) -> str:
    return (
        f"CASE WHEN {precision} + {recall} > 0 THEN 2 * {precision} * {recall} / ({precision} + {recall}) "
        "ELSE 0.0::DOUBLE END"
    )


JUDGED = f"""{RESOLVED},
judged AS MATERIALIZED (
  SELECT p.*, resolver_score, {name("mention")} = {name("candidate_name")} AS same,
    CASE WHEN {name("mention")} = {name("candidate_name")} OR mt = ct THEN 1 ELSE 0 END AS expected
  FROM pairs p JOIN resolved USING (case_id)),
grid AS (SELECT unnest([0.68::DOUBLE, 0.72, 0.76, 0.80, 0.84, 0.88, 0.92]) AS threshold),
counted AS (
  SELECT threshold,
    count(*) FILTER (resolver_score >= threshold AND expected = 1)::DOUBLE
      / greatest(count(*) FILTER (resolver_score >= threshold), 1) AS p,
    count(*) FILTER (resolver_score >= threshold AND expected = 1)::DOUBLE
      / greatest(count(*) FILTER (expected = 1), 1) AS r
  FROM judged, grid WHERE case_id % 3 = 1 GROUP BY threshold),
tuned AS (SELECT threshold, p, r, {f1_of("p", "r")} AS f FROM counted),
chosen AS (SELECT threshold AS t FROM tuned ORDER BY f DESC, p DESC, threshold DESC LIMIT 1)"""
ORACLES["entity_thresholds"] = JUDGED + """
SELECT threshold, p AS "precision", r AS recall, f AS f1 FROM tuned"""
ORACLES["entity_evaluation"] = JUDGED + f""",
said AS (
  SELECT expected, unnest(['Exact-name baseline', 'Alias + fuzzy + location']) AS method,
    unnest([same::INTEGER, (resolver_score >= t)::INTEGER]) AS predicted
  FROM judged, chosen WHERE case_id % 3 = 2),
shares AS (
  SELECT method, count(*) FILTER (predicted = 1 AND expected = 1)::DOUBLE / greatest(count(*) FILTER (predicted = 1), 1) AS p,
    count(*) FILTER (predicted = 1 AND expected = 1)::DOUBLE / greatest(count(*) FILTER (expected = 1), 1) AS r,
    count(*) FILTER (predicted <> expected) AS errors, count(*) AS test_rows
  FROM said GROUP BY method)
SELECT method, p AS "precision", r AS recall, {f1_of("p", "r")} AS f1, errors, test_rows,
  CASE WHEN method = 'Alias + fuzzy + location' THEN t END AS selected_threshold
FROM shares, chosen"""
ORACLES["entity_errors"] = JUDGED + """
SELECT mention, candidate_name, context_location, expected AS expected_match,
  (resolver_score >= t)::INTEGER AS resolver_prediction, resolver_score,
  CASE WHEN same THEN 'same name' ELSE 'other name' END AS challenge
FROM judged, chosen WHERE case_id % 3 = 2 AND (resolver_score >= t)::INTEGER <> expected"""
ORACLES["location_overlaps"] = f"""WITH {PAIRS},
w AS (SELECT case_id, list_distinct({name_words("context_location")}) AS ctx, {name_words("candidate_location")} AS cand FROM pairs)
SELECT case_id, round(CASE WHEN len(ctx) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect(ctx, cand))::DOUBLE / len(ctx) END, 9) AS overlap FROM w"""
ORACLES["locations_contained"] = f"""WITH {SUPPLIERS}, {NEWS}, {NEIGHBOURS},
w AS (SELECT article_pos, {name_words("location")} AS p, {name_words("full_text")} AS b FROM neighbours)
SELECT article_pos, len(p) > 0 AND len(list_intersect(list_distinct(p), b)) = len(list_distinct(p)) AS located FROM w"""
ORACLES["title_similarities"] = f"""WITH {NEWS},
bags AS MATERIALIZED (SELECT article_pos, {tokens("title")} AS tk FROM news)
SELECT a.article_pos, round(CASE WHEN len(a.tk) + len(b.tk) = 0 THEN 1.0::DOUBLE ELSE
  len(list_intersect(a.tk, b.tk))::DOUBLE / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) END, 9) AS similarity
FROM bags a JOIN bags b ON b.article_pos = a.article_pos + 1"""
ORACLES["durations"] = f"""
SELECT o_orderkey, round({duration("lower(note)")}, 9) AS share FROM (
  SELECT o_orderkey, 'Order ' || o_orderstatus || ' late by ' || day(o_orderdate)
    || CASE o_orderkey % 4 WHEN 0 THEN 'days' WHEN 1 THEN 'Week' WHEN 2 THEN ' months' ELSE 'hours' END AS note
  FROM orders)"""
ORACLES["model_texts"] = """
SELECT doc_id AS article_id, md5(split_part(text, chr(10), 1) || '. ' || text) AS model_text FROM documents"""
ORACLES["order_amounts"] = """
SELECT o_orderkey, '$' || format('{:,.0f}', o_totalprice) AS amount FROM orders"""

# --- news -------------------------------------------------------------------------------------
ORACLES["recent_articles"] = f"WITH {NEWS} SELECT article_pos FROM news WHERE {RECENT}"
ORACLES["risk_articles"] = f"WITH {NEWS} SELECT article_pos FROM news WHERE {signal(BODY)}"
ORACLES["recent_risk_articles"] = (
    f"WITH {NEWS} SELECT article_pos, url FROM news WHERE {RECENT} AND {signal(BODY)}"
)
ORACLES["near_duplicate_titles"] = f"""WITH RECURSIVE {NEWS}, {greedy("news")},
found AS (
  SELECT g.rn, min(k.rn) AS kept FROM (SELECT rn, unnest(earlier) AS e FROM graph) g
  JOIN kept_rows k ON k.rn = g.e WHERE g.rn NOT IN (SELECT rn FROM kept_rows) GROUP BY g.rn)
SELECT a.article_pos, b.article_pos AS kept_article_pos, round(
  CASE WHEN len(a.tk) + len(b.tk) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.tk, b.tk))::DOUBLE
    / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) END, 9) AS similarity
FROM found JOIN titles a ON a.rn = found.rn JOIN titles b ON b.rn = found.kept"""
ORACLES["deduplicated_articles"] = f"""WITH RECURSIVE {NEWS}, {greedy("news")}
SELECT n.article_pos, n.source FROM news n JOIN titles t USING (article_pos) JOIN kept_rows k ON k.rn = t.rn"""
ORACLES["streamed_titles"] = ORACLES["deduplicated_articles"]
ORACLES["relevance_scores"] = f"""WITH {SUPPLIERS}, {NEWS}, {NEIGHBOURS},
bags AS MATERIALIZED (SELECT article_pos, {tokens(BODY)} AS tk, {tokens("supplier_name")} AS names, {tokens("location")} AS places FROM neighbours)
SELECT * FROM (SELECT article_pos, {relevance("tk", "names", "places")} AS relevance_score FROM bags)
WHERE relevance_score > 0.2"""
ORACLES["top_articles"] = f"""WITH {SUPPLIERS}, {NEWS}, {ranked("news")}
SELECT supplier_id, article_pos, relevance_score, CAST(article_rank AS INTEGER) AS article_rank FROM ranked"""
ORACLES["identity_matches"] = f"""WITH {SUPPLIERS}, {NEWS}, {NEIGHBOURS}, {matches("neighbours")}
SELECT article_pos, matches FROM identified"""

# --- events, risk -----------------------------------------------------------------------------
CLASSED = f"""classed AS (SELECT doc_id, CASE WHEN ev.hits > 0 THEN ev.label ELSE 'Other disruption' END AS event_type,
  CASE WHEN ev.hits > 0 THEN least(0.50::DOUBLE + ev.hits * 0.12::DOUBLE, 0.92::DOUBLE) ELSE 0.35::DOUBLE END AS confidence,
  round(sev, 3) AS severity
  FROM (SELECT doc_id, {event("text")} AS ev, {severity("text")} AS sev FROM documents))"""
ORACLES["event_types"] = f"WITH {CLASSED} SELECT doc_id, event_type, round(confidence, 9) AS confidence FROM classed"
ORACLES["event_severities"] = f"SELECT doc_id, round({severity('text')}, 9) AS severity FROM documents"
ORACLES["events_per_class"] = f"""WITH {CLASSED}
SELECT event_type, 'keyword' AS backend, count(*) AS n, round(avg(severity), 9) AS mean_severity FROM classed GROUP BY 1"""
ORACLES["internal_risks"] = f"""WITH {HISTORY}
SELECT supplier_id, observation_date, round({INTERNAL}, 9) AS internal FROM history"""
ORACLES["supplier_month_risk"] = MONTH_RISK + """
SELECT supplier_id, observation_date, round(raw_internal, 9) AS raw_internal,
  round(raw_external, 9) AS raw_external, round(raw_combined, 9) AS raw_combined,
  round(raw_probability, 9) AS raw_probability, round(raw_loss, 4) AS raw_loss, priority, recommended_action
FROM scored"""
SUPPLIER_RISK = f"WITH {SUPPLIERS}, {scored('suppliers', '0.0::DOUBLE', '0.0::DOUBLE')}"
ORACLES["supplier_risk_table"] = SUPPLIER_RISK + """
SELECT supplier_id, priority, round(raw_probability, 9) AS raw_probability, round(raw_loss, 4) AS raw_loss FROM scored"""
ORACLES["risk_queue"] = QUEUE + f"""
SELECT supplier_id, priority, recommended_action, top_event_type, top_event_url,
  {py_round("event_confidence", 3)} AS event_confidence, CAST(matched_articles AS INTEGER) AS matched_articles,
  {py_round("100 * raw_internal", 1)} AS internal_risk, {py_round("100 * raw_external", 1)} AS external_risk,
  {py_round("100 * raw_combined", 1)} AS risk_score_calculated,
  {py_round("raw_probability", 4)} AS disruption_probability, {py_round("raw_loss", 2)} AS expected_loss FROM scored"""
ORACLES["risk_evidence"] = QUEUE + """
SELECT supplier_id, url, published_at, event_type, round(event_confidence, 4) AS event_confidence,
  round(event_severity, 4) AS event_severity, round(relevance_score, 4) AS relevance_score,
  'keyword' AS classifier_backend FROM evidence"""
ORACLES["supplier_evidence"] = QUEUE + """
SELECT title, source, published_at, event_type, round(event_confidence, 4) AS event_confidence, url
FROM evidence WHERE CAST(supplier_id AS BIGINT) % 10 = 3"""
ORACLES["news_counts"] = QUEUE + """
SELECT (SELECT count(*) FROM news) AS articles_received, (SELECT count(*) FROM unique_news) AS articles_processed"""
ORACLES["executive_summary"] = MONTH_RISK + f""",
urgent AS (SELECT *, {py_round("raw_loss", 2)} AS loss FROM scored WHERE priority IN ('Critical', 'High')),
top AS (SELECT * FROM urgent ORDER BY loss DESC LIMIT 1)
SELECT (SELECT count(*) FROM urgent) || ' supplier(s) need action. Modeled exposure is $'
  || format('{{:,.0f}}', (SELECT sum({py_round("raw_loss", 2)}) FROM scored)) || '. The highest priority is '
  || top.supplier_name || ' because of late deliveries, with an estimated loss of $'
  || format('{{:,.0f}}', top.loss) || '. Recommended next step: ' || lower(top.recommended_action) || '.' AS summary
FROM top"""
ORACLES["risk_snapshot"] = MONTH_RISK + """
SELECT count(*) AS suppliers, count(*) FILTER (priority IN ('Critical', 'High')) AS need_action,
  round(sum(raw_loss), 2) AS total_loss FROM scored"""
ORACLES["action_center"] = MONTH_RISK + f"""
SELECT priority, supplier_name, 'unknown' AS location, 'none' AS top_event_type, recommended_action,
  {py_round("100 * raw_combined", 1)} AS risk_score_calculated,
  {py_round("raw_probability", 4)} AS disruption_probability, {py_round("raw_loss", 2)} AS expected_loss FROM scored"""
ORACLES["highest_losses"] = SUPPLIER_RISK + """
SELECT supplier_id, round(raw_loss, 2) AS expected_loss FROM scored ORDER BY raw_loss DESC, supplier_id LIMIT 8"""
ORACLES["supplier_detail"] = MONTH_RISK + """
SELECT supplier_id, supplier_name, recommended_action, 'none' AS top_event_type, round(raw_internal, 9) AS internal_risk
FROM scored WHERE supplier_name = 'Supplier 7'"""


# --- features ---------------------------------------------------------------------------------
def _rolling(fn: str, column: str) -> str:
    return f"CASE WHEN count({column}) OVER p >= 2 THEN {fn}({column}) OVER p END"


FEATURED = f"""featured AS (
  SELECT *, lag(avg_delay_days, 1) OVER w AS delay_lag_1m,
    {_rolling("avg", "avg_delay_days")} AS delay_rolling_mean_3m,
    {_rolling("stddev_samp", "avg_delay_days")} AS delay_rolling_std_3m,
    lag(avg_delay_days, 1) OVER w - lag(avg_delay_days, 3) OVER w AS delay_trend_3m,
    {_rolling("avg", "on_time_delivery_rate")} AS on_time_rolling_mean_3m,
    {_rolling("avg", "quality_defect_rate")} AS defect_rolling_mean_3m,
    {_rolling("max", "external_event_severity")} AS external_event_max_3m,
    {_rolling("avg", "risk_score")} AS risk_rolling_mean_3m,
    sin(2 * pi() * month(observation_date) / 12) AS month_sin,
    cos(2 * pi() * month(observation_date) / 12) AS month_cos
  FROM history
  WINDOW w AS (PARTITION BY supplier_id ORDER BY observation_date),
         p AS (PARTITION BY supplier_id ORDER BY observation_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""
FEATURE_NAMES = [
    "avg_delay_days", "risk_score", "on_time_delivery_rate", "quality_defect_rate",
    "external_event_severity", "delay_lag_1m", "delay_rolling_mean_3m", "delay_rolling_std_3m",
    "delay_trend_3m", "on_time_rolling_mean_3m", "defect_rolling_mean_3m", "external_event_max_3m",
    "risk_rolling_mean_3m", "month_sin", "month_cos",
]
SEVEN_DIGITS = (
    "avg_delay_days", "risk_score", "delay_lag_1m", "delay_rolling_mean_3m", "delay_rolling_std_3m",
    "delay_trend_3m", "risk_rolling_mean_3m",
)
ORACLES["time_features"] = f"""WITH {HISTORY}, {FEATURED}
SELECT supplier_id, observation_date, {", ".join(f"round({c}, {7 if c in SEVEN_DIGITS else 9}) AS {c}" for c in FEATURE_NAMES)} FROM featured"""

# --- evaluation -------------------------------------------------------------------------------
BINARY = """
lengths AS (
  SELECT doc_id, source AS supplier_name, CAST(quality AS INTEGER) AS actual, n_chars
  FROM labels JOIN documents USING (doc_id)),
predictions AS (
  SELECT *, 'Length' AS model, n_chars / (n_chars + 500.0::DOUBLE) AS probability FROM lengths
  UNION ALL
  SELECT *, 'Length + calibration', 0.2::DOUBLE + 0.6::DOUBLE * (n_chars / (n_chars + 2000.0::DOUBLE)) FROM lengths
  UNION ALL
  SELECT *, 'Steps + calibration', CAST(floor(n_chars / 400.0::DOUBLE) AS BIGINT) % 10 / 10.0::DOUBLE FROM lengths)"""
OUTCOMES = f"""{BINARY},
outcomes AS (
  SELECT *, CASE WHEN actual = 0 AND probability >= 0.5 THEN 'False positive'
      WHEN actual = 1 AND probability < 0.5 THEN 'False negative' ELSE 'Correct' END AS error_type,
    CASE WHEN probability <= 0.2::DOUBLE THEN '0–20%' WHEN probability <= 0.4::DOUBLE THEN '20–40%'
      WHEN probability <= 0.6::DOUBLE THEN '40–60%' WHEN probability <= 0.8::DOUBLE THEN '60–80%'
      ELSE '80–100%' END AS probability_band
  FROM predictions)"""
_words = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
CLASSES = f"""
guesses AS (
  SELECT doc_id AS article_id, lang AS actual, list_aggregate([
    {{'hits': len(list_intersect({_words}, ['der', 'die', 'und', 'von'])), 'lang': 'de'}},
    {{'hits': len(list_intersect({_words}, ['the', 'of', 'and', 'that'])), 'lang': 'en'}},
    {{'hits': len(list_intersect({_words}, ['el', 'los', 'una', 'por'])), 'lang': 'es'}},
    {{'hits': len(list_intersect({_words}, ['le', 'la', 'les', 'des'])), 'lang': 'fr'}}], 'max') AS best
  FROM documents),
classes AS (
  SELECT article_id, actual, best.lang AS predicted, best.hits / 4.0::DOUBLE AS confidence FROM guesses),
class_errors AS (
  SELECT *, actual || ' → ' || predicted AS error_type,
    CASE WHEN confidence <= 0.5 THEN 'low' WHEN confidence <= 0.75 THEN 'medium' ELSE 'high' END AS confidence_band
  FROM classes WHERE actual <> predicted)"""
ORACLES["class_errors"] = f"""WITH {CLASSES}
SELECT article_id, error_type, confidence_band, confidence FROM class_errors"""
ORACLES["risk_error_summary"] = f"""WITH {OUTCOMES}
SELECT probability_band, error_type, count(*) AS n FROM outcomes GROUP BY 1, 2"""
ORACLES["risk_errors"] = f"""WITH {OUTCOMES}
SELECT supplier_name, DATE '2026-01-01' + CAST(doc_id % 200 AS INTEGER) AS observation_date, actual,
  round(probability, 9) AS probability, error_type, probability_band FROM outcomes WHERE error_type <> 'Correct'"""
# 0.15, 0.20, … 0.85, each the first one plus so many equal steps in doubles.
GRID = ", ".join(f"(0.15::DOUBLE + {i} * ((0.15::DOUBLE + 0.05::DOUBLE) - 0.15::DOUBLE))" for i in range(15))


def sweep(miss: float, alarm: float) -> str:
    return f"""WITH {BINARY}, grid AS (SELECT unnest([{GRID}]) AS threshold),
tally AS (
  SELECT model, threshold, count(*) FILTER (actual = 1 AND probability >= threshold) AS tp,
    count(*) FILTER (actual = 0 AND probability >= threshold) AS fp,
    count(*) FILTER (actual = 1 AND probability < threshold) AS fn
  FROM grid, predictions GROUP BY 1, 2),
swept AS (
  SELECT model, round(threshold, 2) AS threshold, round(tp / greatest(tp + fp, 1), 9) AS precision,
    round(tp / greatest(tp + fn, 1), 9) AS recall, fp AS false_positives, fn AS false_negatives,
    round(fn * {miss}::DOUBLE + fp * {alarm}::DOUBLE, 7) AS relative_decision_cost FROM tally)
"""


ORACLES["threshold_sweep"] = sweep(5, 1) + "SELECT * FROM swept"
ORACLES["lowest_cost_threshold"] = sweep(1, 1) + """
SELECT * FROM swept
QUALIFY row_number() OVER (PARTITION BY model ORDER BY relative_decision_cost, threshold) = 1"""
METRICS = f"""{BINARY},
by_score AS (
  SELECT model, probability, count(*) FILTER (actual = 1) AS pos, count(*) FILTER (actual = 0) AS neg
  FROM predictions GROUP BY 1, 2),
running AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM by_score
  WINDOW w AS (PARTITION BY model ORDER BY probability DESC)),
ranking AS (
  SELECT model, sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS roc_auc,
    sum(pos * (tp / (tp + fp))) / sum(pos) AS pr_auc FROM running GROUP BY 1),
pointwise AS (
  SELECT model, avg((probability - actual) * (probability - actual)) AS brier_score,
    avg(-CASE WHEN actual = 1 THEN ln(greatest(probability, 2.220446049250313e-16))
              ELSE ln(1 - least(probability, 1 - 2.220446049250313e-16)) END) AS log_loss,
    count(*) FILTER (actual = 1 AND probability >= 0.5) / greatest(count(*) FILTER (probability >= 0.5), 1) AS precision,
    count(*) FILTER (actual = 1 AND probability >= 0.5) / greatest(count(*) FILTER (actual = 1), 1) AS recall,
    count(*) AS test_rows FROM predictions GROUP BY 1),
metrics AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM ranking JOIN pointwise USING (model))"""
ORACLES["probability_metrics"] = f"""WITH {METRICS}
SELECT model, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc, round(brier_score, 9) AS brier_score,
  round(log_loss, 9) AS log_loss, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f1, 9) AS f1, test_rows FROM metrics"""
ORACLES["best_calibrated_model"] = f"""WITH {METRICS}
SELECT arg_min(model, brier_score) AS model FROM metrics WHERE contains(model, 'calibration')"""
ORACLES["reliability_curve"] = f"""WITH {BINARY},
edges AS (SELECT model, quantile_cont(probability, [0.2, 0.4, 0.6, 0.8]) AS e FROM predictions GROUP BY 1)
SELECT model, CAST(len(list_filter(e, lambda x: x < probability)) AS INTEGER) AS bin,
  round(avg(probability), 9) AS mean_predicted_probability, round(avg(actual), 9) AS observed_rate, count(*) AS rows
FROM predictions JOIN edges USING (model) GROUP BY 1, 2"""
ORACLES["class_metrics"] = f"""WITH {CLASSES},
labels_seen AS (SELECT actual AS label FROM classes UNION SELECT predicted FROM classes),
per_label AS (
  SELECT label, count(*) FILTER (actual = label) AS support,
    2.0::DOUBLE * count(*) FILTER (actual = label AND predicted = label)
      / (count(*) FILTER (actual = label) + count(*) FILTER (predicted = label)) AS f1
  FROM labels_seen, classes GROUP BY 1)
SELECT 'Stop words' AS model, (SELECT round(avg((actual = predicted)::INTEGER), 9) FROM classes) AS accuracy,
  round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS test_articles FROM per_label"""
ORACLES["confusion_matrix"] = f"""WITH {CLASSES}
SELECT actual, count(*) FILTER (predicted = 'de') AS de, count(*) FILTER (predicted = 'en') AS en,
  count(*) FILTER (predicted = 'es') AS es, count(*) FILTER (predicted = 'fr') AS fr FROM classes GROUP BY 1"""
ORACLES["models_seen"] = f"WITH {BINARY} SELECT DISTINCT model FROM predictions"
ORACLES["error_counts"] = f"WITH {CLASSES} SELECT error_type, count(*) AS n FROM class_errors GROUP BY 1"
ORACLES["news_error_listing"] = f"""WITH {CLASSES}
SELECT 'Stop words' AS model, actual, predicted, confidence, confidence_band FROM class_errors"""
ORACLES["class_balance"] = """
SELECT lang AS event_type, count(*) FILTER (doc_id % 8 < 5) AS train,
  count(*) FILTER (doc_id % 8 = 5) AS validation, count(*) FILTER (doc_id % 8 > 5) AS test
FROM documents GROUP BY 1"""
ORACLES["exact_name_matches"] = f"""WITH {PAIRS}
SELECT case_id, {name("mention")} = {name("candidate_name")} AS same FROM pairs"""

# --- models -----------------------------------------------------------------------------------
SPLIT = """
day_numbers AS (
  SELECT observation_date, row_number() OVER (ORDER BY observation_date) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT observation_date FROM history)),
split_days AS (
  SELECT observation_date, CASE WHEN i < greatest(1, floor(n * 0.6::DOUBLE)) THEN 'Train'
    WHEN i < greatest(greatest(1, floor(n * 0.6::DOUBLE)) + 1, floor(n * 0.8::DOUBLE)) THEN 'Calibration'
    ELSE 'Test' END AS split FROM day_numbers)"""
ORACLES["temporal_splits"] = f"""WITH {HISTORY}, {SPLIT}
SELECT supplier_id, observation_date, split FROM history JOIN split_days USING (observation_date)"""
ORACLES["split_summary"] = f"""WITH {HISTORY}, {SPLIT}
SELECT split, min(observation_date) AS start, max(observation_date) AS "end", count(*) AS rows,
  round(avg(disruption_next_30d), 9) AS disruption_rate
FROM history JOIN split_days USING (observation_date) GROUP BY 1"""
ORACLES["group_problems"] = f"""WITH {HISTORY}, {SPLIT},
seen AS (
  SELECT split, count(*) AS rows, count(DISTINCT disruption_next_30d) AS classes
  FROM history JOIN split_days USING (observation_date) GROUP BY 1)
SELECT "group", coalesce(rows, 0) AS rows, coalesce(classes, 0) AS classes,
  CASE WHEN rows IS NULL THEN 'missing' WHEN classes < 2 THEN 'one class' END AS problem
FROM (SELECT unnest(['Train', 'Calibration', 'Test', 'Holdout']) AS "group") named
LEFT JOIN seen ON seen.split = named."group" """
_medians = ", ".join(f"median({c}) AS {c}" for c in FEATURE_NAMES)
_filled = ", ".join(f"coalesce(f.{c}, m.{c}) AS {c}" for c in FEATURE_NAMES)
_moments = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURE_NAMES)
_scaled = ", ".join(f"round(({c} - a_{c}) / s_{c}, 7) AS z_{c}" for c in FEATURE_NAMES)
ORACLES["scaled_features"] = f"""WITH {HISTORY}, {FEATURED}, {SPLIT},
labeled AS (SELECT * FROM featured JOIN split_days USING (observation_date)),
medians AS (SELECT {_medians} FROM labeled WHERE split = 'Train'),
filled AS (SELECT supplier_id, observation_date, split, {_filled} FROM labeled f, medians m),
moments AS (SELECT {_moments} FROM filled WHERE split = 'Train')
SELECT supplier_id, observation_date, {_scaled} FROM filled, moments"""
_width = len(FEATURE_NAMES) + 1
_points = ", ".join(f"({c} - a_{c}) / s_{c}" for c in FEATURE_NAMES)
# Newton's method: per step one Gram matrix and gradient, then Gauss-Jordan over lists. A fold over
# the pivots needs elements of one type, so a pivot's number travels as a matrix of one cell.
LOGISTIC = f"""WITH RECURSIVE {HISTORY}, {FEATURED}, {SPLIT},
labeled AS (SELECT * FROM featured JOIN split_days USING (observation_date)),
medians AS (SELECT {_medians} FROM labeled WHERE split = 'Train'),
filled AS (SELECT supplier_id, observation_date, split, disruption_next_30d AS y, {_filled} FROM labeled f, medians m),
moments AS (SELECT {_moments} FROM filled WHERE split = 'Train'),
points AS MATERIALIZED (SELECT supplier_id, observation_date, split, y, [{_points}, 1.0::DOUBLE] AS x FROM filled, moments),
classes AS (
  SELECT y, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE AS w FROM points WHERE split = 'Train' GROUP BY y),
train AS MATERIALIZED (SELECT x, y, w FROM points JOIN classes USING (y) WHERE split = 'Train'),
places AS (SELECT unnest(range(1, {_width + 1})) AS i),
steps(step, b) AS (
  SELECT 0, [0.0::DOUBLE for i in range({_width})]
  UNION ALL
  SELECT step + 1, [b[i] - solved[i][{_width + 1}] for i in range(1, {_width + 1})] FROM (
    SELECT step, b, list_reduce([m] || [[[k::DOUBLE]] for k in range(1, {_width + 1})],
      lambda m, q: [[CASE WHEN i = q[1][1] THEN m[i][j] / m[q[1][1]::INT][q[1][1]::INT]
        ELSE m[i][j] - m[i][q[1][1]::INT] / m[q[1][1]::INT][q[1][1]::INT] * m[q[1][1]::INT][j] END
        for j in range(1, {_width + 2})] for i in range(1, {_width + 1})]) AS solved
    FROM (
      SELECT step, any_value(b) AS b, list(line ORDER BY i) AS m FROM (
        SELECT step, any_value(b) AS b, i,
          list(h + CASE WHEN i = j AND i < {_width} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j)
            || [max(g) + CASE WHEN i < {_width} THEN any_value(b)[i] ELSE 0.0::DOUBLE END] AS line
        FROM (
          SELECT step, any_value(b) AS b, r.i AS i, c.i AS j, sum(w * p * (1 - p) * x[r.i] * x[c.i]) AS h,
            sum(w * (p - y) * x[r.i]) AS g
          FROM (SELECT n.step, n.b, t.x, t.y, t.w, 1 / (1 + exp(-list_dot_product(t.x, n.b))) AS p FROM steps n, train t),
            places r, places c
          GROUP BY step, r.i, c.i)
        GROUP BY step, i)
      GROUP BY step)
    WHERE step < 12)),
fitted AS MATERIALIZED (SELECT b FROM steps ORDER BY step DESC LIMIT 1),
scored AS MATERIALIZED (
  SELECT supplier_id, observation_date, split, y, x, b, list_dot_product(x, b) AS margin FROM points, fitted)"""
ORACLES["calibrated_logistic"] = LOGISTIC + """,
held AS MATERIALIZED (
  SELECT margin AS s, CASE WHEN y = 1 THEN (sum(y) OVER () + 1) / (sum(y) OVER () + 2)::DOUBLE
    ELSE 1 / (count(*) OVER () - sum(y) OVER () + 2)::DOUBLE END AS t
  FROM scored WHERE split = 'Calibration'),
platt(step, a, c) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), c - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  FROM (
    SELECT step, any_value(a) AS a, any_value(c) AS c, sum(p * (1 - p) * s * s) AS h11, sum(p * (1 - p) * s) AS h12,
      sum(p * (1 - p)) AS h22, sum((p - t) * s) AS g1, sum(p - t) AS g2
    FROM (SELECT step, a, c, s, t, 1 / (1 + exp(-(a * s + c))) AS p FROM platt, held) GROUP BY step)
  WHERE step < 20),
line AS (SELECT a, c FROM platt ORDER BY step DESC LIMIT 1)
SELECT supplier_id, observation_date, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS probability,
  round(1 / (1 + exp(-(a * margin + c))), 6) AS calibrated
FROM scored, line WHERE split = 'Test'"""
ORACLES["linear_contributions"] = LOGISTIC + f""",
named AS (SELECT unnest({FEATURE_NAMES}) AS feature, unnest(range(1, {_width})) AS i)
SELECT feature, round(avg(abs(x[i] * b[i])), 7) AS mean_abs_contribution,
  round(avg(x[i] * b[i]), 7) AS directional_mean_contribution
FROM scored, named WHERE split = 'Test' GROUP BY feature"""
ORACLES["tfidf_weights"] = """WITH
docs AS (SELECT doc_id AS id, lower(split_part(text, chr(10), 1) || '. ' || text) AS body FROM documents),
worded AS (SELECT id, regexp_extract_all(body, '[\\p{L}\\p{N}_]{2,}') AS w FROM docs),
word_terms AS (
  SELECT id, unnest(w) AS term FROM worded
  UNION ALL
  SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded),
padded_words AS (
  SELECT id, ' ' || word || ' ' AS padded, count(*) AS n FROM (
    SELECT id, unnest(string_split_regex(body, '[\\s\\p{Z}]+')) AS word FROM docs) WHERE word <> '' GROUP BY 1, 2),
char_terms AS (
  SELECT id, n, unnest(list_transform(range(1, length(padded) - size + 2), lambda i: substring(padded, i, size))) AS term
  FROM padded_words, (SELECT unnest([3, 4, 5]) AS size) WHERE length(padded) >= size),
counts AS (
  SELECT id, 'word' AS block, term, count(*) AS tf FROM word_terms GROUP BY ALL
  UNION ALL
  SELECT id, 'char', term, sum(n) FROM char_terms GROUP BY ALL),
ranked_terms AS (
  SELECT block, term, count(*) AS df, row_number() OVER (PARTITION BY block ORDER BY sum(tf) DESC, term) AS nth
  FROM counts GROUP BY 1, 2 QUALIFY nth <= 5000),
raw AS (
  SELECT id, block, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS raw
  FROM counts JOIN ranked_terms USING (block, term)),
weights AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id, block)) AS weight FROM raw)
SELECT block, term, count(*) AS documents, round(max(weight), 9) AS largest, round(min(weight), 9) AS smallest
FROM weights GROUP BY 1, 2"""
