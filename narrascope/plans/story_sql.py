"""DuckDB SQL of the story queries, written from the contract's rules."""

from __future__ import annotations

from narrascope.operators import claims, extraction
from narrascope.plans import mapping as m
from narrascope.plans.market_queries import EXPO, TOP
from narrascope.plans.story_queries import AS_OF, NEWS_SQL, PANEL, SUBJECTS
from narrascope.plans.text_queries import _WS

_USUAL = {"Acme Corp": "Acme", "RBC": "Royal Bank of Canada"}
_HITS = " UNION ALL ".join(f"SELECT chunk_id, available_at, text, {k} AS pos, '{t}' AS t, '{_USUAL.get(n, n)}' AS name FROM n WHERE regexp_matches(text, '(?i){p}')" for k, (t, n, p) in enumerate(extraction.ENTITY_RULES))
_H = f"n AS MATERIALIZED (SELECT * FROM {NEWS_SQL} x), h AS MATERIALIZED ({_HITS}), ent AS (SELECT 'ent_' || substr(sha256('entity:' || t || ':' || lower(name)), 1, 16) AS id, t, arg_min(name, chunk_id) AS name, arg_min(available_at, chunk_id) AS first_seen, list_sort(list(DISTINCT chunk_id)) AS ids, max(available_at) AS latest FROM h GROUP BY t, lower(name))"
_DIR = f"CASE WHEN regexp_matches(a.text, '{extraction.BENEFICIAL}') AND NOT regexp_matches(a.text, '{extraction.ADVERSE}') THEN 1 WHEN regexp_matches(a.text, '{extraction.ADVERSE}') AND NOT regexp_matches(a.text, '{extraction.BENEFICIAL}') THEN -1 ELSE 0 END"


def _rule(kind, words, targets, source, confidence, signed):
    fires = " OR ".join(f"contains(lower(a.text), '{w}')" for w in words)
    types = ", ".join(f"'{t}'" for t in targets)
    return f"SELECT a.chunk_id, a.available_at, a.name, b.name, '{kind}', {confidence}, {_DIR if signed else 0} FROM h a JOIN h b ON a.chunk_id = b.chunk_id WHERE a.t = '{source}' AND b.t IN ({types}) AND ({fires})"


_CAND = "SELECT a.chunk_id, a.available_at, a.name AS s, b.name AS o, 'co_occurs_with' AS kind, 0.65 AS confidence, 0 AS direction FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND a.pos < b.pos AND a.t <> b.t UNION ALL " + " UNION ALL ".join(_rule(*r) for r in extraction.TRIGGER_RULES)
_EDGES = f"{_H}, cand AS ({_CAND}), ids AS (SELECT lower(name) AS n, max(id) AS id FROM ent GROUP BY 1), edg AS (SELECT a.id AS src, b.id AS dst, kind AS edge_type, arg_min(confidence, chunk_id)::DOUBLE AS confidence, arg_min(direction, chunk_id)::INT AS direction, arg_min(available_at, chunk_id) AS first_seen, list_sort(list(DISTINCT chunk_id)) AS evidence FROM cand JOIN ids a ON a.n = lower(s) JOIN ids b ON b.n = lower(o) WHERE s <> o GROUP BY ALL)"
_EID = "'edge_' || substr(sha256('edge:' || src || ':' || dst || ':' || edge_type), 1, 16)"

_SUBJECTS = "[" + ", ".join(f"'{x}'" for x in SUBJECTS) + "]"
_SIGNALS = " OR ".join(f"contains(lower(s), '{w}')" for w in claims.GUIDANCE_SIGNALS)


def _found(kind, pattern, metric, value, unit, period, direction, confidence):
    g = lambda k: f"regexp_extract_all(s, '{pattern}', {k})"
    of = lambda k: f"g{k}[k]"
    groups = ", ".join(f"{g(k)} AS g{k}" for k in range(1, 5 if kind < 2 else 4))
    sub = lambda x: x.format(**{f"g{k}": of(k) for k in range(1, 5)})
    return f"SELECT chunk_id, company, available_at, i, {kind} AS kind, k, {sub(metric)} AS metric, {sub(value)}::DOUBLE AS value, {sub(unit)} AS unit, {sub(period)} AS period, {sub(direction)} AS direction, g AS is_guidance, {confidence} AS confidence FROM (SELECT *, unnest(range(1, len(g1) + 1)) AS k FROM (SELECT *, {groups} FROM sent))"


_CLAIMS = f"""n AS MATERIALIZED (SELECT * FROM {NEWS_SQL} x), parts AS (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS l FROM n),
 sent AS MATERIALIZED (SELECT chunk_id, company, available_at, i, l[i] AS s, {_SIGNALS.replace("(s)", "(l[i])")} AS g, replace(upper(regexp_extract(l[i], '{claims.PERIOD_IN_TEXT}', 1)), '  ', ' ') AS said FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM parts)),
 found AS ({_found(0, claims.MONEY, "replace(lower(trim({g1})), ' ', '_')", "{g3}", "CASE WHEN lower({g4}) IN ('billion', 'bn') THEN 'USD_billions' ELSE 'USD_millions' END", "said", "CASE WHEN lower({g2}) IN ('rose', 'grew', 'increased') THEN 'rose' WHEN lower({g2}) IN ('fell', 'declined', 'decreased') THEN 'fell' ELSE '' END", 0.75)}
  UNION ALL {_found(1, claims.SHARE, "replace(lower(trim({g1})), ' ', '_')", "{g3}", "'percent'", "upper(trim({g4}))", "''", 0.70)}
  UNION ALL {_found(2, claims.PER_SHARE, "'eps'", "{g2}", "'USD_per_share'", "upper(trim({g3}))", "''", 0.75)})"""
_ROLLED = "rolled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, metric, period, is_guidance ORDER BY confidence DESC, chunk_id, i, kind, k) AS rn FROM found) WHERE rn = 1)"

_CONCEPT = "p_brand || '|' || p_type"
_GRAPH = f"""ge AS MATERIALIZED (SELECT src, dst, edge_type, method, round(max(l_discount), 4) AS confidence, min(day) AS first_seen, list(DISTINCT chunk) AS evidence, src || '>' || dst || '>' || edge_type || '>' || method AS edge_id FROM (SELECT 's' || l_suppkey AS src, {_CONCEPT} AS dst, ['exposed_to', 'benefits', 'co_occurs_with'][l_orderkey % 3 + 1] AS edge_type, ['document_stated', 'llm_inferred'][l_linenumber % 2 + 1] AS method, l_shipdate::DATE AS day, l_discount, l_orderkey::VARCHAR AS chunk FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY src, dst, edge_type, method),
 gn AS MATERIALIZED (SELECT 's' || s_suppkey AS id, 'Company' AS t, s_name AS name, DATE '1997-06-01' + (s_suppkey % 400)::INT AS first_seen, 'c' || s_nationkey % 5 AS community FROM supplier UNION ALL SELECT DISTINCT {_CONCEPT}, 'EconomicConcept', {_CONCEPT}, DATE '1997-01-01', 'c' || length({_CONCEPT}) % 5 FROM part)"""
_KNOWN = f"kn AS MATERIALIZED (SELECT * FROM gn WHERE first_seen <= DATE '{AS_OF}')"

_IMPACT = f"""e AS MATERIALIZED (SELECT src || '>' || dst AS id, src, dst, edge_type, greatest((w % 100) / 100.0, 0.01) AS weight, 'x' || w % 40 AS chunk, CASE WHEN edge_type IN ('causes', 'exposed_to') THEN direction WHEN edge_type = 'benefits' THEN 1 ELSE -1 END AS polarity FROM (
  SELECT DISTINCT 'e' || a AS src, 'k' || b AS dst, 'causes' AS edge_type, a % 3 - 1 AS direction, a * 31 + b * 17 AS w FROM (SELECT n_nationkey AS a, unnest([(n_nationkey * 3 + 1) % 25, (n_nationkey * 7 + 2) % 25]) AS b FROM nation)
  UNION SELECT 'k' || s_suppkey % 25, 's' || s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'benefits' ELSE 'hurts' END, 0, s_suppkey * 13 + s_nationkey FROM supplier
  UNION SELECT 's' || s_suppkey, 's' || ((s_suppkey * 3) % (SELECT count(*) FROM supplier) + 1), 'exposed_to', s_suppkey % 3 - 1, s_suppkey * 7 FROM supplier)),
 p AS (SELECT 'e' || n_nationkey AS trigger, 'e' || n_nationkey AS tip, ['e' || n_nationkey] AS seen, []::VARCHAR[] AS path, 1.0::DOUBLE AS force FROM nation
  UNION ALL SELECT trigger, dst, list_append(seen, dst), list_append(path, id), force * polarity * weight * 0.8 FROM p JOIN e ON tip = src WHERE polarity <> 0 AND src <> dst AND len(path) < 3 AND NOT list_contains(seen, dst)),
 hit AS MATERIALIZED (SELECT * FROM p WHERE tip IN (SELECT 's' || s_suppkey FROM supplier) AND len(path) > 0),
 tot AS (SELECT trigger, tip, sum(force) AS impact, count(*) AS n_paths, min(path) AS path FROM hit GROUP BY ALL HAVING round(sum(force), 12) <> 0)"""

_PAGE = r"(regexp_matches(x, '^\s*[-—]?\s*\d+\s*[-—]?\s*$') OR regexp_matches(x, '^\s*page\s+\d+(\s+of\s+\d+)?\s*$', 'i') OR regexp_matches(x, '^\s*\d+\s*/\s*\d+\s*$'))"
_ws = lambda c: "(" + _WS.replace("replace(replace(text,", f"replace(replace({c},") + ")"

_PTS2 = f"pts AS (SELECT * FROM (VALUES (DATE '{AS_OF}', 3), (DATE '{AS_OF}', 6)) v(as_of, months))"
_RETS2 = f"""r AS MATERIALIZED (SELECT as_of, months, company_id, first(price_date ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) AS a, last(price_date ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) AS b, last(close ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) / first(close ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) - 1 AS ret
  FROM {m.PRICES_SQL} p JOIN pts ON price_date > as_of AND price_date <= as_of + to_months(months) GROUP BY ALL)"""

_PANEL = """r AS MATERIALIZED (SELECT DISTINCT idx, theme, company, printf('%06d|%s', idx, theme) AS key FROM (SELECT ((year(o_orderdate) - 1992) * 4 + quarter(o_orderdate) - 1)::INT AS idx, 't' || lpad((o_custkey % 12)::VARCHAR, 2, '0') AS theme, o_custkey % 12 AS t, o_custkey % 12 * 10 + floor(o_totalprice / 60000)::BIGINT AS company FROM orders) WHERE (idx + t) % 5 <> 0),
 nd AS MATERIALIZED (SELECT DISTINCT idx, theme, key, theme || '-' || lpad(idx::VARCHAR, 3, '0') AS snap FROM r), sz AS (SELECT key, count(*) AS n FROM r GROUP BY 1),
 lk AS MATERIALIZED (SELECT * FROM (SELECT a.key AS src, b.key AS dst, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS j FROM r a JOIN r b ON b.idx = a.idx + 1 AND a.company = b.company JOIN sz x ON x.key = a.key JOIN sz y ON y.key = b.key GROUP BY ALL) WHERE j >= 0.5),
 u1 AS MATERIALIZED (SELECT src AS a, dst AS b FROM lk UNION SELECT dst, src FROM lk), c1 AS (SELECT key, key AS reach FROM nd UNION SELECT key, b FROM c1 JOIN u1 ON reach = a), f1 AS MATERIALIZED (SELECT key, min(reach) AS root FROM c1 GROUP BY 1),
 sp AS MATERIALIZED (SELECT root, min(idx) AS first, max(idx) AS last FROM nd JOIN f1 USING (key) GROUP BY 1),
 en AS MATERIALIZED (SELECT DISTINCT root, company FROM r JOIN f1 USING (key) JOIN sp USING (root) WHERE idx = last), be AS MATERIALIZED (SELECT DISTINCT root, company FROM r JOIN f1 USING (key) JOIN sp USING (root) WHERE idx = first),
 gp AS MATERIALIZED (SELECT z.root, z.later FROM (SELECT en.root, be.root AS later, count(*) AS n FROM en JOIN be ON en.company = be.company GROUP BY ALL) z JOIN (SELECT root, count(*) AS n FROM en GROUP BY 1) x ON x.root = z.root JOIN (SELECT root, count(*) AS n FROM be GROUP BY 1) y ON y.root = z.later JOIN sp a ON a.root = z.root JOIN sp b ON b.root = z.later WHERE z.n / (x.n + y.n - z.n) >= 0.5 AND b.first > a.last + 1),
 u2 AS MATERIALIZED (SELECT * FROM u1 UNION SELECT root, later FROM gp UNION SELECT later, root FROM gp), c2 AS (SELECT key, key AS reach FROM nd UNION SELECT key, b FROM c2 JOIN u2 ON reach = a), f2 AS MATERIALIZED (SELECT key, min(reach) AS root FROM c2 GROUP BY 1),
 fam AS MATERIALIZED (SELECT root, 'family_' || substr(sha256('family:run:' || string_agg(snap, '|' ORDER BY snap)), 1, 8) AS fid, min(idx) AS first, max(idx) AS last, count(DISTINCT idx) AS n_points FROM nd JOIN f2 USING (key) GROUP BY 1),
 ch AS (SELECT src, count(*) AS n FROM lk GROUP BY 1), pa AS (SELECT dst AS key, count(*) AS np, max(j) AS j, max(ch.n) AS sib FROM lk JOIN ch USING (src) GROUP BY 1),
 rv AS (SELECT key FROM nd JOIN f1 USING (key) JOIN sp USING (root) WHERE idx = sp.first AND root IN (SELECT later FROM gp)),
 ev AS MATERIALIZED (SELECT nd.idx, theme, fid, fam.root, round(coalesce(j, 1.0), 6) AS confidence, coalesce(np, 0) AS n_parents, CASE WHEN np IS NULL THEN CASE WHEN rv.key IS NOT NULL OR nd.idx > fam.first THEN 'revived' ELSE 'emerged' END WHEN np >= 2 THEN 'merged' WHEN sib >= 2 THEN 'split' ELSE 'persisted' END AS event FROM nd JOIN f2 USING (key) JOIN fam USING (root) LEFT JOIN pa USING (key) LEFT JOIN rv USING (key))"""

_RELEVANCE = f"(SELECT theme, n, latest, round(rs, 6) AS recent_share, round(rel, 6) AS relevance, CASE WHEN rs >= 0.5 THEN 'active' WHEN rs >= 0.2 THEN 'cooling' WHEN rs > 0 THEN 'fading' ELSE 'dormant' END AS state FROM (SELECT p_brand AS theme, count(*) AS n, max(day) AS latest, avg((DATE '2001-09-01' - day <= 90)::INT) AS rs, avg(greatest(0, 1 - (DATE '2001-09-01' - day) / 365.0)) AS rel FROM {m.TRADES_SQL} t WHERE day <= DATE '2001-09-01' GROUP BY 1))"
_LEVELS = "macro, industry, company, idiosyncratic"
_DOMINANT = "CASE WHEN greatest(macro, industry, company, idiosyncratic) = 0 THEN 'contextual' ELSE CASE greatest(macro, industry, company, idiosyncratic) WHEN macro THEN 'macro' WHEN industry THEN 'industry' WHEN company THEN 'company' ELSE 'idiosyncratic' END END"

SQL = {
    "extracted_entities": f"WITH {_H} SELECT id AS entity_id, t AS entity_type, name, first_seen, len(ids)::INT AS n_chunks, sha256(array_to_string(ids, ',')) AS chunks_sha256 FROM ent",
    "extracted_edges": f"WITH {_EDGES} SELECT {_EID} AS edge_id, src, dst, edge_type, confidence, direction, first_seen, len(evidence)::INT AS n_chunks, sha256(array_to_string(evidence, ',')) AS chunks_sha256 FROM edg",
    "extraction_provenance": f"""WITH {_EDGES} SELECT id, NULL::VARCHAR AS explanation, len(ids)::BIGINT AS n, latest FROM ent UNION ALL
SELECT {_EID}, CASE edge_type WHEN 'co_occurs_with' THEN a.name || ' and ' || b.name || ' co-occur in the same chunk.' WHEN 'exposed_to' THEN 'Text indicates ' || a.name || ' is exposed to ' || b.name || '.' WHEN 'sensitive_to' THEN 'Text indicates ' || a.name || ' is sensitive to ' || b.name || '.' WHEN 'causes' THEN 'Text indicates ' || a.name || ' causes ' || b.name || '.' WHEN 'benefits' THEN 'Text indicates ' || a.name || ' benefits from ' || b.name || '.' ELSE 'Text indicates ' || a.name || ' is hurt by ' || b.name || '.' END, evidence[1], NULL FROM edg JOIN ent a ON a.id = src JOIN ent b ON b.id = dst""",
    "reported_claims": f"WITH {_CLAIMS}, {_ROLLED}, c AS (SELECT company, metric, period, is_guidance, count(DISTINCT chunk_id)::INT AS n_chunks FROM found GROUP BY ALL) SELECT company, metric, period, is_guidance, value, unit, direction, confidence::DOUBLE AS confidence, n_chunks FROM rolled JOIN c USING (company, metric, period, is_guidance)",
    "reconciled_claims": f"""WITH {_CLAIMS.replace(f"FROM {NEWS_SQL} x", f"FROM {NEWS_SQL} x WHERE available_at <= DATE '{AS_OF}'")}, {_ROLLED}, d AS (SELECT *, last_day(make_date(substr(period, 4)::INT, CASE WHEN period LIKE 'Q%' THEN substr(period, 2, 1)::INT * 3 ELSE 12 END, 1)) AS period_end FROM rolled)
SELECT company, metric, is_guidance, count(*) AS n, max(period_end) AS last_period FROM d WHERE is_guidance OR NOT (metric = 'revenue' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey % 3 = 0 AND o_custkey % 50 = company AND last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) = period_end)) GROUP BY ALL""",
    "exposure_from_graph": f"""WITH RECURSIVE {_GRAPH}, {_KNOWN}, l AS MATERIALIZED (SELECT ge.* FROM ge WHERE first_seen <= DATE '{AS_OF}' AND method = 'document_stated' AND edge_type <> 'co_occurs_with' AND src IN (SELECT id FROM kn) AND dst IN (SELECT id FROM kn)),
 u AS MATERIALIZED (SELECT src AS node, dst AS other FROM l UNION SELECT dst, src FROM l), b AS (SELECT community AS seed, id AS node, 0 AS dist FROM kn WHERE community <> 'c4' UNION SELECT seed, other, dist + 1 FROM b JOIN u USING (node) WHERE dist < 8),
 pr AS (SELECT seed AS community, node, min(dist) AS dist FROM b WHERE node IN (SELECT id FROM kn WHERE t = 'Company') GROUP BY ALL),
 t AS MATERIALIZED (SELECT community, src AS node, l.* FROM l JOIN gn ON gn.id = dst WHERE community <> 'c4'), a AS (SELECT community, node, sum(confidence) AS c, avg(greatest(0, 1 - (DATE '{AS_OF}' - first_seen) / 365.0)) AS r FROM t GROUP BY ALL),
 k AS MATERIALIZED (SELECT DISTINCT community, node, unnest(evidence) AS chunk FROM t), v AS (SELECT community, node, count(*) AS ev, array_to_string(list_sort(list(chunk))[1:10], ',') AS top FROM k GROUP BY ALL),
 g AS (SELECT node, least(1.0, count(*) / greatest(1, (SELECT count(*) FROM kn) - 1)) AS cen FROM u GROUP BY 1),
 s AS (SELECT pr.community, pr.node, dist, coalesce(c, 0) AS c, coalesce(ev, 0) AS ev, coalesce(r, 0.5) AS r, coalesce(cen, 0) AS cen, coalesce(top, '') AS top FROM pr LEFT JOIN a USING (community, node) LEFT JOIN v USING (community, node) LEFT JOIN g USING (node))
SELECT node AS company_id, 'theme_' || substr(community, 2) AS theme_snapshot_id, round(0.30 / (1 + dist) + 0.25 * CASE WHEN max(c) OVER () > 0 THEN c / max(c) OVER () ELSE 0 END + 0.20 * ln(1 + ev) / ln(1 + greatest(1, max(ev) OVER ())) + 0.15 * r + 0.10 * cen, 6) AS exposure_score, dist::DOUBLE AS graph_distance, round(c, 4) AS edge_confidence_sum, ev AS evidence_count, top AS top_evidence FROM s""",
    "graph_projection": f"""WITH {_GRAPH}, {_KNOWN} SELECT edge_type, polarity::INT AS polarity, count(*) AS n, round(sum(greatest(confidence, 0.01)), 4) AS weight FROM (SELECT *, CASE edge_type WHEN 'exposed_to' THEN CASE length(dst) % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END WHEN 'benefits' THEN 1 ELSE 0 END AS polarity FROM ge WHERE first_seen <= DATE '{AS_OF}' AND src IN (SELECT id FROM kn)) GROUP BY ALL""",
    "projected_impacts": f"""WITH RECURSIVE {_IMPACT}, us AS (SELECT DISTINCT trigger, tip, unnest(path) AS id FROM hit), own AS (SELECT trigger, tip, count(*)::INT AS n_edges, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS evidence FROM us JOIN e USING (id) GROUP BY ALL),
 cf AS (SELECT trigger, tip, avg(weight) AS confidence FROM (SELECT trigger, tip, unnest(path) AS id FROM tot) JOIN e USING (id) GROUP BY ALL)
SELECT trigger AS trigger_id, tip AS company_id, sign(impact)::INT AS direction, round(abs(impact), 6) AS strength, array_to_string(path, ' ') AS path, n_paths, n_edges, evidence, round(confidence, 6) AS confidence FROM tot JOIN own USING (trigger, tip) JOIN cf USING (trigger, tip)""",
    "impact_ranking": f"""WITH RECURSIVE {_IMPACT}, k AS (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY round(abs(impact), 9) DESC, tip) AS position, count(*) OVER (PARTITION BY trigger) AS n FROM tot)
SELECT trigger AS trigger_id, tip AS company_id, position::INT AS position, upper(trigger) AS label, n AS n_companies, (len(path) - 1)::INT AS last_step, false AS sign_blind FROM k WHERE position <= 5""",
    "cleaned_documents": f"""WITH raw AS (SELECT doc_id, available_at, CASE WHEN doc_id % 31 <> 0 THEN source END AS source, CASE WHEN doc_id % 29 <> 0 THEN translate(text, '|<[', '///') || CASE WHEN doc_id % 3 = 0 THEN chr(13) || chr(10) || 'Page 3' || chr(10) || '- 12 -' || chr(10) || 'ACME   Report' || chr(10) || '4 / 9' || chr(10) || 'ACME Report' || chr(10) || chr(10) || chr(10) || chr(10) || 'ACME Report' || chr(10) ELSE '' END END AS raw_text FROM {m.DOCS_SQL} d),
 s2 AS (SELECT *, {_ws("coalesce(raw_text, '')")} AS t2 FROM raw), s3 AS (SELECT *, array_to_string(list_filter(string_split(t2, chr(10)), lambda x: NOT {_PAGE}), chr(10)) AS x3 FROM s2), s4 AS (SELECT *, CASE WHEN x3 = t2 THEN t2 ELSE {_ws("x3")} END AS t4 FROM s3),
 rep AS (SELECT doc_id, list(line) AS often FROM (SELECT doc_id, trim(unnest(string_split(t4, chr(10)))) AS line FROM s4) WHERE line <> '' AND length(line) <= 80 GROUP BY doc_id, line HAVING count(*) >= 3),
 reps AS (SELECT doc_id, flatten(list(often)) AS often FROM rep GROUP BY 1),
 s5 AS (SELECT s4.*, array_to_string(list_filter(string_split(t4, chr(10)), lambda x: NOT list_contains(coalesce(often, []), trim(x))), chr(10)) AS x5 FROM s4 LEFT JOIN reps USING (doc_id)), s6 AS (SELECT *, CASE WHEN x5 = t4 THEN t4 ELSE {_ws("x5")} END AS t6 FROM s5),
 g AS (SELECT *, sha256(t6) AS h, CASE WHEN coalesce(source, '') = '' THEN 'missing_metadata' WHEN available_at > DATE '2024-10-31' THEN 'future_document' WHEN raw_text IS NULL THEN 'unreadable_file' END AS gate FROM s6)
SELECT doc_id AS document_id, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY gate IS NULL, h ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'included' END) AS outcome, h AS content_hash, (2 + (t4 <> t2)::INT + (t6 <> t4)::INT)::INT AS n_steps FROM g""",
    "integrity_suite": f"""WITH d AS (SELECT doc_id AS i, available_at AS a FROM {m.DOCS_SQL} x), v AS (
 SELECT 'PIT_NO_LEAKAGE' AS check_name, 'documents' AS table_name, 'available_at' AS what, count(*) AS n FROM d WHERE i % 43 <> 0 AND a > DATE '2024-12-01' UNION ALL
 SELECT 'PIT_NO_LEAKAGE', 'chunks', 'available_at', count(*) FROM d WHERE CASE WHEN i % 53 = 0 THEN a + 1 WHEN i % 43 <> 0 THEN a END > DATE '2024-12-01' UNION ALL
 SELECT 'PIT_NO_LEAKAGE', 'chunks', 'day differs from that of its', count(*) FROM d WHERE i % 53 = 0 AND i % 47 <> 0 UNION ALL
 SELECT 'REFERENTIAL_INTEGRITY', 'documents', 'raw_document_id', count(*) FROM d WHERE i % 41 = 0 UNION ALL SELECT 'REFERENTIAL_INTEGRITY', 'chunks', 'document_id', count(*) FROM d WHERE i % 47 = 0 UNION ALL
 SELECT 'REFERENTIAL_INTEGRITY', 'edges', 'evidence', count(*) FROM d WHERE i % 37 = 0 UNION ALL SELECT 'SCHEMA_CONFORMANCE', 'documents', unnest(['missing', 'unexpected']), 1 UNION ALL
 SELECT 'NON_NULL', 'documents', 'available_at is', count(*) FROM d WHERE i % 43 = 0 UNION ALL SELECT 'NON_NULL', 'chunks', 'chunk_id is', count(*) FROM d WHERE i % 37 = 0 UNION ALL SELECT 'NON_NULL', 'chunks', 'available_at is', count(*) FROM d WHERE i % 43 = 0 AND i % 53 <> 0 UNION ALL
 SELECT 'RECONCILIATION', 'raw_documents', 'dropped without a', count(*) FROM d WHERE i % 41 = 0 AND length(i::VARCHAR) <= 2) SELECT * FROM v WHERE n > 0""",
    "snapshot_validation": f"""WITH {_PTS2}, {_RETS2}, {EXPO}, {TOP}, bk AS (SELECT theme, as_of, months, sum(weight * ret) / sum(weight) AS ret, count(*) AS n, min(a) AS a, max(b) AS b FROM top JOIN r USING (company_id) WHERE ret IS NOT NULL GROUP BY ALL),
 sec AS (SELECT as_of, months, avg(x) AS v FROM (SELECT as_of, months, CASE WHEN s_nationkey % 4 <> 0 THEN s_nationkey::VARCHAR ELSE 'unknown' END AS s, avg(ret) AS x FROM r JOIN supplier ON s_suppkey = company_id WHERE ret IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 bm AS (SELECT as_of, months, 'equal_weight_universe' AS benchmark, avg(ret) AS v, NULL::VARCHAR AS cv FROM r GROUP BY ALL UNION ALL SELECT as_of, months, 'sector_equal_weight', v, NULL FROM sec UNION ALL SELECT as_of, months, 'hedged_index', NULL, 'hedged_index: not yet implemented; deferred' FROM pts),
 sz AS (SELECT theme, count(*) AS company_count FROM top GROUP BY 1)
SELECT theme, months || 'M' AS forward_window, company_count, coalesce(n, 0) AS sample_size, a AS start_date, b AS end_date, benchmark, round(ret, 6) AS basket_ret, round(v, 6) AS benchmark_ret, round(ret - v, 6) AS excess, true AS illustrative, false AS claim_supported, concat_ws('; ', 'single snapshot: illustrative only, no claim of excess return', cv, 'windows 240M had insufficient forward coverage and were skipped') AS caveats FROM (SELECT * FROM sz, pts) q LEFT JOIN bk USING (theme, as_of, months) JOIN bm USING (as_of, months)""",
    "sector_fallback": f"""WITH pts AS (SELECT DATE '{AS_OF}' AS as_of, 3 AS months), {_RETS2} SELECT as_of, 'sector_equal_weight' AS benchmark, round(avg(ret), 6) AS benchmark_ret, count(ret) AS benchmark_n, 'sector_equal_weight: no sector data available; used equal_weight_universe as fallback' AS benchmark_caveat FROM r GROUP BY as_of""",
    "fixed_basket_walk": f"""WITH pts AS (SELECT * FROM (VALUES (DATE '1998-01-01', 3), (DATE '1998-07-01', 3), (DATE '1999-01-01', 3), (DATE '2001-10-01', 3)) v(as_of, months)), {_RETS2}, {EXPO}, {TOP}, ok AS (SELECT as_of, (SELECT max(l_shipdate::DATE) FROM lineitem) >= as_of + to_months(3) AS covered FROM pts),
 x AS (SELECT as_of, covered, CASE WHEN covered THEN (SELECT avg(ret) FROM r WHERE r.as_of = ok.as_of AND company_id IN (SELECT company_id FROM top)) END AS bk, CASE WHEN covered THEN (SELECT avg(ret) FROM r WHERE r.as_of = ok.as_of) END AS bs FROM ok)
SELECT as_of, round(bk, 6) AS basket_ret, round(bs, 6) AS baseline_ret, round(bk - bs, 6) AS excess, CASE WHEN NOT covered THEN 'insufficient_forward_coverage: prices must reach ' || (as_of + to_months(3))::DATE END AS skipped_reason, count(bk - bs) OVER () AS n_points, round(avg(bk - bs) OVER (), 6) AS mean_excess, round(avg((round(bk - bs, 12) > 0)::INT) OVER (), 6) AS hit_rate, count(bk - bs) OVER () >= 3 AS claim_supported FROM x""",
    "theme_lineage": f"WITH RECURSIVE {_PANEL} SELECT idx, theme, event AS lifecycle_event, confidence, n_parents FROM ev",
    "theme_families": f"WITH RECURSIVE {_PANEL} SELECT fid AS theme_family_id, first, last, 'q' || first AS first_seen, 'q' || last AS last_seen, n_points, (SELECT count(DISTINCT company) FROM r JOIN f2 USING (key) WHERE f2.root = fam.root) AS n_companies FROM fam",
    "panel_report": f"""WITH RECURSIVE {_PANEL} SELECT (SELECT count(*) FROM fam) AS family_count, count(*) FILTER (event = 'emerged') AS emerged, count(*) FILTER (event = 'persisted') AS persisted, count(*) FILTER (event = 'split') AS split, count(*) FILTER (event = 'merged') AS merged, count(*) FILTER (event = 'revived') AS revived,
 (SELECT count(*) FROM fam, (SELECT DISTINCT idx FROM nd) i WHERE i.idx > first AND i.idx < last AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.root = fam.root AND e.idx = i.idx)) AS dormant, (SELECT count(DISTINCT company) FROM r) AS company_count, (SELECT count(*) FROM r) AS n_rows FROM ev""",
    "panel_points": f"WITH RECURSIVE {_PANEL} SELECT i::INT AS idx, 'q' || i AS as_of, t.n IS NOT NULL AS discovery_present, coalesce(t.n, 0) AS theme_count, coalesce(p.n, 0) AS pair_count FROM range(44) g(i) LEFT JOIN (SELECT idx, count(*) AS n FROM nd GROUP BY 1) t ON t.idx = i LEFT JOIN (SELECT idx, count(*) AS n FROM r GROUP BY 1) p ON p.idx = i",
    "theme_levels": f"""WITH {_GRAPH}, x AS (SELECT community, CASE WHEN t = 'Company' THEN CASE WHEN length(id) % 2 = 0 THEN 'company' ELSE 'industry' END ELSE ['macro', 'contextual', 'idiosyncratic'][length(id) % 3 + 1] END AS lv FROM gn),
 c AS (SELECT community, count(*) AS size, count(*) FILTER (lv = 'macro') AS macro, count(*) FILTER (lv = 'industry') AS industry, count(*) FILTER (lv = 'company') AS company, count(*) FILTER (lv = 'idiosyncratic') AS idiosyncratic FROM x GROUP BY 1),
 s AS (SELECT a.community, round(avg(confidence), 4) AS strength FROM ge JOIN gn a ON a.id = src JOIN gn b ON b.id = dst WHERE a.community = b.community GROUP BY 1), l AS (SELECT community, size, {_LEVELS}, round(coalesce(strength, 0), 4) AS strength FROM c LEFT JOIN s USING (community)),
 mn AS (SELECT h.mt, sum(macro)::BIGINT AS macro, sum(industry)::BIGINT AS industry, sum(company)::BIGINT AS company, sum(idiosyncratic)::BIGINT AS idiosyncratic, sum((size >= 3 AND strength > 0)::INT)::BIGINT AS k FROM l JOIN (VALUES ('odd', 'c1'), ('odd', 'c3'), ('even', 'c0'), ('even', 'c2'), ('even', 'c4'), ('even', 'nothing')) h(mt, community) USING (community) GROUP BY 1)
SELECT community AS theme, {_LEVELS}, {_DOMINANT} AS dominant, strength::DOUBLE AS strength, size FROM l UNION ALL SELECT mt, {_LEVELS}, {_DOMINANT}, NULL, k FROM mn""",
    "main_theme_relevance": f"WITH x AS (SELECT substr(theme, 1, 7) AS main_theme, * FROM {_RELEVANCE} z), b AS (SELECT *, row_number() OVER (PARTITION BY main_theme ORDER BY relevance DESC, theme) AS rn, max(latest) OVER (PARTITION BY main_theme) AS l, count(*) OVER (PARTITION BY main_theme) AS k FROM x) SELECT main_theme, relevance AS relevance_score, state, l AS last_evidence_at, k AS sub_theme_count FROM b WHERE rn = 1",
    "panel_entities": f"""WITH {_H}, p AS (SELECT unnest([{", ".join(f"DATE '{x}'" for x in PANEL)}]) AS as_of)
SELECT as_of, 'ent_' || substr(sha256('entity:' || t || ':' || lower(name)), 1, 16) AS entity_id, t AS entity_type, count(DISTINCT text)::INT AS n_chunks FROM h JOIN p ON available_at <= as_of GROUP BY as_of, t, lower(name)""",
    "monthly_partitions": """WITH e AS (SELECT 's' || l_suppkey AS src, p_brand || '|' || p_type AS dst, min(l_shipdate::DATE) AS fs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 d AS (SELECT min(fs) AS first, max(fs) AS last FROM e), m AS (SELECT least(last_day(x::DATE), last) AS month_end FROM (SELECT unnest(generate_series(date_trunc('month', first), last, INTERVAL 1 MONTH)) AS x, last FROM d)),
 l AS (SELECT month_end, src, dst FROM e JOIN m ON fs <= month_end), n AS (SELECT month_end, count(*) AS n FROM (SELECT month_end, src FROM l UNION SELECT month_end, dst FROM l) GROUP BY 1)
SELECT month_end, n AS n_nodes, count(*) AS n_links, n AS placed_once, n AS sum_of_sizes, 0 AS first_community, true AS no_worse_than_one, true AS inside_is_part FROM l JOIN n USING (month_end) GROUP BY ALL""",
    "trajectories_by_month": """WITH t AS (SELECT last_day(l_shipdate::DATE) AS month_end, l_suppkey AS node, min(l_partkey % 40) AS community FROM lineitem GROUP BY 1, 2),
 z AS (SELECT month_end, community, count(*) AS size FROM t GROUP BY ALL), x AS (SELECT max(month_end) AS last FROM t), f AS (SELECT community AS theme, size AS size_now, last FROM z JOIN x ON month_end = last WHERE size >= 3),
 s AS (SELECT theme, b.month_end, b.community, count(*) AS overlap FROM f JOIN t a ON a.month_end = last AND a.community = theme JOIN t b ON b.node = a.node GROUP BY ALL),
 g AS (SELECT theme, month_end, max({'overlap': overlap, 'size': size}) AS best FROM s JOIN z USING (month_end, community) GROUP BY ALL),
 r AS (SELECT f.theme, m.month_end, size_now, last, coalesce(best.overlap, 0) AS overlap, coalesce(best.size, 0) AS size FROM f CROSS JOIN (SELECT DISTINCT month_end FROM z) m LEFT JOIN g ON g.theme = f.theme AND g.month_end = m.month_end),
 w AS (SELECT theme, coalesce(min(CASE WHEN size >= 3 THEN month_end END), any_value(last)) AS emerged, list(size ORDER BY month_end) AS l FROM r GROUP BY 1)
SELECT theme, month_end, overlap, size, emerged, l[-1] - coalesce(l[-2], l[-1]) AS momentum, size_now FROM r JOIN w USING (theme)""",
    "subgraph_of_communities": f"WITH {_GRAPH}, w AS (SELECT * FROM gn WHERE community IN ('c1', 'c3')) SELECT CASE t WHEN 'Company' THEN 'company' ELSE 'contextual' END AS kind, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT edge_type, count(*) FROM ge WHERE edge_type <> 'co_occurs_with' AND src IN (SELECT id FROM w) AND dst IN (SELECT id FROM w) GROUP BY 1",
    "theme_names": f"WITH {_GRAPH}, k AS (SELECT community, t = 'Company' AS c, list_sort(list(DISTINCT name))[1:5] AS l FROM gn GROUP BY ALL), z AS (SELECT community, coalesce(any_value(l) FILTER (NOT c), []) AS te, coalesce(any_value(l) FILTER (c), []) AS tc FROM k GROUP BY 1) SELECT community, array_to_string((CASE WHEN len(te) > 0 THEN te ELSE tc END)[1:3], ' + ') AS theme_name, array_to_string(te, ';') AS top_entities, array_to_string(tc, ';') AS top_companies FROM z",
    "evidence_snippets": f"""WITH n AS (SELECT chunk_id, {_SUBJECTS}[chunk_id % 6 + 1] AS src, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS l FROM {NEWS_SQL} x),
 s AS (SELECT chunk_id, i, trim(l[i]) AS s, (contains(lower(l[i]), lower(src)))::INT + (contains(lower(l[i]), 'revenue'))::INT AS h FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM n)),
 k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY h DESC, length(s), i) AS rn, max(h) OVER (PARTITION BY chunk_id) AS top FROM s)
SELECT chunk_id, substr(coalesce(string_agg(s, ' … ' ORDER BY rn) FILTER (h > 0 AND rn <= 2), min(s) FILTER (i = 1)), 1, 260) AS snippet FROM k GROUP BY chunk_id""",
    "chunk_sources": """WITH c AS MATERIALIZED (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, 'part ' || l_partkey AS t FROM lineitem), w AS (SELECT o, string_agg(t, chr(10) ORDER BY k) AS d FROM c GROUP BY o)
SELECT c.o || '-' || k AS chunk_id, t AS chunk_text, 'd' || c.o AS document_id, CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS title, CASE WHEN o_orderkey IS NOT NULL THEN 'edgar' END AS source, CASE WHEN o_orderkey IS NOT NULL THEN '10-k' END AS document_type, o_orderdate::DATE AS published_at, CASE WHEN o_orderkey IS NOT NULL THEN 'u/' || c.o END AS source_url, sha256(d) AS document_sha256 FROM c JOIN w USING (o) LEFT JOIN orders ON o_orderkey = c.o""",
    "theme_dossier": f"""WITH {_GRAPH}, i AS (SELECT a.community, a.name AS s, b.name AS t, edge_type, confidence FROM ge JOIN gn a ON a.id = src JOIN gn b ON b.id = dst WHERE a.community = b.community AND edge_type <> 'co_occurs_with'), o AS (SELECT community, any_value(s) AS s, any_value(t) AS t, edge_type, max(confidence) AS c FROM i GROUP BY community, lower(s), lower(t), edge_type)
SELECT community, place::INT AS place, s AS source, t AS target, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY c DESC, lower(s), lower(t), edge_type) AS place FROM o) WHERE place <= 12""",
    "news_selection": """SELECT page_id % 9 AS company_id, url, 'Story ' || page_id AS title, DATE '2024-01-01' + (page_id % 300)::INT AS published_at, substr(sha256(url), 1, 16) AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 9, url ORDER BY page_id % 300, 'Story ' || page_id) AS n FROM pages WHERE page_id % 6 > 1 AND DATE '2024-01-01' + (page_id % 300)::INT <= DATE '2024-06-30' AND (page_id % 10) / 10.0 >= 0.3 AND page_id % 9 <> 4) WHERE n = 1""",
    "filing_paths": """WITH f AS (SELECT o_orderkey AS k, '0001-98-' || lpad(o_orderkey::VARCHAR, 9, '0') AS a FROM orders) SELECT a AS source_id, CASE WHEN k % 4 = 0 AND k % 5 <> 0 THEN 'f' || k || '.htm' WHEN k % 4 = 1 AND k % 5 <> 0 THEN 'f' || k || '.txt' WHEN k % 4 = 2 THEN replace(a, '-', '') || '.txt' WHEN k % 5 <> 0 THEN 'f' || k || '.htm' ELSE a || '.txt' END AS raw_path FROM f""",
    "linked_steps": "SELECT n_name AS source, n_regionkey::VARCHAR AS target, 'causes' AS edge_type, CASE WHEN n_nationkey % 3 <> 0 THEN e END AS evidence_chunk_id, CASE WHEN n_nationkey % 3 <> 0 AND e IS NOT NULL THEN 'document_stated' ELSE 'llm_inferred' END AS method FROM nation LEFT JOIN (SELECT c_nationkey, min('k' || lpad(c_custkey::VARCHAR, 9, '0')) AS e FROM customer GROUP BY 1) ON c_nationkey = n_nationkey",
    "model_calls": "SELECT event_type AS task, 'm' || user_id % 3 AS model, count(*) AS n_calls, count(*) FILTER (event_id % 11 = 0) AS n_failed, count(*) FILTER (event_id % 4 = 0) AS n_cached, round(avg((event_id % 100)::DOUBLE), 3) AS mean_latency_ms FROM events GROUP BY ALL",
}
