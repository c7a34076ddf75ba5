"""DuckDB SQL for the operations that SQL can express over whole tables."""

from __future__ import annotations

from narrascope.llm.quality import COMMON_WORDS
from narrascope.llm.urlrules import BELOW, FLOOR, LEAST, LOWER, MOST, RULES, UPPER, Z

_LOW = "translate({}, '" + UPPER + "', '" + LOWER + "')"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
 u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT DISTINCT x AS node, x AS reach FROM u UNION SELECT r.node, u.y FROM r JOIN u ON r.reach = u.x),
 m AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON node = d.doc_id"""

_LIST = "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]"
_N = len(COMMON_WORDS)
_JS = """CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
 (CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2(({p}[i] / list_sum({p})) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END
 + CASE WHEN {q}[i] > 0 THEN {q}[i] / list_sum({q}) * log2(({q}[i] / list_sum({q})) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END) / 2)))) END"""
OP2 = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM t WHERE len(w) >= 3)),
 p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE times > 1) GROUP BY 1),
 b AS (SELECT doc_id, lang, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(p.n, 0) AS n_repeat_words,
   list_transform(w, lambda x: lower(x)) AS lw FROM t LEFT JOIN p USING (doc_id)),
 k AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
   [len(regexp_extract_all(text, '\p{{Lu}}')), len(regexp_extract_all(text, '[0-9]')), len(regexp_extract_all(text, '[.,;:!?''"()\-]')), len(regexp_extract_all(text, '[^\x00-\x7F]')), n_chars - word_chars, n_symbols] AS c,
   list_transform({_LIST}, lambda v: len(list_filter(lw, lambda x: x = v))) AS m FROM b),
 f AS (SELECT *, list_transform(list_append(c, greatest(0, n_chars - list_sum(c))), lambda v: floor(v * 1000000 / greatest(n_chars, 1))::DOUBLE) AS cs,
   list_transform(list_append(m, greatest(0, n_words - list_sum(m))), lambda v: floor(v * 1000000 / greatest(n_words, list_sum(m), 1))::DOUBLE) AS ms FROM k),
 r AS (SELECT lang, [{", ".join(f"sum(cs[{i}])" for i in range(1, 8))}] AS rc, [{", ".join(f"sum(ms[{i}])" for i in range(1, _N + 2))}] AS rm FROM f WHERE NOT base_failed GROUP BY lang),
 j AS (SELECT f.*, CASE WHEN n_chars >= 400 THEN {_JS.format(p="cs", q="rc")} END AS cd, CASE WHEN n_words >= 80 THEN {_JS.format(p="ms", q="rm")} END AS md FROM f LEFT JOIN r USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(cd > 0.3, false) AND NOT coalesce(md > 0.28, false) AS kept, round(cd, 6) AS class_distance, round(md, 6) AS word_distance FROM j"""

_R = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))


def _kappa(level: str) -> str:
    return f"""(SELECT least({MOST}, greatest({LEAST}, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {MOST} END)) FROM (SELECT (sum(k * k / n) - 2 * any_value(m0) * sum(k) + any_value(m0) * any_value(m0) * sum(n) - any_value(m0) * (1 - any_value(m0)) * (count(*) - 1))
 / nullif(any_value(m0) * (1 - any_value(m0)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)), 0) AS rho FROM {level}, m))"""


OP7 = rf"""WITH b AS (SELECT page_id, {_LOW.format(f"coalesce(regexp_extract(url, {_R}, 1), '')")} AS host, coalesce(regexp_extract(url, {_R}, 2), '') AS path FROM pages),
 x AS (SELECT DISTINCT host, CASE WHEN regexp_matches(host, '[^.]+\.{BELOW}$') THEN regexp_extract(host, '([^.]+\.{BELOW})$', 1) WHEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+\.[^.]+)$', 1) END AS domain,
   CASE WHEN regexp_matches(host, '(^|\.){BELOW}$') THEN regexp_extract(host, '(?:^|\.)({BELOW})$', 1) ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM b),
 h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE AS k FROM b JOIN labels ON doc_id = page_id JOIN x USING (host) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY host),
 d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain), s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
 m AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m0 FROM s),
 q AS (SELECT {_kappa("s")} AS ks, {_kappa("d")} AS kd, {_kappa("h")} AS kh),
 e AS (SELECT x.host, coalesce((s.k + ks * m0) / (s.n + ks), m0) AS ms, coalesce(d.n, 0) AS nd, coalesce(d.k, 0) AS dk, coalesce(h.n, 0) AS nh, coalesce(h.k, 0) AS hk, kd, kh FROM x LEFT JOIN h USING (host) LEFT JOIN d ON d.domain = x.domain LEFT JOIN s ON s.suffix = x.suffix, m, q),
 v AS (SELECT host, nh, kh, (hk + kh * (dk + kd * ms) / (nd + kd)) / (nh + kh) AS mean FROM e),
 f AS (SELECT page_id, host, path, CASE {_CASES} END AS r FROM b)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN mean + {Z} * sqrt(mean * (1 - mean) / (nh + kh + 1)) < {FLOOR} THEN 'block' ELSE 'allow' END) AS verdict FROM f JOIN v USING (host)"""

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"
OP9 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) r(i)),
 a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<turn role="">') + length({_ESC.format("role")}) + 1 + length({_ESC.format("text")}) + length('</turn>') + 1)::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_ROW = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32 of a text of digits, bit by bit, as DuckDB has no function for it.
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
 lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c & 255, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))))"""
_BESIDE = "coalesce(string_agg(h, '') OVER ({0} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({0} ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
OP11 = f"""WITH RECURSIVE i AS (SELECT doc_id, coalesce('=' || source, '') AS k, sha256({_ROW} || {_FIELD.format("text")}) AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN sha256({_ROW} || {_FIELD.format(_LOW.format("text"))}) END AS changed FROM documents),
 d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY k) AS n FROM i),
 a AS (SELECT k, 0 AS lv, p, leaf AS h, n FROM d UNION ALL SELECT k, lv + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (max(n) + 15) // 16 FROM a WHERE n > 1 GROUP BY k, lv, p // 16),
 s AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS p, count(*) OVER () AS n FROM a WHERE n = 1),
 b AS (SELECT 0 AS lv, p, subroot AS h, n FROM s UNION ALL SELECT lv + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (max(n) + 15) // 16 FROM b WHERE n > 1 GROUP BY lv, p // 16),
 ea AS (SELECT k, lv, p, {_BESIDE.format("PARTITION BY k, lv, p // 16")} FROM a WHERE n > 1),
 eb AS (SELECT lv, p, {_BESIDE.format("PARTITION BY lv, p // 16")} FROM b WHERE n > 1),
 fa AS (SELECT k, p AS place, 0 AS lv, p, coalesce(changed, leaf) AS h, '' AS proof FROM d UNION ALL SELECT k, place, lv + 1, p // 16, sha256(l || h || r), proof || l || r FROM fa JOIN ea USING (k, lv, p)),
 ga AS (SELECT k, place, arg_max(h, lv) AS h, arg_max(proof, lv) AS proof FROM fa GROUP BY ALL),
 fb AS (SELECT k, place, 0 AS lv, s.p, h, proof FROM ga JOIN s USING (k) UNION ALL SELECT k, place, lv + 1, p // 16, sha256(l || h || r), proof || l || r FROM fb JOIN eb USING (lv, p)),
 gb AS (SELECT k, place, arg_max(h, lv) AS folded, arg_max(proof, lv) AS proof FROM fb GROUP BY ALL),
 t AS (SELECT h AS root FROM b WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM d JOIN s USING (k) JOIN gb ON gb.k = d.k AND place = d.p, t"""


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and update as one CTE each: c0, c1, ... are the centroids, x0, x1, ... what goes to them."""
    near = "SELECT id, row, q, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT id, row, q, j, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2])::HUGEINT * (z[1] - z[2])))::HUGEINT AS d FROM v, c{0}) GROUP BY ALL"
    floor = "((s - (s % n + n) % n) // n)"
    step = "SELECT c{0}.j, coalesce(m.c, c{0}.c) AS c FROM c{0} LEFT JOIN (SELECT j, list(" + floor + "::BIGINT ORDER BY i) AS c FROM (SELECT j, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT j, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM x{0}) GROUP BY ALL) GROUP BY j) m USING (j)"
    parts = [part for r in range(rounds) for part in (f"x{r} AS ({near.format(r)})", f"c{r + 1} AS ({step.format(r)})")]
    return ",\n ".join([*parts, f"x{rounds} AS ({near.format(rounds)})"])


OP12 = f"""WITH v AS (SELECT vec_id AS id, row_number() OVER () AS row, embedding AS e, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
 c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(id::VARCHAR, '')), e) - 1 AS j, q AS c FROM v ORDER BY 1 LIMIT 16),
 {_lloyd(3)}
SELECT id AS vec_id, j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM x3 JOIN c3 USING (j)"""

ORACLE = {"op11_merkle_manifest": OP11, "op12_centroid_clusters": OP12, "op1_ngram_jaccard": OP1, "op2_quality_rules": OP2, "op7_url_reputation": OP7, "op9_chat_formatting": OP9}
