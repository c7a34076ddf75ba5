"""Queries of the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrascope.operators import anchors, pit, serving
from narrascope.plans import mapping as m
from narrascope.plans.text_queries import _FUSE, fusion_matrix

AS_OF = "1998-01-01"


def ordered_provenance(spark, d):
    rows = m.table(spark, d, "orders").select("o_orderkey", F.array(*[((F.col("o_orderkey") * k + F.col("o_custkey")) % 900).alias("c") for k in (3, 5, 7, 11)]).alias("evidence"))
    chunks = m.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 60).alias("document_id"))
    out = serving.ordered_documents(rows, "o_orderkey", chunks)
    return out.select("o_orderkey", F.array_join(F.transform("documents", lambda x: x.cast("string")), ",").alias("documents"))


def alias_builder(spark, d):
    e = m.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.substring("n_name", 1, 3)).alias("ticker"))
    short = m.table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("long_name"), F.substring("n_name", 1, 3).alias("short_name"))
    return serving.alias_rows(e, short)


def signal_integration(spark, d):
    signals = pit.latest_signal(m.series(spark, d), "event_type", "obs_date", "value", "2024-01-28", lag_days=5, back_days=10)
    signals = signals.select(F.col("event_type").alias("series"), "trend", F.concat(F.lit(" Sector  "), F.length("event_type") % 5, F.lit(" ")).alias("sector"))
    universe = m.table(spark, d, "supplier").select(F.col("s_name").alias("company"), F.concat(F.lit("sector "), F.col("s_nationkey") % 5).alias("sector"))
    return serving.signal_edges(signals, universe, "2024-01-28")


def leftover_themes(spark, d):
    p = m.table(spark, d, "part")
    mapping = p.where("p_size > 45 AND p_brand LIKE '%1'").select(F.col("p_brand").alias("theme"), F.col("p_type").alias("main_theme"))
    return serving.leftover_group(p.select(F.col("p_brand").alias("theme")), mapping)


def best_fact_per_chunk(spark, d):
    o = m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_discount").alias("confidence"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return serving.best_per(o, "chunk", "confidence", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("chunk", "confidence", "l_partkey")


def community_match(spark, d):
    t = m.trades(spark, d)
    monthly = t.select(F.trunc("day", "month").alias("month"), F.col("p_brand").alias("community"), F.col("l_suppkey").alias("member")).distinct()
    final = m.table(spark, d, "supplier").select((F.col("s_nationkey") % 6).alias("theme"), F.col("s_suppkey").alias("member"))
    return serving.match_by_overlap(final, monthly)


def gap_revival(spark, d):
    o = m.table(spark, d, "orders")
    families = o.groupBy((F.col("o_custkey") % 60).alias("family")).agg(F.min(F.year("o_orderdate") - 1990).alias("first"), (F.min(F.year("o_orderdate") - 1990) + F.max("o_custkey") % 2).alias("last")).withColumn("first", (F.col("first") + F.col("family") % 4).cast("int")).withColumn("last", (F.col("last") + F.col("family") % 4).cast("int"))
    members = o.select((F.col("o_custkey") % 60).alias("family"), F.col("o_orderpriority").alias("member")).distinct()
    return serving.revivals(families, members).select("family", "revived", "jaccard")


def anchor_lookup(spark, d):
    nodes = m.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_name").alias("label"))
    wanted = m.table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("n"), "n_nationkey")).when(F.col("n_nationkey") % 4 == 1, F.lower("n_name")).when(F.col("n_nationkey") % 4 == 2, F.substring("n_name", 2, 4)).otherwise(F.lit("zzz")).alias("wanted")).distinct()
    return anchors.resolve(nodes, wanted)


def anchor_candidates(spark, d):
    """Parts found by pieces of the names of all parts, and by whole ones."""
    p = m.table(spark, d, "part")
    nodes = p.select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("node_id"), F.concat_ws(" ", "p_name", "p_type", "p_partkey").alias("label"))
    cut = F.substring("label", F.expr("CAST(length(label) % 3 + 1 AS INT)"), F.expr("CAST(length(label) % 7 + 4 AS INT)"))
    key = F.expr("CAST(substring(node_id, 2) AS BIGINT)")
    wanted = nodes.select(F.when(key % 5 == 0, F.upper("label")).when(key % 5 == 1, F.concat(cut, F.lit("#"))).otherwise(F.substring("label", -9, 9)).alias("wanted")).distinct()
    found = anchors.candidates(wanted, anchors.label_index(nodes))
    return found.select("wanted", "n", F.array_join("node_ids", ",").alias("node_ids"))


def reading_order(spark, d):
    rows = fusion_matrix(spark, d).join(m.documents(spark, d).select("doc_id", "source", "available_at"), "doc_id")
    return serving.readings(rows, "source", 5).select("source", "position", "doc_id", "agreement")


def company_profile(spark, d):
    t = m.trades(spark, d).where(pit.known_at(F.col("day"), AS_OF))
    e = t.groupBy(F.col("l_suppkey").alias("company_id"), F.col("p_brand").alias("theme")).agg(F.round(F.sum("l_discount"), 4).alias("exposure"))
    return serving.company_profile(e, t.select(F.col("l_suppkey").alias("company_id"), "day"))


_SIG = f"""(SELECT event_type, CASE WHEN value - prior > band THEN 'rising' WHEN prior - value > band THEN 'falling' ELSE 'flat' END AS trend FROM (SELECT event_type, value, prior, CASE WHEN prior = 0 THEN 0.001 ELSE abs(prior) * 0.01 END AS band FROM (
 SELECT n.event_type, any_value(n.value) AS value, coalesce(max_by(s.value, s.obs_date) FILTER (s.obs_date <= n.obs_date - 10), any_value(n.value)) AS prior FROM (SELECT event_type, max(obs_date) AS obs_date, max_by(value, obs_date) AS value FROM {m.SERIES_SQL} x WHERE obs_date <= DATE '2024-01-28' - 5 GROUP BY 1) n
 JOIN {m.SERIES_SQL} s ON s.event_type = n.event_type AND s.obs_date <= DATE '2024-01-28' - 5 GROUP BY n.event_type)))"""
SQL = {
    "ordered_provenance": "WITH e AS (SELECT o_orderkey, k.p AS pos, (o_orderkey * k.m + o_custkey) % 900 AS c FROM orders, (VALUES (0, 3), (1, 5), (2, 7), (3, 11)) k(p, m)), f AS (SELECT o_orderkey, doc_id % 60 AS d, min(pos) AS pos FROM e JOIN documents ON doc_id = c GROUP BY ALL) SELECT o_orderkey, string_agg(d::VARCHAR, ',' ORDER BY pos) AS documents FROM f GROUP BY o_orderkey",
    "alias_builder": "SELECT entity_id, alias, max(confidence)::DOUBLE AS confidence FROM (SELECT 'n' || n_nationkey AS entity_id, n_name AS alias, 1.0 AS confidence FROM nation UNION ALL SELECT 'n' || n_nationkey, substr(n_name, 1, 3), 0.99 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'n' || n_nationkey, substr(n_name, 1, 3), 0.95 FROM nation WHERE n_nationkey % 3 = 0) GROUP BY ALL",
    "signal_integration": f"SELECT a AS src, b AS dst, 'edge_' || substr(sha256('edge:' || a || ':' || b || ':sensitive_to'), 1, 16) AS edge_id, trend, DATE '2024-01-28' AS first_seen FROM (SELECT 'ent_' || substr(sha256('entity:MacroIndicator:' || lower(event_type)), 1, 16) AS a, 'ent_' || substr(sha256('entity:Company:' || lower(s_name)), 1, 16) AS b, trend FROM {_SIG} g JOIN supplier ON s_nationkey % 5 = length(event_type) % 5)",
    "leftover_themes": "SELECT theme, coalesce(mt, 'Other narratives') AS main_theme FROM (SELECT DISTINCT p_brand AS theme FROM part) LEFT JOIN (SELECT p_brand AS theme, min(p_type) AS mt FROM part WHERE p_size > 45 AND p_brand LIKE '%1' GROUP BY 1) USING (theme)",
    "best_fact_per_chunk": "SELECT l_orderkey AS chunk, l_discount AS confidence, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1",
    "community_match": f"""WITH mo AS (SELECT DISTINCT date_trunc('month', day)::DATE AS month, p_brand AS community, l_suppkey AS member FROM {m.TRADES_SQL} t),
 s AS (SELECT month, community, count(*) AS size FROM mo GROUP BY ALL), o AS (SELECT s_nationkey % 6 AS theme, month, community, count(*) AS overlap FROM mo JOIN supplier ON s_suppkey = member GROUP BY ALL)
SELECT theme, month, community, overlap, size FROM (SELECT *, row_number() OVER (PARTITION BY theme, month ORDER BY overlap DESC, size DESC, community) AS n FROM o JOIN s USING (month, community)) WHERE n = 1""",
    "gap_revival": """WITH f AS (SELECT o_custkey % 60 AS family, (min(year(o_orderdate)) - 1990 + o_custkey % 60 % 4)::INT AS first, (min(year(o_orderdate)) - 1990 + max(o_custkey) % 2 + o_custkey % 60 % 4)::INT AS last FROM orders GROUP BY o_custkey % 60),
 m AS (SELECT DISTINCT o_custkey % 60 AS family, o_orderpriority AS member FROM orders), s AS (SELECT family, count(*) AS n FROM m GROUP BY 1),
 c AS (SELECT a.family, b.family AS revived, count(*) AS both_n FROM m a JOIN m b USING (member) WHERE a.family <> b.family GROUP BY ALL)
SELECT c.family, revived, round(both_n / (s.n + t.n - both_n), 6) AS jaccard FROM c JOIN f ON f.family = c.family JOIN f g ON g.family = revived JOIN s ON s.family = c.family JOIN s t ON t.family = revived WHERE g.first > f.last + 1 AND both_n / (s.n + t.n - both_n) >= 0.5""",
    "anchor_lookup": """WITH w AS (SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN 'n' || n_nationkey WHEN 1 THEN lower(n_name) WHEN 2 THEN substr(n_name, 2, 4) ELSE 'zzz' END AS wanted FROM nation),
 f AS (SELECT wanted, 'n' || n_nationkey AS node_id, 1 AS rank FROM w JOIN nation ON wanted = 'n' || n_nationkey UNION ALL SELECT wanted, 'n' || n_nationkey, 2 FROM w JOIN nation ON lower(wanted) = lower(n_name)
  UNION ALL SELECT wanted, min('n' || n_nationkey), 3 FROM w JOIN nation ON contains(lower(n_name), lower(wanted)) GROUP BY wanted HAVING count(*) = 1)
SELECT w.wanted, g.node_id, coalesce(['id', 'label', 'part'][g.rank], 'none') AS how FROM w LEFT JOIN (SELECT wanted, first(node_id ORDER BY rank, node_id) AS node_id, min(rank) AS rank FROM f GROUP BY wanted) g USING (wanted)""",
    "anchor_candidates": """WITH p AS (SELECT 'p' || lpad(p_partkey::VARCHAR, 9, '0') AS node_id, p_name || ' ' || p_type || ' ' || p_partkey AS label, p_partkey AS k FROM part),
 w AS (SELECT DISTINCT CASE WHEN k % 5 = 0 THEN upper(label) WHEN k % 5 = 1 THEN substr(label, (length(label) % 3 + 1)::INT, (length(label) % 7 + 4)::INT) || '#' ELSE right(label, 9) END AS wanted FROM p),
 f AS (SELECT wanted, node_id, row_number() OVER (PARTITION BY wanted ORDER BY node_id) AS r FROM w JOIN p ON contains(lower(label), lower(wanted)))
SELECT wanted, count(*) AS n, string_agg(node_id, ',' ORDER BY node_id) FILTER (r <= 10) AS node_ids FROM f GROUP BY wanted""",
    "reading_order": f"SELECT source, position::INT AS position, doc_id, agreement FROM (SELECT source, doc_id, agreement, row_number() OVER (PARTITION BY source ORDER BY CASE agreement WHEN 'conflict' THEN 0 WHEN 'hedged' THEN 1 ELSE 2 END, available_at DESC, doc_id) AS position FROM {_FUSE} f JOIN {m.DOCS_SQL} d USING (doc_id)) WHERE position <= 5",
    "company_profile": f"""WITH t AS (SELECT * FROM {m.TRADES_SQL} x WHERE day <= DATE '{AS_OF}'), e AS (SELECT l_suppkey AS company_id, p_brand AS theme, round(sum(l_discount), 4) AS exposure FROM t GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY exposure DESC, theme) AS k FROM e)
SELECT company_id, themes, n_facts, latest FROM (SELECT company_id, string_agg(theme, ' + ' ORDER BY k) AS themes FROM k WHERE k <= 3 GROUP BY 1) JOIN (SELECT l_suppkey AS company_id, count(*) AS n_facts, max(day) AS latest FROM t GROUP BY 1) USING (company_id)""",
}
QUERIES = {name: globals()[name] for name in SQL}
