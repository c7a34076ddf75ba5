"""Queries on the graph, its themes and their history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrascope.operators import evidence, graph, market, panel, pit
from narrascope.plans import mapping as m

AS_OF = "1998-01-01"


def _nodes(spark, d):
    s = m.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("Company").alias("node_type"), F.expr("date_add(DATE '1997-06-01', CAST(s_suppkey % 400 AS INT))").alias("first_seen"))
    p = m.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.when(F.col("p_size") % 4 == 0, "Person").when(F.col("p_size") % 4 == 1, "Commodity").otherwise("EconomicConcept").alias("node_type"), F.lit("1997-01-01").cast("date").alias("first_seen"))
    return s.unionByName(p)


def bipartite_edges(spark, d):
    kinds = F.array(F.lit("causes"), F.lit("mentions"), F.lit("exposed_to"))
    methods = F.array(F.lit("document_stated"), F.lit("llm_inferred"), F.lit("metadata_inferred"))
    e = m.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.get(kinds, (F.col("l_orderkey") % 3).cast("int")).alias("edge_type"), F.get(methods, (F.col("l_linenumber") % 3).cast("int")).alias("method"), F.to_date("l_shipdate").alias("first_seen"))
    return graph.bipartite_edges(_nodes(spark, d), e, AS_OF).groupBy("src", "src_type", "dst_type").agg(F.count("*").alias("n"))


def degree_centrality(spark, d):
    e = m.links(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("x")).distinct().count()
    return graph.degree_centrality(e, n)


def _members(spark, d):
    ends = m.links(spark, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.withColumn("community", F.substring("node", 2, 9).cast("long") % 7)


def _weigh(links):
    return links.withColumn("weight", (F.substring("src", 2, 9).cast("long") * 31 + F.substring("dst", 2, 9).cast("long") * 17) % 101 / 100.0)


def _weighted(spark, d):
    return _weigh(m.links(spark, d))


def density_strength(spark, d):
    return graph.community_metrics(_members(spark, d), _weighted(spark, d))


def _seeds(spark, d):
    return m.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("seed"), F.concat(F.lit("s"), "s_suppkey").alias("node"))


def multi_source_bfs(spark, d):
    """From the suppliers of each nation at once."""
    return graph.bfs(_seeds(spark, d), m.links(spark, d), 4).groupBy("seed", "dist").agg(F.count("*").alias("n"))


def bounded_slice(spark, d):
    return graph.bounded_slice(_weighted(spark, d), "s1", depth=2, most_nodes=40, least_weight=0.1)


def _signed(spark, d):
    a = m.table(spark, d, "customer")
    n, key = a.count(), F.col("c_custkey")
    e = a.select(F.concat(F.lit("c"), key).alias("src"), F.explode(F.array(*[F.concat(F.lit("c"), (key * k + k) % n) for k in (2, 3, 5)])).alias("dst"))
    n = F.substring("src", 2, 9).cast("long") + F.substring("dst", 2, 9).cast("long")
    return e.distinct().withColumn("polarity", (n % 3 - 1).cast("int")).withColumn("weight", F.greatest(F.lit(0.01), (n % 10) / 10.0))


def signed_propagation(spark, d):
    """Every customer is a trigger; those of all segments but one are companies."""
    nodes = m.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), "c_mktsegment")
    return graph.propagate(nodes.select("node"), _signed(spark, d), nodes.where("c_mktsegment != 'MACHINERY'").select("node"))


def connected_components(spark, d):
    """Each order tied to the next one of its customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = m.table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")
    return graph.connected_components(o)


def louvain_communities(spark, d):
    """All links of the table; one point."""
    e = _weigh(m.links(spark, d)).withColumn("as_of", F.lit(AS_OF))
    return graph.communities(e, ["as_of"])


def exposure_score(spark, d):
    t = m.trades(spark, d).where(pit.known_at(F.col("day"), AS_OF))
    s = t.groupBy(F.col("p_brand").alias("theme"), F.col("l_suppkey").alias("company_id")).agg(F.round(F.sum("l_discount"), 4).alias("confidence"), F.count("*").alias("evidence"), F.round(F.avg(graph.recency(F.col("day"), F.lit(AS_OF).cast("date"))), 9).alias("recency"))
    s = s.withColumn("dist", (F.col("company_id") % 3).cast("int")).withColumn("centrality", (F.col("company_id") % 10) / 10.0).withColumn("as_of", F.lit(AS_OF))
    return graph.exposure_score(s, ["as_of"]).select("theme", "company_id", "exposure")


def level_composition(spark, d):
    level = F.get(F.array(F.lit("macro"), F.lit("industry"), F.lit("company"), F.lit("idiosyncratic")), (F.col("p_size") % 4).cast("int"))
    return panel.level_composition(m.table(spark, d, "part").select(F.col("p_brand").alias("theme"), level.alias("level")))


def relevance_state(spark, d):
    return panel.relevance(m.trades(spark, d).select(F.concat_ws("-", "p_brand", F.col("l_suppkey") % 4).alias("theme"), "day"), "2001-09-01")


def _themes(spark, d):
    """Members of twelve themes by quarter."""
    o = m.table(spark, d, "orders")
    idx = (F.year("o_orderdate") - 1992) * 4 + F.quarter("o_orderdate")
    return o.select(idx.cast("int").alias("idx"), F.concat(F.lit("t"), F.col("o_custkey") % 12).alias("theme"), (F.col("o_custkey") % 40 + F.when(F.col("o_totalprice") > 250000, 100).otherwise(0)).alias("member")).distinct()


def jaccard_lineage(spark, d):
    return panel.jaccard_links(_themes(spark, d))


def lifecycle_events(spark, d):
    t = _themes(spark, d)
    return panel.lifecycle(t.select("idx", "theme").distinct(), panel.jaccard_links(t))


def states_by_point(spark, d):
    t = m.table(spark, d, "orders").select(F.col("o_custkey").alias("family"), ((F.year("o_orderdate") - 1992) * 2 + F.when(F.month("o_orderdate") > 6, 1).otherwise(0)).cast("int").alias("idx"))
    return panel.states_by_point(t, t)


def monthly_grid_join(spark, d):
    """Edges known at each month end from 2001-06 to 2001-11-04: counted under the first month that knows them, then added up."""
    grid = spark.sql("SELECT DATE '2001-06-15' AS s, DATE '2001-11-04' AS month_end").select(F.explode(pit.month_ends(F.col("s"), F.col("month_end"))).alias("month_end"))
    e = m.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.min(F.to_date("l_shipdate")).alias("first_seen"))
    points = grid.select(F.col("month_end").alias("as_of"))
    edges = market.sums_at_points(e.withColumn("one", F.lit(1)), points, "first_seen", [], "one", "n_edges")
    nodes = e.groupBy("src").agg(F.min("first_seen").alias("first_seen")).withColumn("one", F.lit(1))
    return edges.join(market.sums_at_points(nodes, points, "first_seen", [], "one", "n_nodes"), "as_of").withColumnRenamed("as_of", "month_end")


def momentum(spark, d):
    t = m.trades(spark, d).groupBy(F.col("p_brand").alias("theme"), F.trunc("day", "month").alias("month")).agg(F.countDistinct("l_suppkey").alias("size"))
    return panel.momentum(t)


def node_profile(spark, d):
    e = m.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("other"), F.col("l_orderkey").alias("chunk"), F.to_date("l_shipdate").alias("day"))
    return e.groupBy("node").agg(F.countDistinct("other").alias("degree"), F.countDistinct("chunk").alias("n_evidence"), F.min("day").alias("first_seen"))


def freeze_digest(spark, d):
    out = None
    for t in ("region", "nation", "supplier", "orders"):
        x = evidence.table_digest(m.table(spark, d, t)).select(F.lit(t).alias("artifact"), "n_rows", "digest", "mix")
        out = x if out is None else out.unionByName(x)
    return out


def sql_views(spark, d):
    from narrascope.sources.catalog import analyst_session

    with analyst_session(spark, {"v_disc_documents": f"{d}/documents.parquet", "v_disc_missing": f"{d}/nowhere*.parquet", "v_val_labels": f"{d}/labels.parquet"}, frozen=True) as session:
        return session.sql("SELECT lang, count(*) AS n, sum(quality) AS good FROM v_disc_documents JOIN v_val_labels USING (doc_id) GROUP BY lang")


_U = f"(SELECT src AS node, dst AS other FROM {m.LINKS_SQL} a UNION SELECT dst, src FROM {m.LINKS_SQL} b)"
_W = f"(SELECT src, dst, ((substr(src, 2)::BIGINT * 31 + substr(dst, 2)::BIGINT * 17) % 101) / 100.0 AS weight FROM {m.LINKS_SQL} w)"
_TH = "(SELECT DISTINCT ((year(o_orderdate) - 1992) * 4 + quarter(o_orderdate))::INT AS idx, 't' || o_custkey % 12 AS theme, o_custkey % 40 + CASE WHEN o_totalprice > 250000 THEN 100 ELSE 0 END AS member FROM orders)"
_J = f"""(SELECT a.idx, a.theme, b.theme AS next_theme, round(count(*) / (any_value(n.n) + any_value(k.n) - count(*)), 6) AS jaccard FROM {_TH} a JOIN {_TH} b ON b.idx = a.idx + 1 AND a.member = b.member
 JOIN (SELECT idx, theme, count(*) AS n FROM {_TH} x GROUP BY ALL) n ON n.idx = a.idx AND n.theme = a.theme JOIN (SELECT idx, theme, count(*) AS n FROM {_TH} x GROUP BY ALL) k ON k.idx = b.idx AND k.theme = b.theme
 GROUP BY a.idx, a.theme, b.theme HAVING count(*) / (any_value(n.n) + any_value(k.n) - count(*)) >= 0.5)"""

SQL = {
    "bipartite_edges": f"""WITH n AS (SELECT * FROM (SELECT 's' || s_suppkey AS id, 'Company' AS t, DATE '1997-06-01' + (s_suppkey % 400)::INT AS f FROM supplier UNION ALL SELECT 'p' || p_partkey, CASE p_size % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Commodity' ELSE 'EconomicConcept' END, DATE '1997-01-01' FROM part) WHERE f <= DATE '{AS_OF}')
SELECT 's' || l_suppkey AS src, a.t AS src_type, b.t AS dst_type, count(*) AS n FROM lineitem JOIN n a ON a.id = 's' || l_suppkey JOIN n b ON b.id = 'p' || l_partkey
WHERE l_shipdate::DATE <= DATE '{AS_OF}' AND l_orderkey % 3 <> 1 AND l_linenumber % 3 <> 1 AND b.t <> 'Person' GROUP BY ALL""",
    "degree_centrality": f"SELECT node, count(*) AS degree, round(least(1.0, count(*) / ((SELECT count(DISTINCT node) FROM {_U} u) - 1)), 6) AS centrality FROM {_U} u GROUP BY node",
    "density_strength": f"""WITH mem AS (SELECT DISTINCT node, substr(node, 2)::BIGINT % 7 AS community FROM {_U} u), s AS (SELECT community, count(*) AS size FROM mem GROUP BY 1),
 e AS (SELECT a.community, count(*) AS m, avg(weight) AS s FROM {_W} w JOIN mem a ON a.node = src JOIN mem b ON b.node = dst WHERE a.community = b.community GROUP BY 1)
SELECT community, size, coalesce(m, 0) AS n_edges, round(CASE WHEN size < 2 THEN 0 ELSE least(1.0, coalesce(m, 0) / (size * (size - 1) / 2.0)) END, 6) AS density, round(coalesce(e.s, 0), 6) AS strength FROM s LEFT JOIN e USING (community)""",
    "multi_source_bfs": f"""WITH RECURSIVE u AS (SELECT * FROM {_U} x), b AS (SELECT s_nationkey::VARCHAR AS seed, 's' || s_suppkey AS node, 0 AS dist FROM supplier
 UNION SELECT seed, other, dist + 1 FROM b JOIN u USING (node) WHERE dist < 4)
SELECT seed, dist, count(*) AS n FROM (SELECT seed, node, min(dist)::INT AS dist FROM b GROUP BY ALL) GROUP BY ALL""",
    "bounded_slice": f"""WITH u AS (SELECT src AS node, dst AS other, weight FROM {_W} w WHERE weight >= 0.1 UNION ALL SELECT dst, src, weight FROM {_W} w WHERE weight >= 0.1),
 h1 AS (SELECT * FROM (SELECT other AS node, max(weight) AS via FROM u WHERE node = 's1' GROUP BY 1) ORDER BY via DESC, node LIMIT 39),
 h2 AS (SELECT * FROM (SELECT other AS node, max(weight) AS via FROM u JOIN h1 USING (node) WHERE other <> 's1' AND other NOT IN (SELECT node FROM h1) GROUP BY 1) ORDER BY via DESC, node LIMIT (SELECT 39 - count(*) FROM h1))
SELECT 's1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
    "signed_propagation": """WITH RECURSIVE e AS (SELECT src, dst, ((n % 3) - 1)::INT AS polarity, greatest(0.01, (n % 10) / 10.0) AS weight FROM (SELECT *, substr(src, 2)::BIGINT + substr(dst, 2)::BIGINT AS n FROM (
  SELECT DISTINCT 'c' || c_custkey AS src, 'c' || ((c_custkey * k + k) % (SELECT count(*) FROM customer)) AS dst FROM customer, (VALUES (2), (3), (5)) v(k))) WHERE src <> dst),
 p AS (SELECT 'c' || c_custkey AS trigger, 'c' || c_custkey AS tip, ['c' || c_custkey] AS path, 1.0::DOUBLE AS force, 0 AS hop FROM customer
  UNION ALL SELECT trigger, dst, list_append(path, dst), force * polarity * weight * 0.8, hop + 1 FROM p JOIN e ON tip = src WHERE polarity <> 0 AND hop < 3 AND NOT list_contains(path, dst))
SELECT trigger, tip AS company, round(sum(force), 6) AS impact, sign(round(sum(force), 6))::INT AS direction, count(*) AS n_paths FROM p WHERE hop > 0 AND tip IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') GROUP BY ALL HAVING round(sum(force), 6) <> 0""",
    "connected_components": "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1",
    "exposure_score": f"""WITH s AS (SELECT p_brand AS theme, l_suppkey AS company_id, round(sum(l_discount), 4) AS c, count(*) AS e, round(avg(1 - least(DATE '{AS_OF}' - day, 365) / 365.0), 9) AS r FROM {m.TRADES_SQL} t WHERE day <= DATE '{AS_OF}' GROUP BY ALL)
SELECT theme, company_id, round(0.30 / (1 + company_id % 3) + 0.25 * c / max(c) OVER () + 0.20 * ln(1 + e) / ln(1 + max(e) OVER ()) + 0.15 * r + 0.10 * (company_id % 10) / 10.0, 6) AS exposure FROM s""",
    "level_composition": "SELECT theme, macro, industry, company, idiosyncratic, CASE greatest(macro, industry, company, idiosyncratic) WHEN macro THEN 'macro' WHEN industry THEN 'industry' WHEN company THEN 'company' ELSE 'idiosyncratic' END AS dominant FROM (SELECT p_brand AS theme, count(*) FILTER (p_size % 4 = 0) AS macro, count(*) FILTER (p_size % 4 = 1) AS industry, count(*) FILTER (p_size % 4 = 2) AS company, count(*) FILTER (p_size % 4 = 3) AS idiosyncratic FROM part GROUP BY 1)",
    "relevance_state": f"SELECT theme, n, latest, round(rs, 6) AS recent_share, round(rel, 6) AS relevance, CASE WHEN rs >= 0.5 THEN 'active' WHEN rs >= 0.2 THEN 'cooling' WHEN rs > 0 THEN 'fading' ELSE 'dormant' END AS state FROM (SELECT p_brand || '-' || l_suppkey % 4 AS theme, count(*) AS n, max(day) AS latest, avg((DATE '2001-09-01' - day <= 90)::INT) AS rs, avg(greatest(0, 1 - (DATE '2001-09-01' - day) / 365.0)) AS rel FROM {m.TRADES_SQL} t WHERE day <= DATE '2001-09-01' GROUP BY 1)",
    "jaccard_lineage": f"SELECT idx, theme, next_theme, jaccard FROM {_J} j",
    "lifecycle_events": f"""WITH j AS (SELECT * FROM {_J} j), c AS (SELECT idx, theme, count(*) AS n FROM j GROUP BY ALL), p AS (SELECT idx + 1 AS idx, next_theme AS theme, count(*) AS n_parents, max(c.n) AS sib FROM j JOIN c USING (idx, theme) GROUP BY ALL)
SELECT idx, theme, coalesce(n_parents, 0) AS n_parents, CASE WHEN n_parents IS NULL THEN 'emerged' WHEN n_parents > 1 THEN 'merged' WHEN sib > 1 THEN 'split' ELSE 'persisted' END AS event FROM (SELECT DISTINCT idx, theme FROM {_TH} t) LEFT JOIN p USING (idx, theme)""",
    "states_by_point": "WITH t AS (SELECT DISTINCT o_custkey AS family, ((year(o_orderdate) - 1992) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::INT AS idx FROM orders), f AS (SELECT family, min(idx) AS a, max(idx) AS b FROM t GROUP BY 1) SELECT family, g.idx, CASE WHEN t.idx IS NOT NULL THEN 'present' WHEN g.idx > a AND g.idx < b THEN 'dormant' ELSE 'absent' END AS state FROM f CROSS JOIN (SELECT DISTINCT idx FROM t) g LEFT JOIN t USING (family, idx)",
    "monthly_grid_join": "WITH g AS (SELECT unnest([DATE '2001-06-30', DATE '2001-07-31', DATE '2001-08-31', DATE '2001-09-30', DATE '2001-10-31', DATE '2001-11-04']) AS month_end), e AS (SELECT l_suppkey, l_partkey, min(l_shipdate::DATE) AS f FROM lineitem GROUP BY ALL) SELECT month_end, count(*) AS n_edges, count(DISTINCT l_suppkey) AS n_nodes FROM e JOIN g ON f <= month_end GROUP BY 1",
    "momentum": f"WITH s AS (SELECT p_brand AS theme, date_trunc('month', day)::DATE AS month, count(DISTINCT l_suppkey) AS size FROM {m.TRADES_SQL} t GROUP BY ALL), w AS (SELECT *, lag(size) OVER (PARTITION BY theme ORDER BY month) AS b FROM s) SELECT theme, count(*) AS n_months, max_by(size, month) AS last_size, max_by(size, month) - coalesce(arg_max_null(b, month), 0) AS momentum, min(month) FILTER (size >= 3) AS emerged FROM w GROUP BY theme",
    "node_profile": "SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS degree, count(DISTINCT l_orderkey) AS n_evidence, min(l_shipdate::DATE) AS first_seen FROM lineitem GROUP BY 1",
    "sql_views": "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang",
}


def _digest(table, columns):
    row = ", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in sorted(columns.split()))
    lane = lambda a: f"coalesce(sum(('0x' || substr(h, {a}, 15))::BIGINT), 0)::VARCHAR"
    return f"SELECT '{table}' AS artifact, count(*) AS n_rows, {lane(1)} AS digest, {lane(16)} AS mix FROM (SELECT sha256(concat_ws(chr(31), {row})) AS h FROM {table})"


SQL["freeze_digest"] = " UNION ALL ".join([_digest("region", "r_regionkey r_name"), _digest("nation", "n_nationkey n_name n_regionkey"), _digest("supplier", "s_suppkey s_name s_nationkey s_acctbal"), _digest("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority")])
QUERIES = {name: globals()[name] for name in [*SQL, "louvain_communities"]}
