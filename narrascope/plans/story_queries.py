"""Queries from text to exposure, impacts and validation: extraction, claims, sentiment, graph, panel, reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.operators import claims, cleaning, exposure, extraction, governance, graph, impacts, lineage, narration, panel, panel_run, pit, reads, sentiment, validation
from narrascope.operators.communities import modularity
from narrascope.plans import mapping as m
from narrascope.sources import readers

AS_OF = "1998-01-01"

# News: one sentence of a few parts, then figures, for each order.
SUBJECTS = ("Acme Corp", "Beta Industries", "Hydro One", "Cameco", "RBC", "The board")
VERBS = ("is exposed to", "shows sensitivity to", "benefits from", "was hurt by", "met in", "says the cause is")
OBJECTS = ("uranium", "copper", "oil prices", "electricity demand", "the data center", "inflation", "the interest rate", "a rate cut", "Ontario", "grid infrastructure and a capex increase")
TAILS = ("with strong tailwinds", "despite headwinds", "as costs fall", "with headwinds and support", "and capex is not growing", "we expect a strong outlook")
UNIVERSE = ("Acme Corp", "Beta Industries", "Hydro One")


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def news(spark, d):
    """chunk_id, company, available_at, text, speaker_role of every order."""
    o, k, c = m.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    o = o.repartition(k)  # rows of some 30 bytes become texts that take long to search
    text = F.concat(
        _pick(SUBJECTS, c % 6), F.lit(" "), _pick(VERBS, k % 6), F.lit(" "), _pick(OBJECTS, F.floor(k / 6) % 10), F.lit(" "), _pick(TAILS, F.floor(c / 6) % 6), F.lit(". Revenue "),
        _pick(("rose to $", "fell to $", "was $"), k % 3), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(" million in Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit("."),
        F.when(k % 4 == 0, F.concat(F.lit(" We expect gross margin of "), (c % 60).cast("string"), F.lit(".5% for FY 1999."))).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit(" EPS came in at $"), (c % 9).cast("string"), F.lit(".25 for Q3 1997."))).otherwise(""),
    )
    return o.select(k.alias("chunk_id"), (c % 50).alias("company"), F.to_date("o_orderdate").alias("available_at"), text.alias("text"), F.when(k % 7 == 0, "analyst").when(k % 7 == 1, "management").alias("speaker_role"))


_L = lambda values: "[" + ", ".join("'" + v + "'" for v in values) + "]"
NEWS_SQL = f"""(SELECT o_orderkey AS chunk_id, o_custkey % 50 AS company, o_orderdate::DATE AS available_at, {_L(SUBJECTS)}[o_custkey % 6 + 1] || ' ' || {_L(VERBS)}[o_orderkey % 6 + 1] || ' ' || {_L(OBJECTS)}[(o_orderkey // 6) % 10 + 1] || ' ' || {_L(TAILS)}[(o_custkey // 6) % 6 + 1] || '. Revenue '
 || ['rose to $', 'fell to $', 'was $'][o_orderkey % 3 + 1] || floor(o_totalprice / 1000)::BIGINT || '.' || o_orderkey % 10 || ' million in Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) || '.'
 || CASE WHEN o_orderkey % 4 = 0 THEN ' We expect gross margin of ' || o_custkey % 60 || '.5% for FY 1999.' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' EPS came in at $' || o_custkey % 9 || '.25 for Q3 1997.' ELSE '' END AS text FROM orders)"""


def _extracted(spark, d):
    universe = spark.createDataFrame([(x,) for x in UNIVERSE], "name string")
    return extraction.run_extraction(news(spark, d).select("chunk_id", "available_at", "text"), extraction.RuleExtractor(universe=universe))


def _ids(c):
    return F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256)


def extracted_entities(spark, d):
    e = _extracted(spark, d)["entities"]
    return e.select("entity_id", "entity_type", "name", "first_seen", F.size("source_chunk_ids").alias("n_chunks"), _ids(F.col("source_chunk_ids")).alias("chunks_sha256"))


PANEL = ("1995-06-30", "1996-06-30", "1998-01-01", "1999-12-31", "2002-01-01")


def panel_entities(spark, d):
    """Entities of the news known at five points, in one plan: each text is cleaned and searched once."""
    n, key = news(spark, d), F.col("chunk_id").cast("string")
    raw = n.select(key.alias("document_id"), F.col("chunk_id").alias("row_number"), F.lit("news").alias("source"), key.alias("source_id"), "available_at", F.concat(key, F.lit(".txt")).alias("raw_path"), F.col("text").alias("raw_text"))
    universe = spark.createDataFrame([(x,) for x in UNIVERSE], "name string")
    made = panel_run.extract_panel(raw, list(PANEL), extraction.RuleExtractor(universe=universe))
    return made["entities"].select("as_of", "entity_id", "entity_type", F.size("source_chunk_ids").alias("n_chunks"))


def extracted_edges(spark, d):
    e = _extracted(spark, d)["edges"]
    return e.select("edge_id", "src", "dst", "edge_type", "confidence", "direction", "first_seen", F.size("evidence").alias("n_chunks"), _ids(F.col("evidence")).alias("chunks_sha256"))


def extraction_provenance(spark, d):
    e = _extracted(spark, d)
    n = e["entity_chunk_provenance"].groupBy("entity_id").agg(F.count("*").alias("n"), F.max("available_at").alias("latest")).select(F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("explanation"), "n", "latest")
    said = e["edge_explanations"].select(F.col("edge_id").alias("id"), "explanation", F.col("chunk_id").alias("n"), F.lit(None).cast("date").alias("latest"))
    return n.unionByName(said)


def reported_claims(spark, d):
    c = claims.roll_up(claims.find_claims(news(spark, d)))
    return c.select("company", "metric", "period", "is_guidance", "value", "unit", "direction", "confidence", F.size("chunks").alias("n_chunks"))


def reconciled_claims(spark, d):
    """Claims known at a day; revenue that companies of every third number have reported by quarter answers theirs."""
    o = m.table(spark, d, "orders")
    facts = o.where("o_custkey % 3 = 0").select((F.col("o_custkey") % 50).alias("company"), F.last_day(F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3, F.lit(1))).alias("period_end"), F.lit("revenue").alias("metric"))
    c = claims.run_facts(news(spark, d), facts, AS_OF)
    return c.groupBy("company", "metric", "is_guidance").agg(F.count("*").alias("n"), F.max("period_end").alias("last_period"))


def management_sentiment(spark, d):
    """Readings of management beside the tone of the same chunk, as a panel of what is dated."""
    n = news(spark, d)
    read = sentiment.run_sentiment(n, AS_OF)
    short = F.length("text") % 3
    tone = n.where("chunk_id % 2 = 0").select("chunk_id", "available_at", (short / 100.0).alias("positive"), (F.col("chunk_id") % 4 / 100.0).alias("negative"), F.lit(0.0).alias("uncertainty"))
    return sentiment.sentiment_panel(sentiment.fuse_with_tone(read, tone, AS_OF), AS_OF).drop("positive", "negative", "uncertainty")


def _graph(spark, d):
    """Suppliers are companies, brand and type of parts concepts; an edge for each pair, kind and method."""
    p = m.table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("concept"))
    t = m.table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    kind, method = _pick(("exposed_to", "benefits", "co_occurs_with"), F.col("l_orderkey") % 3), _pick(("document_stated", "llm_inferred"), F.col("l_linenumber") % 2)
    rows = t.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("concept").alias("dst"), kind.alias("edge_type"), method.alias("method"), F.to_date("l_shipdate").alias("day"), "l_discount", F.col("l_orderkey").cast("string").alias("chunk"))
    edges = rows.groupBy("src", "dst", "edge_type", "method").agg(F.round(F.max("l_discount"), 4).alias("confidence"), F.min("day").alias("first_seen"), F.collect_set("chunk").alias("evidence"))
    edges = runtime.staged(edges.withColumn("edge_id", F.concat_ws(">", "src", "dst", "edge_type", "method")), "story-edges")
    s = m.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lit("Company").alias("entity_type"), F.col("s_name").alias("name"), F.expr("date_add(DATE '1997-06-01', CAST(s_suppkey % 400 AS INT))").alias("first_seen"), F.concat(F.lit("c"), F.col("s_nationkey") % 5).alias("community"))
    c = p.select(F.col("concept").alias("entity_id"), F.lit("EconomicConcept").alias("entity_type"), F.col("concept").alias("name"), F.lit("1997-01-01").cast("date").alias("first_seen"), F.concat(F.lit("c"), F.length("concept") % 5).alias("community")).distinct()
    return s.unionByName(c), edges


def _exposed(spark, d):
    entities, edges = _graph(spark, d)
    nodes, _ = exposure.build_graph(entities.drop("community"), edges.withColumn("direction", F.lit(1)), AS_OF)
    members = entities.select("community", "entity_id")
    snapshots = spark.createDataFrame([(f"c{k}", f"theme_{k}") for k in range(4)], "community string, theme_snapshot_id string")  # the fifth has none
    return exposure.compute_exposure(entities.drop("community"), edges, nodes, members, snapshots, AS_OF)


def exposure_from_graph(spark, d):
    return _exposed(spark, d).select("company_id", "theme_snapshot_id", F.round("exposure_score", 6).alias("exposure_score"), "graph_distance", F.round("edge_confidence_sum", 4).alias("edge_confidence_sum"), "evidence_count", F.array_join("top_evidence_chunk_ids", ",").alias("top_evidence"))


def graph_projection(spark, d):
    """Polarity, weight and nodes of the graph of a point."""
    entities, edges = _graph(spark, d)
    said = F.when(F.length("dst") % 4 == 0, "1").when(F.length("dst") % 4 == 1, "-1").when(F.length("dst") % 4 == 2, "7")
    nodes, signed = exposure.build_graph(entities.drop("community"), edges.withColumn("direction", said), AS_OF)
    known = signed.join(nodes.select(F.col("entity_id").alias("src")), "src", "left_semi")
    return known.groupBy("edge_type", "polarity").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def _impacts(spark, d):
    """Events (nations) cause concepts (brands), which benefit or hurt companies (suppliers), which are exposed to one another."""
    n = m.table(spark, d, "nation").select(F.col("n_nationkey").alias("a"))
    s = m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("nation"))
    many = s.count()
    events = n.select("a", F.explode(F.array((F.col("a") * 3 + 1) % 25, (F.col("a") * 7 + 2) % 25)).alias("b")).select(F.concat(F.lit("e"), "a").alias("src"), F.concat(F.lit("k"), "b").alias("dst"), F.lit("causes").alias("edge_type"), (F.col("a") % 3 - 1).alias("direction"), (F.col("a") * 31 + F.col("b") * 17).alias("w"))
    works = s.select(F.concat(F.lit("k"), F.col("a") % 25).alias("src"), F.concat(F.lit("s"), "a").alias("dst"), F.when(F.col("nation") % 2 == 0, "benefits").otherwise("hurts").alias("edge_type"), F.lit(0).alias("direction"), (F.col("a") * 13 + F.col("nation")).alias("w"))
    deals = s.select(F.concat(F.lit("s"), "a").alias("src"), F.concat(F.lit("s"), (F.col("a") * 3) % many + 1).alias("dst"), F.lit("exposed_to").alias("edge_type"), (F.col("a") % 3 - 1).alias("direction"), (F.col("a") * 7).alias("w"))
    e = events.unionByName(works, allowMissingColumns=True).unionByName(deals).distinct()
    e = e.withColumn("confidence", (F.col("w") % 100) / 100.0).withColumn("first_seen", F.lit("1997-01-01").cast("date")).withColumn("edge_id", F.concat_ws(">", "src", "dst")).withColumn("evidence", F.array(F.concat(F.lit("x"), F.col("w") % 40)))
    entities = n.select(F.concat(F.lit("e"), "a").alias("entity_id"), F.lit("Event").alias("entity_type")).unionByName(s.select(F.concat(F.lit("s"), "a"), F.lit("Company")).toDF("entity_id", "entity_type")).unionByName(n.select(F.concat(F.lit("k"), "a"), F.lit("EconomicConcept")).toDF("entity_id", "entity_type")).withColumn("first_seen", F.lit("1997-01-01").cast("date")).withColumn("name", F.upper("entity_id"))
    nodes, edges = exposure.build_graph(entities, e.drop("w"), AS_OF)
    return nodes, edges, impacts.projected_impacts(nodes, edges, AS_OF)


def projected_impacts(spark, d):
    _, _, rows = _impacts(spark, d)
    return rows.select("trigger_id", "company_id", "direction", F.round("strength", 6).alias("strength"), F.array_join("path", " ").alias("path"), "n_paths", F.size("contributing_edge_ids").alias("n_edges"), F.array_join("evidence_chunk_ids", ",").alias("evidence"), F.round("confidence", 6).alias("confidence"))


def impact_ranking(spark, d):
    """Place of each company under its event, the number of companies of the event, whether its first path is sign-blind."""
    nodes, edges, rows = _impacts(spark, d)
    rows = runtime.staged(rows.withColumn("strength", F.round("strength", 9)), "impacts")
    paths = impacts.path_graph(rows, edges).groupBy("trigger_id", "company_id").agg(F.max("step").alias("last_step"), F.bool_and("sign_blind").alias("sign_blind"))
    top = impacts.ranked(rows).select("trigger_id", "company_id", "position").where("position <= 5")
    return top.join(impacts.trigger_list(rows, nodes).select("trigger_id", "label", "n_companies"), "trigger_id").join(paths, ["trigger_id", "company_id"])


def cleaned_documents(spark, d):
    docs = m.documents(spark, d)
    n = F.col("doc_id")
    noise = F.concat(F.lit("\r\nPage 3\n- 12 -\nACME   Report\n"), F.lit("4 / 9\nACME Report\n\n\n\nACME Report\n"))
    text = F.when(n % 29 != 0, F.concat(F.translate("text", "|<[", "///"), F.when(n % 3 == 0, noise).otherwise("")))
    rows = docs.select(n.alias("document_id"), n.alias("row_number"), F.when(n % 31 != 0, F.col("source")).alias("source"), n.cast("string").alias("source_id"), "available_at", F.concat(F.lit("d/"), n, F.lit(".txt")).alias("raw_path"), text.alias("raw_text"))
    return cleaning.clean_documents(rows, "2024-10-31").select("document_id", "outcome", "content_hash", F.size("steps").alias("n_steps"))


def pages_to_chunks(spark, d):
    """Pages through the whole chain: markup, tables, headings, chunks."""
    pages = m.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.col("html").alias("raw_text"), F.lit("p.html").alias("raw_path"))
    rows = cleaning.clean_chain(pages).withColumn("content_hash", F.sha2("clean_text", 256)).withColumn("available_at", F.lit("2024-01-01").cast("date")).withColumn("included_in_discovery", F.lit(True))
    return cleaning.chunk_rows(rows).select("chunk_id", "document_id", "chunk_index", "block_type", "section_title", "token_count", "start_char", "end_char")


def integrity_suite(spark, d):
    """Violations planted by id in tables of documents, chunks, entities and edges."""
    n = F.col("doc_id")
    docs = m.documents(spark, d).select(n.cast("string").alias("document_id"), F.when(n % 41 != 0, n.cast("string")).otherwise("gone").alias("raw_document_id"), F.when(n % 43 != 0, F.col("available_at")).alias("available_at"))
    raw = m.documents(spark, d).select(n.cast("string").alias("document_id"))
    chunks = m.documents(spark, d).select(F.when(n % 37 != 0, F.concat(F.lit("k"), n)).otherwise("").alias("chunk_id"), F.when(n % 47 != 0, n.cast("string")).otherwise("none").alias("document_id"), F.when(n % 53 == 0, F.date_add("available_at", 1)).otherwise(F.when(n % 43 != 0, F.col("available_at"))).alias("available_at"))
    edges = m.documents(spark, d).select(F.concat(F.lit("g"), n).alias("edge_id"), F.lit("document_stated").alias("method"), F.array(F.concat(F.lit("k"), n)).alias("evidence"))
    tables = {"documents": docs, "chunks": chunks}
    return governance.integrity_report([
        governance.check_dates(tables, {"documents": ("document_id", "available_at"), "chunks": ("chunk_id", "available_at")}, "2024-12-01"),
        governance.check_inheritance(chunks, docs, "document_id", "chunk_id"),
        governance.check_references([("documents", docs, "document_id", "raw_document_id", raw, "document_id"), ("chunks", chunks, "chunk_id", "document_id", docs, "document_id")]),
        governance.check_evidence(edges, chunks),
        governance.check_schemas(spark, tables, {"documents": ["document_id", "available_at", "title"], "chunks": ["chunk_id", "document_id", "available_at"]}),
        governance.check_filled(tables, {"documents": ["document_id", "available_at"], "chunks": ["chunk_id", "available_at"]}),
        governance.check_reconciliation(raw, docs.where("raw_document_id != 'gone'"), docs.where("raw_document_id = 'gone' AND length(document_id) > 2"), "document_id"),
    ]).groupBy("check_name", "table_name", F.regexp_replace("detail", r" \S*$", "").alias("what")).agg(F.count("*").alias("n"))


def _universe(spark, d):
    return m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey").cast("string")).alias("sector"))


def _theme_exposure(spark, d):
    t = m.trades(spark, d).where(pit.known_at(F.col("day"), AS_OF))
    return t.groupBy(F.col("p_brand").alias("theme"), F.col("l_suppkey").alias("company_id")).agg(F.round(F.sum("l_discount"), 4).alias("exposure"))


WINDOWS = [(AS_OF, 3), (AS_OF, 6), (AS_OF, 240)]


def snapshot_validation(spark, d):
    """Baskets of one snapshot beside benchmarks, one of them unknown; the third window is out of reach."""
    rows = validation.validate_snapshot(_theme_exposure(spark, d), m.prices(spark, d), m.points(spark, WINDOWS), _universe(spark, d), m.PRICE_TIE, 5, (validation.UNIVERSE, validation.SECTOR, "hedged_index"))
    return rows.select("theme", "forward_window", "company_count", "sample_size", "start_date", "end_date", "benchmark", *[F.round(c, 6).alias(c) for c in ("basket_ret", "benchmark_ret", "excess")], "illustrative", "claim_supported", "caveats")


def sector_fallback(spark, d):
    """Without any sector the benchmark is that of the universe, and says so."""
    points = m.points(spark, [(AS_OF, 3)])
    from narrascope.operators import market

    r = market.forward_returns(m.prices(spark, d), points, m.PRICE_TIE)
    b = validation.benchmark_returns(r, _universe(spark, d).withColumn("sector", F.lit("")), (validation.SECTOR,))
    return b.select("as_of", "benchmark", F.round("benchmark_ret", 6).alias("benchmark_ret"), "benchmark_n", "benchmark_caveat")


def fixed_basket_walk(spark, d):
    points = m.points(spark, [("1998-01-01", 3), ("1998-07-01", 3), ("1999-01-01", 3), ("2001-10-01", 3)])
    rows = validation.fixed_basket_walk(_theme_exposure(spark, d), m.prices(spark, d), points, _universe(spark, d), m.PRICE_TIE)
    return rows.select("as_of", *[F.round(c, 6).alias(c) for c in ("basket_ret", "baseline_ret", "excess")], "skipped_reason", "n_points", F.round("mean_excess", 6).alias("mean_excess"), F.round("hit_rate", 6).alias("hit_rate"), "claim_supported")


def _panel(spark, d):
    """Quarters are points, twelve themes a quarter of which every fifth is missing, companies are customers' groups."""
    o = m.table(spark, d, "orders")
    idx = ((F.year("o_orderdate") - 1992) * 4 + F.quarter("o_orderdate") - 1).cast("int")
    rows = o.select(idx.alias("idx"), F.concat(F.lit("t"), F.lpad((F.col("o_custkey") % 12).cast("string"), 2, "0")).alias("theme"), (F.col("o_custkey") % 12 * 10 + F.floor(F.col("o_totalprice") / 60000)).cast("long").alias("company")).where("(idx + CAST(substring(theme, 2, 2) AS INT)) % 5 != 0").distinct()
    nodes = rows.select("idx", F.concat(F.lit("q"), "idx").alias("as_of"), "theme", F.concat_ws("-", "theme", F.lpad("idx", 3, "0")).alias("snapshot_id")).distinct()
    return nodes, rows


def theme_lineage(spark, d):
    nodes, rows = _panel(spark, d)
    found, _ = lineage.family_lineage(nodes, rows, "run")
    return found.select("idx", "theme", "lifecycle_event", "confidence", F.col("n_parents").cast("long").alias("n_parents"))


def theme_families(spark, d):
    nodes, rows = _panel(spark, d)
    _, families = lineage.family_lineage(nodes, rows, "run")
    return families


def panel_report(spark, d):
    nodes, rows = _panel(spark, d)
    found, families = lineage.family_lineage(nodes, rows, "run")
    paths = runtime.staged(lineage.trajectories(rows, found), "trajectories")
    states = lineage.family_states(found, families, nodes.select("idx").distinct())
    return lineage.panel_summary(found, families, states, paths).withColumn("n_rows", F.lit(paths.count()))


def panel_points(spark, d):
    nodes, rows = _panel(spark, d)
    found, _ = lineage.family_lineage(nodes, rows, "run")
    points = spark.range(0, 44).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("q"), "id").alias("as_of"))
    return lineage.points_summary(found, rows, points)


def _monthly_links(spark, d):
    """Suppliers and the concepts they ship, cumulated at each month end of the table; links as of their first day."""
    p = m.table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("concept"))
    t = m.table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    e = t.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("concept").alias("dst")).agg(F.min(F.to_date("l_shipdate")).alias("first_seen"))
    e = runtime.staged(e.where("first_seen IS NOT NULL"), "timed-links")
    first, last = e.agg(F.min("first_seen"), F.max("first_seen")).first()
    months = [] if first is None else lineage.month_ends(first, last)
    return lineage.months_of_themes(e, months).withColumn("weight", F.lit(1.0))


def monthly_communities(spark, d):
    """Communities of the cumulated links at every month end, and how the last month's have grown."""
    found = graph.communities(_monthly_links(spark, d), ["month_end"], passes=1, rounds=8)
    return lineage.theme_trajectories(found)


def monthly_partitions(spark, d):
    """Of each month's communities: nodes, links, whether every node is in one of them, and whether their modularity is above that of none."""
    links = runtime.staged(_monthly_links(spark, d), "monthly-links")
    found = graph.communities(links, ["month_end"], passes=1, rounds=8)
    once = found.groupBy("month_end", "node").agg(F.count("*").alias("times")).groupBy("month_end").agg(F.sum((F.col("times") == 1).cast("long")).alias("placed_once"))
    sizes = found.groupBy("month_end", "community").agg(F.count("*").alias("size")).groupBy("month_end").agg(F.sum("size").alias("sum_of_sizes"), F.min("community").alias("first_community"))
    return modularity(found, links, ["month_end"]).join(once, "month_end").join(sizes, "month_end").select("month_end", "n_nodes", F.col("weight").cast("long").alias("n_links"), "placed_once", "sum_of_sizes", "first_community", (F.col("modularity") >= 0).alias("no_worse_than_one"), (F.col("inside") <= F.col("weight")).alias("inside_is_part"))


def trajectories_by_month(spark, d):
    """Groups of suppliers by the least part group that they ship in a month, followed from the last month backwards."""
    t = m.table(spark, d, "lineitem").groupBy(F.last_day(F.to_date("l_shipdate")).alias("month_end"), F.col("l_suppkey").alias("node")).agg(F.min(F.col("l_partkey") % 40).alias("community"))
    return lineage.theme_trajectories(t)


def theme_levels(spark, d):
    entities, edges = _graph(spark, d)
    nodes = entities.withColumn("entity_type", F.when(F.col("entity_type") == "Company", F.when(F.length("entity_id") % 2 == 0, "Company").otherwise("Sector")).otherwise(_pick(("MacroIndicator", "EconomicConcept", "Event"), F.length("entity_id") % 3)))
    inside = edges.join(entities.select(F.col("entity_id").alias("src"), "community"), "src").join(entities.select(F.col("entity_id").alias("dst"), F.col("community").alias("c")), "dst").where("community = c").groupBy("community").agg(F.round(F.avg("confidence"), 4).alias("strength"))
    levels = reads.theme_levels(entities.select("community", "entity_id"), nodes, inside)
    main = spark.createDataFrame([("odd", "c1"), ("odd", "c3"), ("even", "c0"), ("even", "c2"), ("even", "c4"), ("even", "nothing")], "main_theme string, community string")
    top = reads.main_theme_levels(levels, main).select(F.col("main_theme").alias("theme"), *reads.LEVELS, "dominant", F.lit(None).cast("double").alias("strength"), F.col("substantive_sub_count").alias("size"))
    return levels.select(F.col("community").alias("theme"), *reads.LEVELS, "dominant", "strength", "size").unionByName(top)


def main_theme_relevance(spark, d):
    r = panel.relevance(m.trades(spark, d).select(F.col("p_brand").alias("theme"), "day"), "2001-09-01")
    h = m.table(spark, d, "part").select(F.substring("p_brand", 1, 7).alias("main_theme"), F.col("p_brand").alias("community")).distinct()
    return reads.main_theme_relevance(r, h).withColumn("last_evidence_at", F.col("last_evidence_at").cast("date"))


def subgraph_of_communities(spark, d):
    entities, edges = _graph(spark, d)
    wanted = spark.createDataFrame([("c1",), ("c3",)], "community string")
    nodes, inside = reads.community_subgraph(entities.select("community", "entity_id"), wanted, entities.withColumn("label", F.col("name")), edges)
    return nodes.groupBy("level").agg(F.count("*").alias("n")).select(F.coalesce("level", F.lit("-")).alias("kind"), "n").unionByName(inside.groupBy("edge_type").agg(F.count("*").alias("n")).select(F.col("edge_type").alias("kind"), "n"))


def theme_names(spark, d):
    entities, _ = _graph(spark, d)
    s = reads.theme_names(entities.select("community", "entity_id"), entities.withColumn("label", F.col("name")))
    return s.select("community", "theme_name", F.array_join("top_entities", ";").alias("top_entities"), F.array_join("top_companies", ";").alias("top_companies"))


def evidence_snippets(spark, d):
    n = news(spark, d).withColumn("s", _pick(SUBJECTS, F.col("chunk_id") % 6))
    return n.select("chunk_id", reads.evidence_snippet(F.col("text"), F.col("s"), F.lit("revenue")).alias("snippet"))


def chunk_sources(spark, d):
    """Orders are documents, their lines chunks; every chunk is asked for."""
    lines = m.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = F.row_number().over(order)
    chunks = lines.select(F.concat(F.lit("d"), "l_orderkey").alias("document_id"), k.alias("chunk_index"), F.concat_ws("-", "l_orderkey", k).alias("chunk_id"), F.concat(F.lit("part "), "l_partkey").alias("text"), F.lit("1998-01-01").cast("date").alias("available_at"), F.lit(None).cast("string").alias("section_title"))
    o = m.table(spark, d, "orders")
    documents = o.select(F.concat(F.lit("d"), "o_orderkey").alias("document_id"), F.concat(F.lit("r"), "o_orderkey").alias("raw_document_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("title"), F.lit(None).cast("string").alias("source"), F.lit("10-k").alias("document_type"), F.to_date("o_orderdate").alias("published_at"))
    raw = o.select(F.concat(F.lit("r"), "o_orderkey").alias("document_id"), F.concat(F.lit("u/"), "o_orderkey").alias("source_url"), F.col("o_orderstatus").alias("title"), F.lit("edgar").alias("source"), F.lit("?").alias("document_type"), F.to_date("o_orderdate").alias("published_at"))
    s = reads.chunk_source(chunks.select("chunk_id"), chunks, documents, raw)
    return s.select("chunk_id", "chunk_text", "document_id", "title", "source", "document_type", "published_at", "source_url", F.sha2("document_text", 256).alias("document_sha256"))


def theme_dossier(spark, d):
    entities, edges = _graph(spark, d)
    x = narration.dossier(entities.select("community", "entity_id"), edges.where("edge_type != 'co_occurs_with'"), entities.withColumn("label", F.col("name")), 12)
    return x.select("community", "place", "source", "target", "edge_type")


def news_selection(spark, d):
    p = m.table(spark, d, "pages")
    n = F.col("page_id")
    title = F.when(n % 6 == 0, F.concat(F.lit("Stock rises "), n, F.lit("% on Monday"))).when(n % 6 == 1, "X outperforms market").otherwise(F.concat(F.lit("Story "), n))
    a = p.select((n % 9).alias("company_id"), F.col("url"), title.alias("title"), F.expr("date_add(DATE '2024-01-01', CAST(page_id % 300 AS INT))").alias("published_at"), ((n % 10) / 10.0).alias("relevance"))
    return readers.select_news(a, "2024-06-30", 0.3, spark.createDataFrame([(4,)], "company_id long")).select("company_id", "url", "title", "published_at", "source_id")


def filing_paths(spark, d):
    o, k = m.table(spark, d, "orders"), F.col("o_orderkey")
    accession = F.concat_ws("-", F.lit("0001"), F.lit("98"), F.lpad(k.cast("string"), 9, "0"))
    filings = o.select(accession.alias("source_id"), F.when(k % 5 != 0, F.concat(F.lit("f"), k, F.lit(".htm"))).otherwise("").alias("raw_path"))
    name = F.when(k % 4 == 0, F.concat(F.lit("f"), k, F.lit(".htm"))).when(k % 4 == 1, F.concat(F.lit("f"), k, F.lit(".txt"))).when(k % 4 == 2, F.concat(F.replace(accession, F.lit("-"), F.lit("")), F.lit(".txt"))).otherwise("other.txt")
    return readers.resolve_raw_path(filings, o.select(name.alias("raw_path")))


def linked_steps(spark, d):
    nation = m.table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("target"))
    steps = nation.select(F.col("n_name").alias("source"), "target", F.lit("causes").alias("edge_type"))
    r = m.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("source"), "target", F.when(F.col("n_nationkey") % 3 != 0, "causes").otherwise("hurts").alias("edge_type"), F.concat(F.lit("k"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("evidence_chunk_id"), F.lit("document_stated").alias("method"))
    return reads.link_steps(steps, r)


def model_calls(spark, d):
    e = m.table(spark, d, "events").select(F.col("event_type").alias("task"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), (F.col("event_id") % 11 != 0).alias("success"), (F.col("event_id") % 4 == 0).alias("cache_hit"), (F.col("event_id") % 100).cast("double").alias("latency_ms"))
    return governance.call_log(e)


NO_SQL = ("management_sentiment", "monthly_communities", "pages_to_chunks")
NAMES = (
    "extracted_entities extracted_edges extraction_provenance reported_claims reconciled_claims exposure_from_graph graph_projection projected_impacts impact_ranking cleaned_documents integrity_suite "
    "snapshot_validation sector_fallback fixed_basket_walk theme_lineage theme_families panel_report panel_points theme_levels main_theme_relevance subgraph_of_communities theme_names evidence_snippets "
    "panel_entities monthly_partitions trajectories_by_month chunk_sources theme_dossier news_selection filing_paths linked_steps model_calls"
).split()
QUERIES = {name: globals()[name] for name in (*NAMES, *NO_SQL)}
