"""Exposure of companies to themes, from the graph: admission of edges, distances, direct evidence and the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.operators.graph import STRUCTURAL, bfs, exposure_score, undirected
from narrascope.operators.pit import known_at

#: Methods that count, and those that a flag adds.
STATED, WEAK_METHODS = ("document_stated",), ("llm_inferred", "metadata_inferred")
#: Edge types whose sign is read from the text; others have the sign of their type.
SIGNED_TYPES = ("causes", "exposed_to", "sensitive_to")
BASE_POLARITY = {"benefits": 1, "hurts": -1, "reports": 1, "guides_to": 1}
EVIDENCE_SHOWN = 10
MOST_HOPS = 64


def admitted(entities: DataFrame, edges: DataFrame, as_of: str | Column, weak: bool = False) -> DataFrame:
    """Structural edges known at ``as_of``, of a method that counts, between entities known then; undated rows are out."""
    methods = STATED + (WEAK_METHODS if weak else ())
    known = entities.where(known_at(F.col("first_seen"), as_of)).select("entity_id")
    live = edges.where(known_at(F.col("first_seen"), as_of) & F.col("method").isin(*methods) & F.col("edge_type").isin(*STRUCTURAL))
    return live.join(known.select(F.col("entity_id").alias("src")), "src", "left_semi").join(known.select(F.col("entity_id").alias("dst")), "dst", "left_semi")


def polarity(edges: DataFrame) -> DataFrame:
    """``edges`` with polarity: the direction in the text for signed types (0 if there is none or it is no sign), else that of the type."""
    said = F.expr("try_cast(direction AS INT)")
    base = F.lit(0)
    for kind, sign in BASE_POLARITY.items():
        base = F.when(F.col("edge_type") == kind, sign).otherwise(base)
    return edges.withColumn("polarity", F.when(F.col("edge_type").isin(*SIGNED_TYPES), F.when(said.isin(-1, 0, 1), said).otherwise(0)).otherwise(base).cast("int"))


def build_graph(entities: DataFrame, edges: DataFrame, as_of: str | Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (without documents, labelled by canonical name, name or id) and signed, weighted edges known at ``as_of``.

    Edges stay when an end is no node, as the contract has it.
    """
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    label = F.coalesce(*[filled(c) for c in ("canonical_name", "name") if c in entities.columns], F.col("entity_id"))
    nodes = entities.where(known_at(F.col("first_seen"), as_of) & (F.col("entity_type") != "Document")).withColumn("label", label)
    signed = polarity(edges.where(known_at(F.col("first_seen"), as_of)))
    return nodes, signed.withColumn("weight", F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.01)))


def exposure_parts(entities: DataFrame, edges: DataFrame, nodes: DataFrame, members: DataFrame, snapshots: DataFrame, as_of: str | Column, weak: bool = False) -> DataFrame:
    """One row for each community and company that structural edges connect.

    ``members``: community, entity_id; ``snapshots``: community, theme_snapshot_id, communities without one are skipped;
    ``edges``: edge_id, src, dst, edge_type, method, confidence, first_seen, evidence; ``nodes``: entity_id of the graph.
    Distance is that of the shortest way to a member, over all communities at once. Confidence, evidence and recency are
    those of the company's edges with members; without any, recency is a half. Self loops count nothing. Where ``as_of`` is
    a column of entities, edges and nodes, these are of several points, under ids that no two points share.
    """
    point = [] if isinstance(as_of, str) else ["as_of"]
    live = admitted(entities, edges, as_of, weak)
    themes = members.join(snapshots, "community", "left_semi").distinct()
    known = entities.where(known_at(F.col("first_seen"), as_of))
    companies = known.where("entity_type = 'Company'").select(F.col("entity_id").alias("company_id"))
    seeds = themes.join(known.select("entity_id"), "entity_id", "left_semi").select(F.col("community").alias("seed"), F.col("entity_id").alias("node"))
    reached = bfs(seeds, live.select("src", "dst"), MOST_HOPS)
    pairs = reached.join(companies, F.col("node") == F.col("company_id"), "left_semi").select(F.col("seed").alias("community"), F.col("node").alias("company_id"), "dist")

    both = undirected(live, "edge_id", "confidence", "first_seen", "evidence", *point)
    touching = both.join(companies, F.col("node") == F.col("company_id")).join(themes.select("community", F.col("entity_id").alias("other")), "other")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("first_seen"))
    of_edges = touching.groupBy("community", "company_id").agg(
        F.sum(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.avg(F.greatest(F.lit(0.0), 1 - age / 365.0)).alias("recency"),
    )
    # chunks are counted one by one: no list of all the chunks of a pair
    chunks = touching.select("community", "company_id", F.explode("evidence").alias("chunk")).distinct()
    of_chunks = chunks.groupBy("community", "company_id").agg(F.count("*").alias("evidence"))
    placed = nodes.select(F.col("entity_id").alias("node"), *point).distinct()
    n_nodes = placed.groupBy(*point).agg(F.count("*").alias("n"))  # a row for each point
    degree = both.select("node", "other").distinct().groupBy("node").agg(F.count("*").alias("degree")).join(placed, "node")
    degree = degree.join(F.broadcast(n_nodes), point) if point else degree.join(F.broadcast(n_nodes))
    central = degree.select(F.col("node").alias("company_id"), F.least(F.lit(1.0), F.col("degree") / F.greatest(F.lit(1), F.col("n") - 1)).alias("centrality"))
    out = pairs.join(of_edges, ["community", "company_id"], "left").join(of_chunks, ["community", "company_id"], "left").join(central, "company_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("community", "company_id", "dist", zero("confidence"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("recency", F.lit(0.5)).alias("recency"), zero("centrality"))


def first_evidence(parts: DataFrame, edges: DataFrame, members: DataFrame, most: int = EVIDENCE_SHOWN) -> DataFrame:
    """(community, company_id, top_evidence_chunk_ids): the first chunks, in order of their ids, of edges with members."""
    from pyspark.sql import Window

    both = undirected(edges, "evidence").select(F.col("node").alias("company_id"), F.col("other").alias("entity_id"), "evidence")
    chunks = both.join(members, "entity_id").join(parts.select("community", "company_id"), ["community", "company_id"], "left_semi").select("community", "company_id", F.explode("evidence").alias("chunk")).distinct()
    top = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("community", "company_id").orderBy("chunk"))).where(F.col("_n") <= most)
    return top.groupBy("community", "company_id").agg(F.array_sort(F.collect_list("chunk")).alias("top_evidence_chunk_ids"))


def exposure_rows(parts: DataFrame, edges: DataFrame, members: DataFrame, snapshots: DataFrame, weak: bool = False) -> DataFrame:
    """The exposure table of ``parts`` (with as_of): score over all rows of a point, best evidence among ``edges``, method."""
    scored = exposure_score(parts, ["as_of"])
    top = first_evidence(parts, edges, members)
    method = "exposure_v1_include_weak_signals" if weak else "exposure_v1_document_stated"
    out = scored.join(top, ["community", "company_id"], "left").join(snapshots, "community")
    return out.select(
        F.col("as_of").cast("date").alias("as_of_date"), "company_id", "theme_snapshot_id", "community", F.col("exposure").alias("exposure_score"), F.col("dist").cast("double").alias("graph_distance"),
        F.col("confidence").alias("edge_confidence_sum"), F.col("evidence").alias("evidence_count"), F.coalesce("top_evidence_chunk_ids", F.array().cast("array<string>")).alias("top_evidence_chunk_ids"), F.lit(method).alias("calculation_method"),
    )


def compute_exposure(entities: DataFrame, edges: DataFrame, nodes: DataFrame, members: DataFrame, snapshots: DataFrame, as_of: str, weak: bool = False) -> DataFrame:
    """The exposure table of the contract for one point."""
    parts = exposure_parts(entities, edges, nodes, members, snapshots, as_of, weak).withColumn("as_of", F.lit(as_of))
    return exposure_rows(parts, admitted(entities, edges, as_of, weak), members, snapshots, weak)
