"""Projected impacts of events on companies: signed paths with their edges, evidence, and what a front end shows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.operators.exposure import SIGNED_TYPES
from narrascope.operators.pit import known_at

MOST_HOPS, DECAY, SHOCK = 3, 0.8, 1.0
METHOD = "signed_path_propagation_v1"


def signed_paths(triggers: DataFrame, edges: DataFrame, companies: DataFrame, most_hops: int = MOST_HOPS, decay: float = DECAY, shock: float = SHOCK, as_of: str | None = None) -> DataFrame:
    """(trigger, company, force, path): simple directed paths over edges of nonzero polarity, with the ids of their edges.

    A path counts at every company it comes to and goes on through it. Edges with a day are gated by ``as_of``, undated
    ones pass. Paths are as many as the graph has: bounded by degree and ``most_hops``.
    """
    live = edges.where("polarity != 0 AND src != dst")
    if as_of is not None and "available_at" in edges.columns:
        live = live.where(known_at(F.col("available_at"), as_of, "open"))
    live = runtime.staged(live.select("edge_id", "src", "dst", "polarity", "weight"), "signed-edges")
    here = triggers.select(F.col("node").alias("trigger"), F.col("node").alias("tip"), F.array("node").alias("seen"), F.array().cast("array<string>").alias("path"), F.lit(float(shock)).alias("force"))
    out = None
    for hop in range(1, most_hops + 1):
        step = here.join(live, here["tip"] == live["src"]).where(~F.array_contains("seen", F.col("dst")))
        force = F.col("force") * F.col("polarity") * F.col("weight") * decay
        here = runtime.staged(step.select("trigger", F.col("dst").alias("tip"), F.array_append("seen", F.col("dst")).alias("seen"), F.array_append("path", F.col("edge_id")).alias("path"), force.alias("force")), f"paths-{hop}")
        hit = here.join(companies.select(F.col("node").alias("tip")), "tip", "left_semi").select("trigger", F.col("tip").alias("company_id"), "force", "path")
        out = hit if out is None else out.unionByName(hit)
    return out


def projected_impacts(nodes: DataFrame, edges: DataFrame, as_of: str, shock: float = SHOCK, most_hops: int = MOST_HOPS, decay: float = DECAY) -> DataFrame:
    """One row for each event and company it reaches: direction, strength, first path, edges, evidence, confidence.

    ``nodes``: entity_id, entity_type; every Event is a trigger. Paths are ordered by their edge ids; confidence is the
    mean weight along the first. Impacts that cancel out are no rows. Evidence is the ordered set of the edges' chunks.
    """
    events = nodes.where("entity_type = 'Event'").select(F.col("entity_id").alias("node")).distinct()
    companies = nodes.where("entity_type = 'Company'").select(F.col("entity_id").alias("node")).distinct()
    paths = runtime.staged(signed_paths(events, edges, companies, most_hops, decay, shock, as_of), "signed-paths")
    total = paths.groupBy("trigger", "company_id").agg(F.sum("force").alias("impact"), F.count("*").alias("n_paths"), F.min("path").alias("path")).where(F.round("impact", 12) != 0)
    used = paths.join(total.select("trigger", "company_id"), ["trigger", "company_id"], "left_semi").select("trigger", "company_id", F.explode("path").alias("edge_id")).distinct()
    chunks = used.join(edges.select("edge_id", "evidence"), "edge_id")
    # a pair's edges are those of its paths; its chunks those of these edges
    own = chunks.groupBy("trigger", "company_id").agg(F.array_sort(F.collect_set("edge_id")).alias("contributing_edge_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence_chunk_ids"))
    steps = total.select("trigger", "company_id", F.explode("path").alias("edge_id")).join(edges.select("edge_id", "weight"), "edge_id", "left")
    sure = steps.groupBy("trigger", "company_id").agg(F.avg(F.coalesce("weight", F.lit(1.0))).alias("confidence"))
    rows = total.join(own, ["trigger", "company_id"]).join(sure, ["trigger", "company_id"])
    return rows.select(
        F.lit(as_of).cast("date").alias("as_of_date"), F.col("trigger").alias("trigger_id"), F.lit("Event").alias("trigger_kind"), "company_id", F.signum("impact").cast("int").alias("direction"), F.abs("impact").alias("strength"),
        "path", "n_paths", "contributing_edge_ids", "evidence_chunk_ids", "confidence", F.lit(METHOD).alias("method"),
    )


def ranked(impacts: DataFrame) -> DataFrame:
    """Place of each impact under its trigger: the strongest first, then by company."""
    return impacts.withColumn("position", F.row_number().over(Window.partitionBy("trigger_id").orderBy(F.desc("strength"), "company_id")))


def path_graph(impacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the first path of each impact in order, and whether all edges of the path are of a type without a sign of its own."""
    steps = impacts.select("trigger_id", "company_id", F.posexplode("path").alias("step", "edge_id")).join(edges.select("edge_id", "src", "dst", "edge_type", "polarity"), "edge_id")
    blind = F.min((~F.col("edge_type").isin(*SIGNED_TYPES)).cast("int")).over(Window.partitionBy("trigger_id", "company_id")) == 1
    return steps.withColumn("sign_blind", blind)


def trigger_list(impacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triggers with the number of companies they reach, in order of their labels."""
    n = impacts.groupBy("trigger_id").agg(F.countDistinct("company_id").alias("n_companies"))
    named = n.join(nodes.select(F.col("entity_id").alias("trigger_id"), "label"), "trigger_id", "left")
    order = Window.orderBy(F.lower(F.coalesce("label", "trigger_id")), "trigger_id")  # a row for each event
    return named.select("trigger_id", F.coalesce("label", "trigger_id").alias("label"), "n_companies").withColumn("position", F.row_number().over(order))
