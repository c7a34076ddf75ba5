"""Texts about themes and results: the narrator's interface, a deterministic one, the dossier that any narrator is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THIN_EVIDENCE = 2
REPORT_ROWS = 20


class Narrator:
    """What a narrator offers; one that calls a model has the same methods."""

    def describe_theme(self, theme: dict) -> str:
        raise NotImplementedError

    def describe_validation(self, summary: dict) -> str:
        raise NotImplementedError


class PlainNarrator(Narrator):
    """Fixed sentences from the numbers alone."""

    def describe_theme(self, theme: dict) -> str:
        return f"{theme['theme_name']}: {theme['size']} nodes, strength {theme['strength']:.2f}."

    def describe_validation(self, summary: dict) -> str:
        kind = "supported" if summary.get("claim_supported") else "illustrative only"
        return f"{summary['n_points']} points, {kind}."


def confidence_cap(n_chunks: int, said: str) -> str | None:
    """Without evidence nothing is said; thin evidence never gives more than low confidence."""
    return None if n_chunks == 0 else "low" if n_chunks < THIN_EVIDENCE else said


def narrate(narrator: Narrator, themes: DataFrame, most: int = 100) -> list[tuple[str, str]]:
    """(community, text) of the strongest themes: a report's list, put together on the driver."""
    rows = themes.orderBy(F.desc("strength"), "community").limit(most).collect()
    return [(r["community"], narrator.describe_theme(r.asDict())) for r in rows]


def dossier(members: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 12) -> DataFrame:
    """(community, place, source, target, edge_type, evidence_chunk_id): the first relationships inside each theme.

    Equal relationships (ends in any case, and type) are one, the most confident; then by confidence and name.
    """
    name = lambda end: nodes.select(F.col("entity_id").alias(end), F.col("label").alias(f"{end}_label"))
    a, b = members.select("community", F.col("entity_id").alias("src")), members.select(F.col("community").alias("_c"), F.col("entity_id").alias("dst"))
    inside = edges.join(a, "src").join(b, "dst").where("community = _c").join(name("src"), "src").join(name("dst"), "dst")
    best = F.max(F.struct("confidence", "edge_id", F.col("src_label").alias("source"), F.col("dst_label").alias("target"), F.array_min("evidence").alias("evidence_chunk_id"))).alias("b")
    one = inside.groupBy("community", F.lower("src_label").alias("_s"), F.lower("dst_label").alias("_t"), "edge_type").agg(best)
    order = Window.partitionBy("community").orderBy(F.desc("b.confidence"), "_s", "_t", "edge_type")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("community", "place", "b.source", "b.target", "edge_type", "b.evidence_chunk_id")


def _table(head: list[str], rows: list[list]) -> list[str]:
    shown = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(shown(x).replace("|", "/") for x in r) + " |" for r in rows], ""]


def report(run: dict, metrics: DataFrame, exposure: DataFrame, validated: DataFrame | None = None, narrator: Narrator | None = None, most: int = REPORT_ROWS) -> str:
    """Markdown of a point: the run, its strongest themes, their most exposed companies, validation; short tables, put together on the driver.

    ``run``: the manifest. Without validation the section says so.
    """
    narrator = narrator or PlainNarrator()
    out = ["# Theme report", "", "## Run", "", *_table(["field", "value"], [[k, run.get(k)] for k in ("run_id", "as_of_date", "created_at", "input_hash", "code_version")])]
    out += ["## Method", "", "Bipartite communities of companies and what they are tied to; exposure from distance, confidence, evidence, recency and centrality.", "", "## Themes", ""]
    themes = metrics.orderBy(F.desc("strength"), "community").limit(most).collect()
    out += _table(["theme", "size", "density", "strength"], [[t["theme_name"], t["size"], t["density"], t["strength"]] for t in themes])
    out += [narrator.describe_theme(t.asDict()) for t in themes[:5]] + ["", "## Companies", ""]
    order = Window.partitionBy("community").orderBy(F.desc("exposure_score"), "company_id")
    named = exposure.join(metrics.select("community", "theme_name"), "community").withColumn("_n", F.row_number().over(order)).where("_n <= 5")
    out += _table(["theme", "company", "exposure"], [[r["theme_name"], r["company_id"], r["exposure_score"]] for r in named.orderBy(F.desc("exposure_score"), "community", "company_id").limit(most).collect()])
    out += ["## Validation", ""]
    if validated is None:
        return "\n".join([*out, "Not validated.", ""])
    rows = validated.orderBy(F.desc_nulls_last("excess"), "theme", "benchmark").limit(most).collect()
    out += _table(["theme", "window", "benchmark", "basket", "benchmark return", "excess"], [[r["theme"], r["forward_window"], r["benchmark"], r["basket_ret"], r["benchmark_ret"], r["excess"]] for r in rows])
    caveats = [r[0] for r in validated.select("caveats").distinct().orderBy("caveats").limit(most).collect()]
    return "\n".join([*out, *[f"* {c}" for c in caveats], "", "Illustrative; one point is no evidence of skill.", ""])


def main_dossier(dossiers: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Relationships of main themes: those of their sub-themes, each once. ``hierarchy``: main_theme, community."""
    rows = dossiers.join(hierarchy.distinct(), "community")
    return rows.groupBy("main_theme", "source", "target", "edge_type").agg(F.min("evidence_chunk_id").alias("evidence_chunk_id"))
