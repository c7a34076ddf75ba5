"""Discovery of all points of a panel in one plan: the number of jobs does not depend on the number of points.

Each document is cleaned, chunked and searched once, whatever the points that know it; what it says is then repeated for
the points from the first that knows it on, until an equal text that comes earlier in import order is known. From there
on rows carry their point, and ids of graphs are those of their point, so that the graphs of all points are one graph of
which no two parts touch: one clustering, one search and one score over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.operators import cleaning, exposure, extraction, graph, lineage, reads


def _days(points: list[str]) -> Column:
    """The days of a panel, a short list."""
    return F.array(*[F.lit(p).cast("date") for p in sorted(points)])


def outcomes(raw: DataFrame, points: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cleaned documents, (document_id, since, until)): at which points a document is included, from ``since`` to before ``until`` (null: to the end).

    Gates are those of one point: rows without metadata, unreadable ones and those not yet known are out; of equal cleaned
    texts known at a point the first in import order stays. A text has at most one such row for each point, however many
    documents repeat it.
    """
    blank = F.lit(False)
    for c in cleaning.REQUIRED:
        blank = blank | (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "")
    since = F.array_min(F.filter(_days(points), lambda p: p >= F.col("available_at")))
    fine = ~blank & F.col("raw_text").isNotNull()
    done = cleaning.clean_chain(raw).withColumn("content_hash", F.sha2("clean_text", 256)).withColumn("since", F.when(fine, since))
    done = runtime.staged(done.drop("steps"), "panel-cleaned")
    first = done.where("since IS NOT NULL").groupBy("content_hash", "since").agg(F.min(F.struct("row_number", "document_id")).alias("at"))
    order = Window.partitionBy("content_hash").orderBy("since")  # a row for each point at most
    before = F.min("at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stays = first.withColumn("_before", before).where("_before IS NULL OR at < _before")
    spans = stays.select(F.col("at.document_id").alias("document_id"), "since", F.lead("since").over(order).alias("until"))
    return done, runtime.staged(spans, "panel-spans")


def _at_points(rows: DataFrame, points: list[str]) -> DataFrame:
    """Rows with since and until once for each point, as as_of, that lies between."""
    known = F.filter(_days(points), lambda p: (p >= F.col("since")) & (F.col("until").isNull() | (p < F.col("until"))))
    return rows.withColumn("as_of", F.explode(known)).drop("since", "until")


def _own(id_: Column) -> Column:
    """An id as that of its point; ``_bare`` takes the point off again."""
    return F.concat(F.col("as_of").cast("string"), F.lit("|"), id_)


def _bare(id_: Column) -> Column:
    return F.substring(id_, 12, 1 << 30)


def _clustered(run: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(as_of, community, entity_id) of companies and what they are tied to; nodes that nothing ties are communities of one."""
    typed = nodes.select("as_of", F.col("entity_id").alias("node_id"), F.col("entity_type").alias("node_type"), "first_seen")
    ties = graph.bipartite_edges(typed, edges, F.col("as_of")).select("as_of", "src", "dst", "weight")
    found = graph.communities(ties, ["as_of"]).withColumnRenamed("node", "entity_id")
    spine = typed.where(F.col("node_type").isin("Company", *graph.SPINE_TYPES)).select("as_of", F.col("node_id").alias("entity_id"))
    alone = runtime.staged(runtime.global_rank(spine.join(found, ["as_of", "entity_id"], "left_anti"), ["as_of", "entity_id"], "_place"), "panel-alone")
    offset = alone.groupBy("as_of").agg(F.min("_place").alias("_first"))
    top = found.groupBy("as_of").agg((F.max("community") + 1).alias("_top"))
    rest = alone.join(F.broadcast(offset), "as_of").join(F.broadcast(top), "as_of", "left")  # a row for each point
    rest = rest.select("as_of", "entity_id", (F.col("_place") - F.col("_first") + F.coalesce("_top", F.lit(0))).alias("community"))
    return runtime.staged(found.unionByName(rest).select("as_of", lineage.community_id(run, F.col("community")).alias("community"), "entity_id"), "panel-members")


def extract_panel(raw: DataFrame, points: list[str], extractor: extraction.RuleExtractor | None = None) -> dict[str, DataFrame]:
    """documents, chunks, entities and edges of all points, each with as_of; see ``discover_panel``."""
    if not points:
        raise ValueError("a panel needs points")
    key = ("as_of",)
    cleaned, spans = outcomes(raw, points)
    kept = cleaned.drop("since").join(spans, "document_id").withColumn("included_in_discovery", F.lit(True))
    cut = runtime.staged(cleaning.chunk_rows(kept), "panel-chunks")
    where = runtime.staged(_at_points(cut.join(spans, "document_id").select("chunk_id", "document_id", "available_at", "since", "until"), points), "panel-instances")
    # an id stands for a text and a place in it: what is said there is the same in all documents that repeat it
    made = (extractor or extraction.RuleExtractor()).extract(cut.dropDuplicates(["chunk_id"]).select("chunk_id", "available_at", "text"))
    known = where.select("chunk_id", "available_at", "as_of").distinct()
    mentions = runtime.staged(made["mentions"].drop("available_at"), "panel-mentions").join(known, "chunk_id")
    candidates = runtime.staged(made["candidates"].drop("available_at"), "panel-candidates").join(known, "chunk_id")
    entities = runtime.staged(extraction.roll_up_entities(mentions, key), "panel-entities")
    return {
        "documents": _at_points(kept, points),
        "chunks": where.join(cut.drop("available_at"), ["chunk_id", "document_id"]),
        "entities": entities,
        "edges": runtime.staged(extraction.roll_up_edges(candidates, entities, key), "panel-edges"),
    }


def discover_panel(run: str, raw: DataFrame, points: list[str], extractor: extraction.RuleExtractor | None = None, weak: bool = False) -> dict[str, DataFrame]:
    """Tables of all points, each with as_of: documents, chunks, entities, edges, graph_nodes, graph_edges, communities, theme_metrics and company_theme_exposure.

    ``raw``: the rows that ``cleaning.clean_documents`` takes; ``points``: days, in any order. A point that knows nothing
    has no rows. Without points there is nothing to do, and that is an error.
    """
    made = extract_panel(raw, points, extractor)
    entities, edges = made["entities"], made["edges"]
    own_entities = entities.withColumn("entity_id", _own(F.col("entity_id")))
    own_edges = edges.withColumn("src", _own(F.col("src"))).withColumn("dst", _own(F.col("dst")))
    nodes, links = (runtime.staged(t, "panel-graph") for t in exposure.build_graph(own_entities, own_edges, F.col("as_of")))
    members = _clustered(run, nodes, links)
    themes = members.withColumn("community", _own(F.col("community")))
    inside = graph.community_metrics(themes.select(F.col("entity_id").alias("node"), "community"), links.select("src", "dst", "weight"))
    sizes = nodes.groupBy("as_of").agg(F.count("*").alias("_n"))
    day = F.substring("community", 1, 10).cast("date")
    rows = inside.join(reads.theme_names(themes, nodes), "community", "left").withColumn("as_of", day).join(F.broadcast(sizes), "as_of")
    metrics = rows.withColumn("saturation", F.round(F.col("size") / F.col("_n"), 6)).withColumn("theme_snapshot_id", lineage.snapshot_id(F.col("as_of"), _bare(F.col("community")))).drop("_n")
    metrics = runtime.staged(metrics, "panel-metrics")

    snapshots = metrics.select("community", "theme_snapshot_id")
    pairs = themes.select("community", "entity_id")
    parts = exposure.exposure_parts(own_entities, own_edges, nodes, pairs, snapshots, F.col("as_of"), weak)
    parts = runtime.staged(parts.withColumn("as_of", day), "panel-parts")
    exposed = exposure.exposure_rows(parts, exposure.admitted(own_entities, own_edges, F.col("as_of"), weak), pairs, snapshots, weak)

    ends = lambda t: t.withColumn("src", _bare(F.col("src"))).withColumn("dst", _bare(F.col("dst")))
    return {
        **made,
        "graph_nodes": nodes.withColumn("entity_id", _bare(F.col("entity_id"))),
        "graph_edges": ends(links),
        "communities": members.withColumn("entity_id", _bare(F.col("entity_id"))),
        "theme_metrics": metrics.withColumn("community", _bare(F.col("community"))),
        "company_theme_exposure": exposed.withColumn("as_of", F.col("as_of_date")).withColumn("community", _bare(F.col("community"))).withColumn("company_id", _bare(F.col("company_id"))),
    }
