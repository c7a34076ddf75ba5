"""Reads over a run's tables: sources of evidence, subgraphs, themes and their roll-ups, evidence sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of entity types, their order of precedence, and edges that only tie evidence.
LEVEL_OF = {
    "Company": "company", "Sector": "industry", "Commodity": "macro", "MacroIndicator": "macro", "EconomicConcept": "contextual", "Event": "idiosyncratic",
    "Geography": "contextual", "Document": "evidence", "FinancialMetric": "company", "Sentiment": "company",
}
LEVELS = ("macro", "industry", "company", "idiosyncratic")
EVIDENCE_EDGES = ("mentioned_in", "co_occurs_with")
SNIPPET_CHARS, SNIPPET_SENTENCES = 260, 2


def level_of(entity_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVEL_OF.items() for x in pair]), entity_type)


def chunk_source(wanted: DataFrame, chunks: DataFrame, documents: DataFrame, raw: DataFrame) -> DataFrame:
    """A chunk with its whole document (its chunks in order) and where that came from; blanks are filled from the raw row.

    ``wanted``: chunk_id; chunks that are not there give no row.
    """
    mine = wanted.select("chunk_id").distinct().join(chunks, "chunk_id")
    whole = chunks.join(mine.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "chunk_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("document_text"))
    d = documents.select("document_id", "raw_document_id", *[F.col(c).alias(f"_{c}") for c in ("title", "source", "document_type", "published_at")])
    r = raw.select(F.col("document_id").alias("raw_document_id"), "source_url", *[F.col(c).alias(f"raw_{c}") for c in ("title", "source", "document_type", "published_at")])
    out = mine.select("chunk_id", "document_id", F.col("text").alias("chunk_text"), "available_at", "section_title").join(whole, "document_id").join(d, "document_id", "left").join(r, "raw_document_id", "left")
    return out.select("chunk_id", "chunk_text", "document_id", "available_at", "section_title", *[F.coalesce(f"_{c}", f"raw_{c}").alias(c) for c in ("title", "source", "document_type", "published_at")], "source_url", "document_text")


def community_subgraph(members: DataFrame, wanted: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (with level) of the communities asked for, and edges between them that are more than evidence."""
    ids = members.join(wanted, "community", "left_semi").select("entity_id").distinct()
    kept = nodes.join(ids, "entity_id", "left_semi").select("entity_id", F.coalesce("label", "entity_id").alias("label"), "entity_type", level_of(F.col("entity_type")).alias("level"))
    inside = edges.where(~F.col("edge_type").isin(*EVIDENCE_EDGES))
    inside = inside.join(kept.select(F.col("entity_id").alias("src")), "src", "left_semi").join(kept.select(F.col("entity_id").alias("dst")), "dst", "left_semi")
    return kept, inside.select("src", "dst", "edge_type")


def _dominant(counts: dict[str, Column]) -> Column:
    """The level of most members; ties go to the first of LEVELS; contextual without any."""
    ranked = F.array(*[F.struct(counts[x].alias("n"), F.lit(-k).alias("p"), F.lit(x).alias("level")) for k, x in enumerate(LEVELS)])
    best = F.array_max(ranked)
    return F.when(best["n"] > 0, best["level"]).otherwise("contextual")


def theme_levels(members: DataFrame, nodes: DataFrame, strength: DataFrame, least_size: int = 3) -> DataFrame:
    """Members of each theme by level, the dominant level, size, strength and whether the theme is substantive.

    ``strength``: community, strength, of which the largest counts.
    """
    typed = members.select("community", "entity_id").distinct().join(nodes.select("entity_id", level_of(F.col("entity_type")).alias("level")), "entity_id", "left")
    s = typed.groupBy("community").agg(F.count("*").alias("size"), *[F.sum((F.coalesce("level", F.lit("")) == x).cast("long")).alias(x) for x in LEVELS])
    best = strength.groupBy("community").agg(F.max("strength").alias("strength"))
    out = s.join(best, "community", "left").withColumn("strength", F.round(F.coalesce("strength", F.lit(0.0)), 4)).withColumn("dominant", _dominant({x: F.col(x) for x in LEVELS}))
    return out.withColumn("substantive", (F.col("size") >= least_size) & (F.col("strength") > 0))


def main_theme_levels(levels: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Level counts of main themes over their sub-themes. ``hierarchy``: main_theme, community."""
    s = hierarchy.distinct().join(levels, "community").groupBy("main_theme").agg(*[F.sum(x).alias(x) for x in LEVELS], F.sum(F.col("substantive").cast("long")).alias("substantive_sub_count"))
    return s.withColumn("dominant", _dominant({x: F.col(x) for x in LEVELS}))


def theme_evidence_days(theme_edges: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(theme, day) for each dated chunk of each edge of a theme; a chunk counts each time it is evidence."""
    asked = theme_edges.join(edges.select("edge_id", F.explode("evidence").alias("chunk_id")), "edge_id")
    return asked.join(chunks.select("chunk_id", "available_at"), "chunk_id").where("available_at IS NOT NULL").select("theme", F.col("available_at").alias("day"))


def main_theme_relevance(relevance: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Relevance of main themes: that of their most relevant sub-theme (the first in name order of equals), the latest evidence of all."""
    best = F.min(F.struct((-F.col("relevance")).alias("r"), "theme", "state")).alias("b")
    s = hierarchy.select("main_theme", F.col("community").alias("theme")).distinct().join(relevance, "theme").groupBy("main_theme").agg(best, F.max("latest").alias("last_evidence_at"), F.count("*").alias("sub_theme_count"))
    return s.select("main_theme", (-F.col("b.r")).alias("relevance_score"), F.col("b.state").alias("state"), "last_evidence_at", "sub_theme_count")


def theme_names(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, theme_name, top_entities, top_companies): labels in order, the first five, and three of them for the name."""
    rows = members.join(nodes.select("entity_id", "label", "entity_type"), "entity_id")
    own = lambda cond: F.slice(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), 1, 5)
    # a label in order is kept only if it is among the first of its community: no list of a whole community
    firsts = rows.withColumn("_c", F.col("entity_type") == "Company").withColumn("_n", F.dense_rank().over(Window.partitionBy("community", "_c").orderBy("label"))).where("_n <= 5")
    s = firsts.groupBy("community").agg(own(~F.col("_c")).alias("top_entities"), own(F.col("_c")).alias("top_companies"))
    name = F.array_join(F.slice(F.when(F.size("top_entities") > 0, F.col("top_entities")).otherwise(F.col("top_companies")), 1, 3), " + ")
    return s.select("community", name.alias("theme_name"), "top_entities", "top_companies")


def evidence_snippet(text: Column, source: Column, target: Column, prefix: Column | None = None) -> Column:
    """The sentences of an evidence text that name most of the two ends: the shortest of those first, two at most.

    Without one that names either, the first sentence; cut at a fixed length. A ``prefix`` of a fact comes before.
    """
    sentences = F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u001f"), "\u001f"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    named = lambda s, t: ((F.length(t) > 2) & F.lower(s).contains(F.lower(t))).cast("int")
    hits = lambda ss: F.array_sort(F.filter(F.transform(ss, lambda s, i: F.struct((-(named(s, source) + named(s, target))).alias("h"), F.length(s).alias("l"), i.alias("i"), s.alias("s"))), lambda x: x["h"] < 0))
    chosen = lambda ss: F.transform(F.array(hits(ss)), lambda h: F.when(F.size(h) > 0, F.transform(F.slice(h, 1, SNIPPET_SENTENCES), lambda x: x["s"])).otherwise(F.slice(ss, 1, 1)))[0]
    snippet = F.transform(F.array(sentences), lambda ss: F.when(F.size(ss) == 0, F.substring(text, 1, SNIPPET_CHARS)).otherwise(F.substring(F.array_join(chosen(ss), " … "), 1, SNIPPET_CHARS)))[0]
    return snippet if prefix is None else F.concat(F.coalesce(prefix, F.lit("")), snippet)


def link_steps(steps: DataFrame, relationships: DataFrame) -> DataFrame:
    """Steps of an argument with the evidence of the relationship they name (any case); those without are inferred."""
    key = lambda c: F.lower(c)
    known = relationships.groupBy(key("source").alias("_s"), key("target").alias("_t"), "edge_type").agg(F.min_by(F.struct("evidence_chunk_id", "method"), "evidence_chunk_id").alias("r"))
    both = steps.withColumn("_s", key("source")).withColumn("_t", key("target")).join(known, ["_s", "_t", "edge_type"], "left")
    return both.select(*steps.columns, F.col("r.evidence_chunk_id").alias("evidence_chunk_id"), F.coalesce("r.method", F.lit("llm_inferred")).alias("method"))


def add_new_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes with those of ``more`` that are not there yet."""
    return nodes.unionByName(more.join(nodes.select("entity_id"), "entity_id", "left_anti"), allowMissingColumns=True)


def theme_documents(evidence: DataFrame, community: str | None = None, company: str | None = None) -> DataFrame:
    """Rows of the evidence tables for one community or company."""
    if community is not None:
        evidence = evidence.where(F.col("community") == community)
    return evidence.where(F.col("company_id") == company) if company is not None else evidence


class AnchorError(LookupError):
    """No node, or several, fit what was asked for; ``candidates`` names some."""

    def __init__(self, wanted: str, candidates: list[str]):
        super().__init__(f"{wanted}: {'several nodes' if candidates else 'no node'} {', '.join(candidates)}".strip())
        self.candidates = candidates


MOST_CANDIDATES = 10


def find_anchor(nodes: DataFrame, wanted: str) -> str:
    """A node by its id, else by its label in any case, else by a part of the label that only one has."""
    low = wanted.lower()
    label = F.lower(F.coalesce("label", "entity_id"))
    for fits in (F.col("entity_id") == wanted, label == low, label.contains(low)):
        found = [r[0] for r in nodes.where(fits).select("entity_id").distinct().orderBy("entity_id").limit(MOST_CANDIDATES + 1).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise AnchorError(wanted, found[:MOST_CANDIDATES])
    raise AnchorError(wanted, [])


DIRECTIONS = ("out", "in", "both")


def extract_slice(
    nodes: DataFrame, edges: DataFrame, anchor: str, *, depth: int = 2, direction: str = "both", edge_types: list[str] | None = None, levels: list[str] | None = None, methods: list[str] | None = None, least_weight: float = 0.0, most_nodes: int = 200
) -> tuple[DataFrame, DataFrame]:
    """(nodes with hop, edges between them) around an anchor.

    Edges that only tie evidence are never taken. A node of a level that is left out neither comes in nor passes on;
    the anchor always does. Each hop takes the nodes found by the heaviest edges first, then by id, until there are
    ``most_nodes``. ``nodes``: entity_id, label, entity_type; ``edges``: src, dst, edge_type, method, weight.
    """
    from narrascope import runtime
    from narrascope.operators.graph import CLUSTER_METHODS, STRUCTURAL

    if direction not in DIRECTIONS:
        raise ValueError(f"no such direction: {direction}")
    if depth < 0 or most_nodes < 1:
        raise ValueError("depth is 0 or more, most_nodes 1 or more")
    if unknown := set(edge_types or ()) - {*STRUCTURAL, *EVIDENCE_EDGES, "located_in", "expresses_sentiment"}:
        raise ValueError(f"unknown edge types: {sorted(unknown)}")
    if unknown := set(levels or ()) - set(LEVEL_OF.values()):
        raise ValueError(f"unknown levels: {sorted(unknown)}")
    spark = nodes.sparkSession
    start = find_anchor(nodes, anchor)
    known = nodes.withColumn("level", level_of(F.col("entity_type")))
    open_to = known if levels is None else known.where(F.col("level").isin(*levels) | (F.col("entity_id") == start))
    kinds = [t for t in (edge_types if edge_types is not None else STRUCTURAL) if t not in EVIDENCE_EDGES]
    ways = [x for x in (methods if methods is not None else CLUSTER_METHODS) if x in CLUSTER_METHODS]
    live = edges.where(F.col("edge_type").isin(*kinds) & F.col("method").isin(*ways) & (F.coalesce("weight", F.lit(0.0)) >= least_weight))
    live = live.join(open_to.select(F.col("entity_id").alias("src")), "src", "left_semi").join(open_to.select(F.col("entity_id").alias("dst")), "dst", "left_semi")
    live = runtime.staged(live.select("src", "dst", "edge_type", F.coalesce("weight", F.lit(0.0)).alias("weight")), "slice-edges")
    moves = live.where("src != dst")
    forth, back = moves.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"), moves.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight")
    steps = forth if direction == "out" else back if direction == "in" else forth.unionByName(back)
    found = spark.createDataFrame([(start, 0)], "node string, hop int")
    frontier, held = found, 1
    for hop in range(1, depth + 1):
        near = steps.join(frontier.select("node"), "node").groupBy(F.col("other").alias("node")).agg(F.max("weight").alias("via")).join(found.select("node"), "node", "left_anti")
        frontier = runtime.staged(near.orderBy(F.desc("via"), "node").limit(most_nodes - held).select("node", F.lit(hop).alias("hop")), "slice-hop")
        n = frontier.count()  # at most most_nodes
        found, held = found.unionByName(frontier), held + n
        if not n or held >= most_nodes:
            break
    ids = found.select(F.col("node").alias("entity_id"), "hop")
    kept = known.join(F.broadcast(ids), "entity_id").select("entity_id", F.coalesce("label", "entity_id").alias("label"), "entity_type", "level", "hop")
    inside = live.join(F.broadcast(ids.select(F.col("entity_id").alias("src"))), "src", "left_semi").join(F.broadcast(ids.select(F.col("entity_id").alias("dst"))), "dst", "left_semi")
    return kept, inside.select("src", "dst", "edge_type", "weight")


def company_profile(company: str, entities: DataFrame, exposure: DataFrame, names: DataFrame, fundamentals: DataFrame | None, facts: DataFrame | None, as_of: str) -> dict[str, DataFrame]:
    """What is known of a company: itself, its themes by exposure, reported fundamentals known at ``as_of``, claims (undated ones too)."""
    from narrascope.operators.pit import known_at

    own = entities.where(F.col("entity_id") == company)
    if not own.limit(1).count():
        raise LookupError(f"entity not found: {company}")
    themes = exposure.where(F.col("company_id") == company).join(names, "community", "left").select("community", F.coalesce("theme_name", "community").alias("theme_name"), "theme_snapshot_id", "exposure_score").orderBy(F.desc("exposure_score"), "community")
    out = {"company": own, "themes": themes}
    if fundamentals is not None:
        out["fundamentals"] = fundamentals.where((F.col("company_id") == company) & known_at(F.col("available_at"), as_of))
    if facts is not None:
        out["financial_facts"] = facts.where((F.col("company_id") == company) & known_at(F.col("available_at"), as_of, "open"))
    return out
