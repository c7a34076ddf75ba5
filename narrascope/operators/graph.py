"""Property-graph operators as joins: projection, metrics, breadth-first search, propagation, components, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.operators.communities import communities
from narrascope.operators.components import components
from narrascope.operators.pit import known_at

#: Fixed values of the ontology.
STRUCTURAL = ("causes", "benefits", "hurts", "exposed_to", "sensitive_to", "reports", "guides_to")
SPINE_TYPES = ("EconomicConcept", "Commodity", "MacroIndicator", "Event")
CLUSTER_METHODS = ("document_stated", "metadata_inferred")
#: Weights of the exposure score: proximity, confidence, evidence, recency, centrality.
EXPOSURE_WEIGHTS = (0.30, 0.25, 0.20, 0.15, 0.10)


def weight(confidence: Column) -> Column:
    return F.greatest(confidence, F.lit(0.01))


def bipartite_edges(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Edges that take part in clustering: known, structural, of a method that counts, between a company and a spine node."""
    known = nodes.where(known_at(F.col("first_seen"), as_of)).select("node_id", "node_type")
    s, t = known.select(F.col("node_id").alias("src"), F.col("node_type").alias("src_type")), known.select(F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type"))
    live = edges.where(known_at(F.col("first_seen"), as_of) & F.col("edge_type").isin(*STRUCTURAL) & F.col("method").isin(*CLUSTER_METHODS))
    company_first = (F.col("src_type") == "Company") & F.col("dst_type").isin(*SPINE_TYPES)
    return live.join(s, "src").join(t, "dst").where(company_first | ((F.col("dst_type") == "Company") & F.col("src_type").isin(*SPINE_TYPES)))


def undirected(edges: DataFrame, *keep: str) -> DataFrame:
    """Both directions, no loops."""
    e = edges.where("src != dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other"), *keep).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), *keep))


def degree_centrality(edges: DataFrame, n_nodes: Column | int) -> DataFrame:
    n = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    d = undirected(edges).distinct().groupBy("node").agg(F.count("*").alias("degree"))
    return d.select("node", "degree", F.round(F.when(n > 1, F.least(F.lit(1.0), F.col("degree") / (n - 1))).otherwise(0.0), 6).alias("centrality"))


def community_metrics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """community, size, internal edges, density (0 under two members), strength (mean weight, 0 without edges)."""
    a = members.select(F.col("node").alias("src"), F.col("community"))
    b = members.select(F.col("node").alias("dst"), F.col("community").alias("_c"))
    inside = edges.join(a, "src").join(b, "dst").where("community = _c").groupBy("community").agg(F.count("*").alias("m"), F.avg("weight").alias("s"))
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    n, m = F.col("size"), F.coalesce("m", F.lit(0))
    density = F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), m / (n * (n - 1) / 2.0)))
    return size.join(inside, "community", "left").select("community", "size", m.alias("n_edges"), F.round(density, 6).alias("density"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("strength"))


def bfs(seeds: DataFrame, edges: DataFrame, most_hops: int) -> DataFrame:
    """(seed, node, dist): unweighted distance over undirected edges from every seed set at once; seed nodes are at 0.

    Sixty-four seeds travel in the bits of one number, so that a hop shuffles the edges once for all of them and a node is
    one row a hop. A neighbour of what was reached in a hop is at most one hop nearer or further, so only the last two
    hops are taken off the next. Hops are written to the shared folder.
    """
    # edges go to the hop's nodes, so a node's edges are read where its bits are
    adjacent = runtime.staged(undirected(edges).distinct(), "adjacency")
    names = runtime.staged(runtime.global_rank(seeds.select("seed").distinct(), ["seed"], "_n"), "seeds")
    names = names.select("seed", F.expr("_n div 64").alias("block"), (F.col("_n") % 64).cast("int").alias("bit"))
    bit = F.expr("shiftleft(1L, bit)")
    now = seeds.join(names, "seed").groupBy("block", "node").agg(F.bit_or(bit).alias("bits"))
    now, before, hops = runtime.staged(now, "hop"), None, []
    hops.append(now.withColumn("dist", F.lit(0)))
    for hop in range(1, most_hops + 1):
        step = now.join(adjacent, "node").groupBy("block", F.col("other").alias("node")).agg(F.bit_or("bits").alias("bits"))
        for old in (now, before) if before is not None else (now,):
            step = step.join(old.withColumnRenamed("bits", "_old"), ["block", "node"], "left").select("block", "node", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long")))).alias("bits"))
        before, now = now, runtime.staged(step.where("bits != 0"), "hop")
        if not now.limit(1).count():
            break
        hops.append(now.withColumn("dist", F.lit(hop)))
    reached = hops[0]
    for found in hops[1:]:
        reached = reached.unionByName(found)
    every = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(F.col("bits"), b) == 1)
    return reached.select("block", "node", "dist", F.explode(every).alias("bit")).join(names, ["block", "bit"]).select("seed", "node", "dist")


def bounded_slice(edges: DataFrame, anchor: str, depth: int = 2, most_nodes: int = 200, least_weight: float = 0.0) -> DataFrame:
    """Nodes around one anchor: (node, hop); when there are too many, those found by the heaviest edges, then by id."""
    live = edges.where(F.col("weight") >= least_weight)
    near = runtime.staged(undirected(live, "weight"), "slice-edges")
    found = edges.sparkSession.createDataFrame([(anchor, 0, 0.0)], "node string, hop int, via double")
    frontier = found
    for hop in range(1, depth + 1):
        step = frontier.select("node").join(near, "node").groupBy(F.col("other").alias("node")).agg(F.max("weight").alias("via"))
        frontier = runtime.staged(step.join(found.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"), "via"), "slice-hop")
        room = most_nodes - found.count()  # at most most_nodes rows
        frontier = frontier.orderBy(F.desc("via"), "node").limit(max(0, room))
        found = runtime.staged(found.unionByName(frontier), "slice")
    return found.select("node", "hop")


def propagate(triggers: DataFrame, edges: DataFrame, companies: DataFrame, most_hops: int = 3, decay: float = 0.8, shock: float = 1.0) -> DataFrame:
    """(trigger, company, impact, direction, n_paths): signed sum over simple directed paths of nonzero polarity.

    A path counts at every company it comes to, and goes on through it.
    """
    live = edges.where("polarity != 0 and src != dst").select("src", "dst", "polarity", "weight")
    paths = triggers.select(F.col("node").alias("trigger"), F.col("node").alias("tip"), F.array("node").alias("path"), F.lit(float(shock)).alias("force"))
    out = None
    for hop in range(1, most_hops + 1):
        step = paths.join(live, paths["tip"] == live["src"]).where(~F.array_contains("path", F.col("dst")))
        paths = runtime.staged(step.select("trigger", F.col("dst").alias("tip"), F.array_append("path", F.col("dst")).alias("path"), (F.col("force") * F.col("polarity") * F.col("weight") * decay).alias("force")), f"paths-{hop}")
        hit = paths.join(companies.select(F.col("node").alias("tip")), "tip")
        out = hit if out is None else out.unionByName(hit)
    total = out.groupBy("trigger", F.col("tip").alias("company")).agg(F.sum("force").alias("impact"), F.count("*").alias("n_paths"))
    total = total.withColumn("impact", F.round("impact", 6)).where("impact != 0")
    return total.select("trigger", "company", "impact", F.signum("impact").cast("int").alias("direction"), "n_paths")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable."""
    return components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def exposure_score(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Score from distance, confidence sum, evidence count, recency and centrality; normalised over each point alone."""
    whole = Window.partitionBy(*keys)
    a, b, c, d, e = EXPOSURE_WEIGHTS
    top_conf, top_ev = F.max("confidence").over(whole), F.greatest(F.lit(1), F.max("evidence").over(whole))
    score = a / (1 + F.col("dist")) + b * F.when(top_conf > 0, F.col("confidence") / top_conf).otherwise(0.0) + c * F.log1p(F.col("evidence")) / F.log1p(top_ev) + d * F.coalesce("recency", F.lit(0.5)) + e * F.col("centrality")
    return parts.withColumn("exposure", F.round(score, 6))


def recency(day: Column, as_of: Column) -> Column:
    """1 today, 0 after a year; undated and future evidence count nothing."""
    age = F.datediff(as_of, day)
    return F.when(day.isNull() | (age < 0), 0.0).otherwise(1 - F.least(age, F.lit(365)) / 365.0)
