"""Theme families over the points of a panel: links, lifecycle events, families, states, trajectories and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.operators.graph import connected_components

MATCH, REVIVE, LEAST_SIZE = 0.5, 0.5, 3


def substantive(themes: DataFrame, members: DataFrame) -> DataFrame:
    """Themes of at least three nodes that have companies. ``themes``: idx, theme, size; ``members``: idx, theme, company."""
    return themes.where(F.col("size") >= LEAST_SIZE).join(members.select("idx", "theme").distinct(), ["idx", "theme"], "left_semi")


def jaccard_of(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Pairs of sets that share a company: the keys and ``jaccard``. Both sides: keys and company, without repeats."""
    n = a.groupBy(*left).agg(F.count("*").alias("_n"))
    k = b.groupBy(*right).agg(F.count("*").alias("_k"))
    shared = a.join(b, "company").groupBy(*left, *right).agg(F.count("*").alias("_both"))
    return shared.join(n, left).join(k, right).withColumn("jaccard", F.col("_both") / (F.col("_n") + F.col("_k") - F.col("_both"))).drop("_n", "_k", "_both")


def family_lineage(nodes: DataFrame, members: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(lineage, families) of themes at the points of a run.

    ``nodes``: idx (0, 1, ... over the points), as_of, theme, snapshot_id; ``members``: idx, theme, company. Themes of
    neighbouring points are linked by the Jaccard index of their companies; linked themes are a family, and so are
    families of which one ends and the other begins, with alike companies, after a gap of a point or more. A theme
    without a parent has emerged, or is revived where its family was there before; two parents merge, and a parent of
    several children splits. The id of a family is the hash of its snapshots.
    """
    nodes = runtime.staged(nodes.select("idx", "as_of", "theme", "snapshot_id").distinct().withColumn("key", F.format_string("%06d|%s", F.col("idx").cast("int"), F.col("theme"))), "theme-nodes")
    members = runtime.staged(members.select("idx", "theme", "company").distinct().join(nodes.select("idx", "theme", "key"), ["idx", "theme"]), "theme-members")
    a = members.select(F.col("key").alias("src"), F.col("idx").alias("a_idx"), "company")
    b = members.select(F.col("key").alias("dst"), (F.col("idx") - 1).alias("a_idx"), "company")
    size = members.groupBy("key").agg(F.count("*").alias("n"))
    both = a.join(b, ["a_idx", "company"]).groupBy("src", "dst").agg(F.count("*").alias("both"))
    ratio = both.join(size.select(F.col("key").alias("src"), "n"), "src").join(size.select(F.col("key").alias("dst"), F.col("n").alias("k")), "dst")
    links = runtime.staged(ratio.withColumn("jaccard", F.col("both") / (F.col("n") + F.col("k") - F.col("both"))).where(F.col("jaccard") >= MATCH).select("src", "dst", "jaccard"), "theme-links")

    def families_of(edges: DataFrame) -> DataFrame:
        """(key, root) for every node, alone or not."""
        if not edges.limit(1).count():
            return nodes.select("key", F.col("key").alias("root"))
        found = connected_components(edges.select("src", "dst"))
        return runtime.staged(nodes.select("key").join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("key", F.coalesce("component", "key").alias("root")), "families")

    roots = families_of(links)
    placed = nodes.join(roots, "key")
    span = placed.groupBy("root").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    spine = members.join(roots, "key").join(span, "root")
    ends = spine.where("idx = last").select("root", "company").distinct()
    begins = spine.where("idx = first").select(F.col("root").alias("later"), "company").distinct()
    alike = jaccard_of(ends, begins, ["root"], ["later"]).where(F.col("jaccard") >= REVIVE)
    later = span.select(F.col("root").alias("later"), F.col("first").alias("later_first"))
    gaps = runtime.staged(alike.join(span, "root").join(later, "later").where("later_first > last + 1").select("root", "later"), "revivals")
    whole = families_of(links.select("src", "dst").unionByName(gaps.select(F.col("root").alias("src"), F.col("later").alias("dst"))))
    revived = placed.join(span, "root").where("idx = first").join(gaps.select(F.col("later").alias("root")).distinct(), "root", "left_semi").select("key", F.lit(True).alias("_revived"))

    family = nodes.join(whole, "key").groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("snapshot_id")), "|").alias("_s"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.min_by("as_of", "idx").alias("first_seen"), F.max_by("as_of", "idx").alias("last_seen"), F.countDistinct("idx").alias("n_points"))
    family = family.withColumn("theme_family_id", F.concat(F.lit("family_"), F.substring(F.sha2(F.concat(F.lit(f"family:{run_id}:"), "_s"), 256), 1, 8))).drop("_s")
    children = links.groupBy("src").agg(F.count("*").alias("n_children"))
    parents = links.join(children, "src").groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n_parents"), F.max("jaccard").alias("jaccard"), F.max("n_children").alias("siblings"), F.array_sort(F.collect_list("src")).alias("parents"))
    rows = nodes.join(whole, "key").join(family.select("root", "first", "theme_family_id"), "root").join(parents, "key", "left").join(revived, "key", "left")
    event = F.when(F.col("n_parents").isNull(), F.when(F.coalesce("_revived", F.lit(False)) | (F.col("idx") > F.col("first")), "revived").otherwise("emerged")).when(F.col("n_parents") >= 2, "merged").when(F.col("siblings") >= 2, "split").otherwise("persisted")
    lineage = rows.select("theme_family_id", "idx", "as_of", "theme", "snapshot_id", event.alias("lifecycle_event"), F.round(F.coalesce("jaccard", F.lit(1.0)), 6).alias("confidence"), F.coalesce("n_parents", F.lit(0)).alias("n_parents"))
    companies = members.join(whole, "key").groupBy("root").agg(F.countDistinct("company").alias("n_companies"))
    families = family.join(companies, "root", "left").select("theme_family_id", "first", "last", "first_seen", "last_seen", "n_points", F.coalesce("n_companies", F.lit(0)).alias("n_companies"))
    return runtime.staged(lineage, "lineage"), runtime.staged(families, "theme-families")


def family_states(lineage: DataFrame, families: DataFrame, points: DataFrame) -> DataFrame:
    """(theme_family_id, idx, state) for each family and point: its event, dormant between first and last, else absent.

    Of several themes at one point the first in order counts. ``points`` is the short list of the panel.
    """
    here = lineage.groupBy("theme_family_id", "idx").agg(F.min_by("lifecycle_event", "theme").alias("event"))
    grid = families.select("theme_family_id", "first", "last").join(F.broadcast(points.select("idx").distinct()))
    state = F.coalesce("event", F.when((F.col("idx") > F.col("first")) & (F.col("idx") < F.col("last")), "dormant").otherwise("absent"))
    return grid.join(here, ["theme_family_id", "idx"], "left").select("theme_family_id", "idx", state.alias("state"))


def trajectories(exposure: DataFrame, lineage: DataFrame) -> DataFrame:
    """Exposure of each company to each family at each point, with the theme's event; themes outside all families are left out."""
    return exposure.join(lineage.select("idx", "theme", "theme_family_id", "as_of", "lifecycle_event"), ["idx", "theme"])


def panel_summary(lineage: DataFrame, families: DataFrame, states: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: families, events by kind, dormant states and companies with a trajectory."""
    n = lambda kind: F.sum((F.col("lifecycle_event") == kind).cast("long")).alias(kind)
    events = lineage.agg(*[n(k) for k in ("emerged", "persisted", "split", "merged", "revived")])
    whole = families.agg(F.count("*").alias("family_count")).join(events).join(states.where("state = 'dormant'").agg(F.count("*").alias("dormant")))
    return whole.join(paths.agg(F.countDistinct("company").alias("company_count")))  # four tables of one row


def points_summary(lineage: DataFrame, exposure: DataFrame, points: DataFrame) -> DataFrame:
    """Themes and company-theme pairs of each point."""
    themes = lineage.groupBy("idx").agg(F.count("*").alias("theme_count"))
    pairs = exposure.groupBy("idx").agg(F.count("*").alias("pair_count"))
    out = points.join(themes, "idx", "left").join(pairs, "idx", "left")
    return out.select("idx", "as_of", F.col("theme_count").isNotNull().alias("discovery_present"), F.coalesce("theme_count", F.lit(0)).alias("theme_count"), F.coalesce("pair_count", F.lit(0)).alias("pair_count"))


def months_of_themes(timed_edges: DataFrame, months: list) -> DataFrame:
    """(month_end, src, dst) of all edges known at each of ``months``, the days of a panel: an edge's row is repeated for the days that know it."""
    days = F.array(*[F.lit(m).cast("date") for m in months])
    first = timed_edges.groupBy("src", "dst").agg(F.min("first_seen").alias("first_seen"))
    return first.select(F.explode(F.filter(days, lambda m: m >= F.col("first_seen"))).alias("month_end"), "src", "dst")


def month_ends(first, last) -> list:
    """Last days of all months from that of ``first`` to that of ``last``, which ends on ``last`` itself."""
    import datetime as dt

    out, day = [], first.replace(day=1)
    while day <= last:
        day = (day + dt.timedelta(days=32)).replace(day=1)
        out.append(min(day - dt.timedelta(days=1), last))
    return out


def theme_trajectories(members: DataFrame, least_size: int = LEAST_SIZE) -> DataFrame:
    """How each theme of the last month has grown: theme, month_end, overlap, size, emerged, momentum, size_now.

    ``members``: month_end, community, node. At each month a theme is met by the community that shares most of its nodes, of
    several such the largest, of equals the first; ``size`` is that community's, both are 0 where nothing is shared.
    ``emerged`` is the first month with ``least_size`` nodes, the last month if there is none; ``momentum`` is what the last
    month added. Themes under ``least_size`` nodes are left out.
    """
    sized = runtime.staged(members.groupBy("month_end", "community").agg(F.count("*").alias("size")), "theme-sizes")
    months = sized.select("month_end").distinct()
    last = sized.agg(F.max("month_end").alias("last"))
    final = sized.join(F.broadcast(last), F.col("month_end") == F.col("last")).where(F.col("size") >= least_size).select(F.col("community").alias("theme"), F.col("size").alias("size_now"), "last")
    now = members.withColumnRenamed("community", "theme").join(final, "theme").where("month_end = last").select("theme", "node")
    shared = now.join(members, "node").groupBy("theme", "month_end", "community").agg(F.count("*").alias("overlap")).join(sized, ["month_end", "community"])
    met = shared.groupBy("theme", "month_end").agg(F.max(F.struct("overlap", "size")).alias("best"))
    grid = final.join(F.broadcast(months)).join(met, ["theme", "month_end"], "left")  # a row for each theme and point of the panel
    grid = runtime.staged(grid.select("theme", "month_end", "size_now", "last", F.coalesce("best.overlap", F.lit(0)).alias("overlap"), F.coalesce("best.size", F.lit(0)).alias("size")), "trajectories")
    order = F.array_sort(F.collect_list(F.struct("month_end", "size")))
    whole = grid.groupBy("theme", "last").agg(F.min(F.when(F.col("size") >= least_size, F.col("month_end"))).alias("emerged"), order.alias("_s"))
    before = F.coalesce(F.try_element_at("_s", F.lit(-2))["size"], F.element_at("_s", -1)["size"])
    facts = whole.select("theme", F.coalesce("emerged", "last").alias("emerged"), (F.element_at("_s", -1)["size"] - before).alias("momentum"))
    return grid.join(facts, "theme").select("theme", "month_end", "overlap", "size", "emerged", "momentum", "size_now")


def snapshot_id(as_of: Column, community: Column) -> Column:
    return F.concat(F.lit("theme_"), F.date_format(as_of, "yyyyMMdd"), F.lit("_"), F.substring(F.sha2(F.concat(F.lit("snapshot:"), as_of.cast("string"), F.lit(":"), community), 256), 1, 8))


def community_id(run_id: str, index: Column) -> Column:
    h = F.substring(F.sha2(F.concat(F.lit(f"community:{run_id}:"), index.cast("string")), 256), 1, 8)
    return F.concat(F.lit("community_"), F.lpad(index.cast("string"), 3, "0"), F.lit("_"), h)


def first_rows(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
