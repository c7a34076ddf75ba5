"""Themes over several points: lineage by Jaccard, life-cycle events, states, momentum, relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jaccard_links(members: DataFrame, least: float = 0.5) -> DataFrame:
    """Themes of adjacent points with enough common members: (idx, theme, next_theme, jaccard). ``members``: idx, theme, member."""
    size = members.groupBy("idx", "theme").agg(F.countDistinct("member").alias("n"))
    m = members.select("idx", "theme", "member").distinct()
    a, b = m.alias("a"), m.select((F.col("idx") - 1).alias("idx"), F.col("theme").alias("next_theme"), "member").alias("b")
    common = a.join(b, ["idx", "member"]).groupBy("idx", "theme", "next_theme").agg(F.count("*").alias("both"))
    nxt = size.select((F.col("idx") - 1).alias("idx"), F.col("theme").alias("next_theme"), F.col("n").alias("m"))
    j = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    return common.join(size, ["idx", "theme"]).join(nxt, ["idx", "next_theme"]).where(j >= least).select("idx", "theme", "next_theme", F.round(j, 6).alias("jaccard"))


def lifecycle(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Event of each (idx, theme): emerged, persisted, split or merged; a merge outranks a split."""
    parents = links.groupBy((F.col("idx") + 1).alias("idx"), F.col("next_theme").alias("theme")).agg(F.count("*").alias("n_parents"), F.min("theme").alias("_any"))
    children = links.groupBy("idx", "theme").agg(F.count("*").alias("n_children"))
    widest = links.join(children, ["idx", "theme"]).groupBy((F.col("idx") + 1).alias("idx"), F.col("next_theme").alias("theme")).agg(F.max("n_children").alias("siblings"))
    out = nodes.join(parents, ["idx", "theme"], "left").join(widest, ["idx", "theme"], "left")
    event = F.when(F.col("n_parents").isNull(), "emerged").when(F.col("n_parents") > 1, "merged").when(F.col("siblings") > 1, "split").otherwise("persisted")
    return out.select("idx", "theme", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), event.alias("event"))


def states_by_point(present: DataFrame, points: DataFrame) -> DataFrame:
    """(family, idx, state) for all points: present, dormant between first and last, else absent."""
    life = present.groupBy("family").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    grid = life.crossJoin(F.broadcast(points.select("idx").distinct()))  # a row for each family and point is what is asked for
    seen = present.select("family", "idx").distinct().withColumn("_seen", F.lit(1))
    state = F.when(F.col("_seen").isNotNull(), "present").when((F.col("idx") > F.col("first")) & (F.col("idx") < F.col("last")), "dormant").otherwise("absent")
    return grid.join(seen, ["family", "idx"], "left").select("family", "idx", state.alias("state"))


def momentum(sizes: DataFrame, least: int = 3) -> DataFrame:
    """(theme, n_months, last_size, momentum, emerged): change over the last step, first month with ``least`` members."""
    order = Window.partitionBy("theme").orderBy("month")
    rows = sizes.withColumn("_before", F.lag("size").over(order))
    s = rows.groupBy("theme").agg(F.count("*").alias("n_months"), F.max_by("size", "month").alias("last_size"), F.max_by("_before", "month").alias("_b"), F.min(F.when(F.col("size") >= least, F.col("month"))).alias("emerged"))
    return s.select("theme", "n_months", "last_size", (F.col("last_size") - F.coalesce("_b", F.lit(0))).alias("momentum"), "emerged")


def relevance(evidence: DataFrame, as_of: str, window_days: int = 90) -> DataFrame:
    """Share of recent evidence, mean of 1 - age / 365 and a state, by theme; repeated evidence counts each time."""
    end = F.lit(as_of).cast("date")
    age = F.datediff(end, F.col("day"))
    live = evidence.where(F.col("day").isNotNull() & (F.col("day") <= end))
    s = live.groupBy("theme").agg(F.count("*").alias("n"), F.max("day").alias("latest"), F.avg((age <= window_days).cast("double")).alias("recent_share"), F.avg(F.greatest(F.lit(0.0), 1 - age / 365.0)).alias("relevance"))
    r = F.col("recent_share")
    state = F.when(r >= 0.5, "active").when(r >= 0.2, "cooling").when(r > 0, "fading").otherwise("dormant")
    return s.select("theme", "n", "latest", F.round("recent_share", 6).alias("recent_share"), F.round("relevance", 6).alias("relevance"), state.alias("state"))


def level_composition(members: DataFrame) -> DataFrame:
    """Members by level and the dominant one; ties go to macro, industry, company, idiosyncratic in that order."""
    levels = ("macro", "industry", "company", "idiosyncratic")
    s = members.groupBy("theme").agg(*[F.sum((F.col("level") == x).cast("long")).alias(x) for x in levels])
    ranked = F.array(*[F.struct(F.col(x).alias("n"), F.lit(-k).alias("p"), F.lit(x).alias("level")) for k, x in enumerate(levels)])
    return s.withColumn("dominant", F.array_max(ranked)["level"])
