"""Reads that a front end asks for: ordered provenance, lookups, profiles, theme matches and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions.ids import edge_id, entity_id


def ordered_documents(rows: DataFrame, key: str, chunks: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Documents of an evidence list in the order of its first chunk of each."""
    at = rows.select(key, F.posexplode(evidence).alias("pos", "chunk_id")).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    first = at.groupBy(key, "document_id").agg(F.min("pos").alias("pos"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "document_id"))).alias("d")).select(key, F.transform("d", lambda x: x["document_id"]).alias("documents"))


def alias_rows(entities: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(entity_id, alias, confidence): the name itself 1.0, its ticker 0.99, known abbreviations 0.95; the best of equal aliases."""
    own = entities.select("entity_id", F.col("name").alias("alias"), F.lit(1.0).alias("confidence"))
    ticker = entities.where("ticker IS NOT NULL AND ticker != ''").select("entity_id", F.col("ticker").alias("alias"), F.lit(0.99).alias("confidence"))
    short = entities.join(abbreviations, F.lower("name") == F.lower("long_name")).select("entity_id", F.col("short_name").alias("alias"), F.lit(0.95).alias("confidence"))
    return own.unionByName(ticker).unionByName(short).groupBy("entity_id", "alias").agg(F.max("confidence").alias("confidence"))


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def signal_edges(signals: DataFrame, universe: DataFrame, as_of: str) -> DataFrame:
    """Edges from a series node to the companies of the sector it is configured for; dated with as_of, so that gates keep them."""
    both = signals.withColumn("_s", normal_name(F.col("sector"))).join(universe.select("company", normal_name(F.col("sector")).alias("_s")), "_s")
    src, dst = entity_id(F.lit("MacroIndicator"), F.col("series")), entity_id(F.lit("Company"), F.col("company"))
    return both.select(src.alias("src"), dst.alias("dst"), edge_id(src, dst, F.lit("sensitive_to")).alias("edge_id"), "trend", F.lit(as_of).cast("date").alias("first_seen"))


def leftover_group(themes: DataFrame, mapping: DataFrame, name: str = "Other narratives") -> DataFrame:
    """Each theme under its first main theme; those without one under a group of their own."""
    first = mapping.groupBy("theme").agg(F.min("main_theme").alias("main_theme"))
    return themes.select("theme").distinct().join(first, "theme", "left").select("theme", F.coalesce("main_theme", F.lit(name)).alias("main_theme"))


def best_per(rows: DataFrame, key: str, score: str, tie: list[str]) -> DataFrame:
    """The row of the highest score for each key, ties in the order of ``tie``."""
    order = Window.partitionBy(key).orderBy(F.desc(score), *tie)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def match_by_overlap(final: DataFrame, monthly: DataFrame) -> DataFrame:
    """For each final theme and month the community with most members in common, then the largest. Columns theme, member; month, community, member."""
    size = monthly.groupBy("month", "community").agg(F.count("*").alias("size"))
    both = final.join(monthly, "member").groupBy("theme", "month", "community").agg(F.count("*").alias("overlap")).join(size, ["month", "community"])
    order = Window.partitionBy("theme", "month").orderBy(F.desc("overlap"), F.desc("size"), "community")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("theme", "month", "community", "overlap", "size")


def revivals(families: DataFrame, members: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of families where the later begins after a gap and its members are alike: (family, revived, jaccard)."""
    size = members.groupBy("family").agg(F.count("*").alias("n"))
    common = members.alias("a").join(members.select("member", F.col("family").alias("revived")).alias("b"), "member").where("family != revived").groupBy("family", "revived").agg(F.count("*").alias("both"))
    life = families.join(size, "family")
    late = life.select(F.col("family").alias("revived"), F.col("first").alias("_first"), F.col("n").alias("m"))
    j = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    return common.join(life, "family").join(late, "revived").where((F.col("_first") > F.col("last") + 1) & (j >= least)).select("family", "revived", F.round(j, 6).alias("jaccard"))


def readings(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first readings of each company: conflicts, then hedged ones, then the newest."""
    order = F.when(F.col("agreement") == "conflict", 0).when(F.col("agreement") == "hedged", 1).otherwise(2)
    w = Window.partitionBy(key).orderBy(order, F.desc("available_at"), "doc_id")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def company_profile(exposure: DataFrame, facts: DataFrame, n_themes: int = 3) -> DataFrame:
    """Top themes of each company in order, with the number and last day of its facts."""
    w = Window.partitionBy("company_id").orderBy(F.desc("exposure"), "theme")
    top = exposure.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n_themes).groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "theme"))), lambda x: x["theme"]), " + ").alias("themes"))
    s = facts.groupBy("company_id").agg(F.count("*").alias("n_facts"), F.max("day").alias("latest"))
    return top.join(s, "company_id", "left")


def report(title: str, baskets: DataFrame, most: int = 20) -> str:
    """Markdown of the largest excess returns; a short table, put together on the driver."""
    lines = [f"# {title}", "", "| theme | companies | basket | universe | excess |", "|---|---|---|---|---|"]
    for r in baskets.orderBy(F.desc("excess"), "theme").limit(most).collect():
        lines.append(f"| {r['theme']} | {r['n']} | {r['basket_ret']:.4f} | {r['universe_ret']:.4f} | {r['excess']:.4f} |")
    return "\n".join([*lines, "", "Illustrative; one point is no evidence of skill.", ""])
