"""Rule extraction, rollups, aliases, provenance and integrity over chunks, entities and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.ids import entity_id


def match_rules(chunks: DataFrame, rules: list[tuple[str, str, str]], text: str = "text") -> DataFrame:
    """(chunk_id, entity_type, name) for each rule (type, name, regex) that the text has; once a chunk and name."""
    hits = F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(t).alias("entity_type"), F.lit(n).alias("name"))) for t, n, p in rules])
    return chunks.select("chunk_id", "available_at", F.explode(F.array_distinct(F.array_compact(hits))).alias("e")).select("chunk_id", "available_at", "e.*")


def cooccurrences(mentions: DataFrame) -> DataFrame:
    """Pairs of entities of different types in one chunk: (name_a, name_b, n_chunks), by name order."""
    names = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("name", "entity_type"))).alias("es"))
    left = names.select("chunk_id", F.posexplode("es").alias("i", "a"), "es")
    pairs = left.select("chunk_id", "a", F.explode(F.slice("es", F.col("i") + 2, F.greatest(F.size("es"), F.lit(1)))).alias("b")).where("a.entity_type != b.entity_type")
    return pairs.groupBy(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).agg(F.count("*").alias("n_chunks"))


def rollup_entities(mentions: DataFrame) -> DataFrame:
    """Entities by type and small-letter name: id, earliest day, number of distinct chunks."""
    s = mentions.groupBy("entity_type", F.lower("name").alias("name")).agg(F.min("available_at").alias("first_seen"), F.countDistinct("chunk_id").alias("n_chunks"))
    return s.select(entity_id(F.col("entity_type"), F.col("name")).alias("entity_id"), "entity_type", "name", "first_seen", "n_chunks")


def join_evidence(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with the chunks in their evidence lists: an explode and a hash join in place of a search in lists."""
    return edges.select("edge_id", F.explode("evidence").alias("chunk_id")).join(chunks, "chunk_id")


def alias_groups(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other name of the group that an entity's name is in: (entity_id, alias). ``groups``: group_id, name."""
    own = entities.select("entity_id", F.lower("name").alias("name")).join(groups.select("group_id", F.lower("name").alias("name")), "name")
    return own.join(groups.select("group_id", F.col("name").alias("alias")), "group_id").where(F.lower("alias") != F.col("name")).select("entity_id", "alias").distinct()


def remap(edges: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Endpoints replaced by their representatives; loops go, and of equal edges one stays with the highest weight."""
    s = synonyms.select(F.col("member").alias("src"), F.col("representative").alias("_s"))
    t = synonyms.select(F.col("member").alias("dst"), F.col("representative").alias("_t"))
    mapped = edges.join(s, "src", "left").join(t, "dst", "left").select(F.coalesce("_s", "src").alias("src"), F.coalesce("_t", "dst").alias("dst"), "weight")
    return mapped.where("src != dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def reconcile_claims(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Claims that no reported fact answers; guidance always stays."""
    free = claims.where("not is_guidance").join(facts.select(*keys).distinct(), keys, "left_anti")
    return free.unionByName(claims.where("is_guidance"))


def orphans(child: DataFrame, parent: DataFrame, key: str, check: str) -> DataFrame:
    """Violations of one reference: (check, key)."""
    return child.join(parent.select(key).distinct(), key, "left_anti").select(F.lit(check).alias("check_name"), F.col(key).cast("string").alias("key")).distinct()


def quarantine(docs: DataFrame, as_of: str, content: str = "text") -> DataFrame:
    """doc_id, outcome: ordered gates (missing_metadata, future_document), then duplicates of the first equal text among those left."""
    from pyspark.sql import Window

    gate = F.when(F.col("source").isNull() | F.col("available_at").isNull(), "missing_metadata").when(F.col("available_at") > F.lit(as_of).cast("date"), "future_document")
    rows = docs.withColumn("_gate", gate).withColumn("_hash", F.sha2(F.col(content), 256))
    order = Window.partitionBy(F.col("_gate").isNull(), "_hash").orderBy("doc_id")
    return rows.withColumn("_n", F.row_number().over(order)).select("doc_id", F.coalesce("_gate", F.when(F.col("_n") > 1, "duplicate"), F.lit("included")).alias("outcome"))


def table_digest(df: DataFrame) -> DataFrame:
    """A digest of a table's rows that doesn't depend on their order or on files: one row (n_rows, digest, mix).

    Two sums, which repeated rows don't cancel, over the first and the next 60 bits of the sha256 of each row; a row is
    its values as text in order of the column names.
    """
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    rows = df.select(F.sha2(F.concat_ws("\x1f", *values), 256).alias("h"))
    lane = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(lane(1), F.lit("0")).alias("digest"), F.coalesce(lane(16), F.lit("0")).alias("mix"))
