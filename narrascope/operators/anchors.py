"""Finding nodes by a part of their label: an index of letter sequences, so that only likely labels are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import runtime

#: Letters of an index entry.
GRAM = 3
#: Parts over which the labels of a frequent sequence are dealt.
DEAL = 16


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` letters."""
    many = F.greatest(F.lit(0), F.length(text) - size + 1)
    return F.array_distinct(F.transform(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size))))


def label_index(nodes: DataFrame) -> DataFrame:
    """Staged (gram, node_id, low, deal) of all labels in lower case: runs of one to three letters."""
    low = F.lower("label")
    rows = nodes.where("label IS NOT NULL").select("node_id", low.alias("low"))
    runs = F.concat(*[_grams(F.col("low"), k) for k in range(1, GRAM + 1)])
    deal = F.pmod(F.xxhash64("node_id"), F.lit(DEAL)).cast("int")
    return runtime.staged(rows.select(F.explode(runs).alias("gram"), "node_id", "low", deal.alias("deal")), "label-index")


def containing(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(wanted, node_id) of all labels that contain a wanted text, in any case; an empty text is in none.

    Each text is looked up by the rarest of its runs of three letters (or by itself if it is shorter), which is then
    compared in full. The labels of a run are dealt over several places, to each of which a text goes.
    """
    texts = wanted.select("wanted").distinct().withColumn("_w", F.lower("wanted"))
    runs = F.when(F.length("_w") < GRAM, F.when(F.length("_w") > 0, F.array("_w"))).otherwise(_grams(F.col("_w"), GRAM))
    asked = texts.select("wanted", "_w", F.explode(runs).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("times"))
    rarest = asked.join(often, "gram", "left").groupBy("wanted", "_w").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram")).alias("r"))
    keyed = rarest.where("r.times > 0").select("wanted", "_w", F.col("r.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("deal"))
    return keyed.join(index, ["gram", "deal"]).where(F.col("low").contains(F.col("_w"))).select("wanted", "node_id")


def candidates(wanted: DataFrame, index: DataFrame, most: int = 10) -> DataFrame:
    """(wanted, n, node_ids): how many labels contain a text, and the first ``most`` of them in order of id."""
    # the smallest ids are kept part by part before they meet
    found = containing(wanted, index).withColumn("_deal", F.pmod(F.xxhash64("node_id"), F.lit(DEAL)))
    first = lambda c: F.slice(F.array_sort(c), 1, most)
    parts = found.groupBy("wanted", "_deal").agg(F.count("*").alias("n"), first(F.collect_set("node_id")).alias("ids"))
    return parts.groupBy("wanted").agg(F.sum("n").alias("n"), first(F.flatten(F.collect_list("ids"))).alias("node_ids"))


def resolve(nodes: DataFrame, wanted: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(wanted, node_id, how): by id, else by label in any case, else by a part of the label if only one fits."""
    w = wanted.withColumn("_w", F.lower("wanted"))
    by_id = w.join(nodes, F.col("wanted") == F.col("node_id")).select("wanted", "node_id", F.lit(1).alias("rank"))
    by_label = w.join(nodes, F.col("_w") == F.lower("label")).select("wanted", "node_id", F.lit(2).alias("rank"))
    part = containing(wanted, index if index is not None else label_index(nodes)).groupBy("wanted").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n")).where("n = 1").select("wanted", "node_id", F.lit(3).alias("rank"))
    found = by_id.unionByName(by_label).unionByName(part).groupBy("wanted").agg(F.min(F.struct("rank", "node_id")).alias("f"))
    how = F.element_at(F.array(F.lit("id"), F.lit("label"), F.lit("part")), F.col("f.rank"))
    return wanted.join(found, "wanted", "left").select("wanted", F.col("f.node_id").alias("node_id"), F.coalesce(F.when(F.col("f").isNotNull(), how), F.lit("none")).alias("how"))
