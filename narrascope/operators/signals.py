"""Signals from released series: trend and regime at a day, and the nodes and edges that configured sensitivities make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions.ids import stable_id
from narrascope.operators.graph import STRUCTURAL
from narrascope.operators.serving import normal_name

LAG_DAYS, BACK_DAYS, WINDOW_DAYS, BAND, BAND_AT_ZERO = 35, 80, 365, 0.01, 0.001
KEPT_TYPES = ("Company", "Sector", "Commodity", "MacroIndicator", "EconomicConcept", "Event", "Geography")


def threshold_regime(value: Column, thresholds: Column, labels: Column) -> Column:
    """The label of the first threshold that the value does not exceed; the last label beyond all."""
    at = F.array_position(F.transform(thresholds, lambda t: value > t), F.lit(False))
    i = F.when(at == 0, F.size(thresholds)).otherwise(at - 1).cast("int")
    return F.coalesce(F.get(labels, i), F.get(labels, F.size(labels) - 1))


def pit_signals(series: DataFrame, specs: DataFrame, as_of: str, back_days: int = BACK_DAYS) -> DataFrame:
    """One row a series with an observation released by ``as_of``: obs_date, value, prior, trend, pct_change, regime.

    ``series``: series_id, obs_date, value; ``specs`` (the configuration): series_id, lag_days, mode (threshold, zscore
    or null), thresholds, labels, window_days. Prior is the latest value at least ``back_days`` before, or the value
    itself. A z-score under two observations, or without spread, is normal.
    """
    end = F.lit(as_of).cast("date")
    known = series.where("value IS NOT NULL").join(F.broadcast(specs), "series_id").where(F.col("obs_date") <= F.date_sub(end, F.coalesce("lag_days", F.lit(LAG_DAYS)).cast("int")))
    now = known.groupBy("series_id").agg(F.max(F.struct("obs_date", "value")).alias("now"))
    both = known.join(F.broadcast(now), "series_id")  # a row for each series of the configuration
    in_window = F.col("obs_date") > F.date_sub(F.col("now.obs_date"), F.coalesce("window_days", F.lit(WINDOW_DAYS)).cast("int"))
    inside = F.when(in_window, F.col("value"))
    s = both.groupBy("series_id").agg(F.max(F.when(F.col("obs_date") <= F.date_sub(F.col("now.obs_date"), back_days), F.struct("obs_date", "value"))).alias("before"), F.avg(inside).alias("mean"), F.stddev_pop(inside).alias("sd"), F.count(inside).alias("n"))
    rows = now.join(s, "series_id").join(F.broadcast(specs), "series_id").select("series_id", F.col("now.obs_date").alias("obs_date"), F.col("now.value").alias("value"), F.coalesce("before.value", "now.value").alias("prior"), "mean", "sd", "n", "mode", "thresholds", "labels")
    change, band = F.col("value") - F.col("prior"), F.when(F.col("prior") == 0, BAND_AT_ZERO).otherwise(F.abs("prior") * BAND)
    trend = F.when(change > band, "rising").when(change < -band, "falling").otherwise("flat")
    z = (F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    score = F.when((F.col("n") < 2) | z.isNull(), "normal").when(z > 1, "elevated").when(z < -1, "depressed").otherwise("normal")
    regime = F.when(F.col("mode") == "threshold", threshold_regime(F.col("value"), F.col("thresholds"), F.col("labels"))).when(F.col("mode") == "zscore", score)
    pct = F.when(F.col("prior") != 0, change / F.nullif("prior", F.lit(0.0)) * 100.0).otherwise(0.0)
    return rows.select("series_id", "obs_date", "value", "prior", trend.alias("trend"), pct.alias("pct_change"), regime.alias("regime"))


def shown(value: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")


def integrate(signals: DataFrame, sources: DataFrame, sensitivities: DataFrame, companies: DataFrame, universe: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """nodes, edges and explanations of the signals.

    ``sources``: series_id, label, node_type, unit, confidence; types that the graph does not keep are skipped.
    ``sensitivities``: series_id, edge_type, sector, companies, when_trend, when_regime, rationale; they fire when trend
    and regime are those they name (null: any), for the companies named and all of the sector. An edge type that is not
    structural is an error, since its edges would be lost in silence. ``companies``: entity_id, name; ``universe``:
    name, sector. Without a signal there is no node.
    """
    bad = [r[0] for r in sensitivities.where(~F.col("edge_type").isin(*STRUCTURAL)).select("edge_type").distinct().collect()]  # the configuration
    if bad:
        raise ValueError(f"not structural: {', '.join(sorted(bad))}")
    day = F.lit(as_of).cast("date")
    live = sources.where(F.col("node_type").isin(*KEPT_TYPES)).join(signals, "series_id")
    live = live.withColumn("entity_id", stable_id("ent_alt_", F.concat_ws("|", "node_type", "label"), 12))
    fires = (F.col("when_trend").isNull() | (F.col("when_trend") == F.col("trend"))) & (F.col("when_regime").isNull() | (F.col("when_regime") == F.col("regime")))
    active = live.join(sensitivities, "series_id").where(fires)
    named = active.select("*", F.explode("companies").alias("_n")).withColumn("_n", normal_name(F.col("_n")))
    of_sector = active.join(universe.select("sector", normal_name(F.col("name")).alias("_n")), "sector")
    columns = ["entity_id", "series_id", "label", "unit", "value", "trend", "regime", "obs_date", "edge_type", "confidence", "rationale", "_n"]
    targets = named.select(*columns).unionByName(of_sector.select(*columns)).distinct()
    known = companies.groupBy(normal_name(F.col("name")).alias("_n")).agg(F.max("entity_id").alias("dst"))
    both = targets.join(known, "_n")
    edges = both.select(stable_id("edge_alt_", F.concat("entity_id", "dst", "edge_type"), 12).alias("edge_id"), F.col("entity_id").alias("src"), "dst", "edge_type", F.coalesce("confidence", F.lit(0.6)).alias("confidence"), F.lit("metadata_inferred").alias("method"), F.lit(0).alias("direction"), day.alias("first_seen"), F.array().cast("array<string>").alias("evidence"), "label", "unit", "value", "trend", "regime", "obs_date", "rationale", "series_id")
    unit = F.when(F.coalesce("unit", F.lit("")).isin("index", ""), "").otherwise(F.col("unit"))
    mood = F.coalesce(F.concat(F.lit(", regime="), "regime"), F.lit(""))
    said = F.concat("label", F.lit(" = "), shown(F.col("value")), unit, F.lit(" ("), "trend", F.lit(" vs ~3mo prior"), mood, F.lit(", as of "), F.col("obs_date").cast("string"), F.lit("); "), F.coalesce("rationale", F.lit("")), F.lit(". Source: "), "series_id", F.lit(f" (point-in-time, vintage {as_of})."))
    nodes = live.select("entity_id", F.col("node_type").alias("entity_type"), F.col("label").alias("name"), day.alias("first_seen"), F.array().cast("array<string>").alias("source_chunk_ids")).distinct()
    return {"nodes": nodes, "edges": edges.drop("label", "unit", "value", "trend", "regime", "obs_date", "rationale", "series_id").distinct(), "explanations": edges.select("edge_id", said.alias("explanation")).distinct()}
