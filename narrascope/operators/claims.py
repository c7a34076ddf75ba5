"""Quantified claims in text: amounts, percentages, earnings per share, their periods and roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.operators.evidence import reconcile_claims
from narrascope.operators.pit import known_at

#: Patterns of claims by named metric, units, directions, and forward-looking words.
MONEY = r"(?i)(revenue|net income|eps|operating margin|ebitda margin|gross margin|operating cash flow|total debt)[^.]*?(?:(rose|grew|increased|fell|declined|decreased|was|came in at|reached|stood at|of)[^$\d]*?)?\$\s*(\d+(?:\.\d+)?)\s*(billion|million|bn|m\b)"
SHARE = r"(?i)(gross margin|operating margin|ebitda margin)[^.]*?(?:(was|of|is expected to be approximately)\s*)?(\d+(?:\.\d+)?)%[^.]*?(?:for|in)\s+([A-Z][A-Z0-9 ]+\d{4})"
PER_SHARE = r"(?i)eps[^.]*?(?:(came in at|of|to|was)\s*)?\$\s*(\d+(?:\.\d+)?)[^.]*?(?:for|in)\s+([A-Z][A-Z0-9 ]+\d{4})"
PERIOD_IN_TEXT = r"(?i)\b(Q[1-4]\s+\d{4}|FY\s+\d{4}|H[12]\s+\d{4})\b"
PERIOD = r"(?i)\b(Q[1-4]|H[12]|FY)\s*(?:of\s+)?(\d{4})\b"
GUIDANCE_SIGNALS = "guidance guide guides expect expects expected raise raises raised raising outlook forecast projected".split()
RISING, FALLING = ("rose", "grew", "increased"), ("fell", "declined", "decreased")


def period_end(period: Column) -> Column:
    """Q2 2024, H1 2024, FY2024 to the day the period ends on."""
    part, year = F.upper(F.regexp_extract(period, PERIOD, 1)), F.regexp_extract(period, PERIOD, 2)
    month = F.when(part.startswith("Q"), F.expr("NULL").cast("int"))
    month = F.when(part == "Q1", 3).when(part.isin("Q2", "H1"), 6).when(part == "Q3", 9).when(part.isin("Q4", "H2", "FY"), 12)
    return F.when(month.isNotNull(), F.last_day(F.make_date(year.cast("int"), month, F.lit(1))))


def sentences_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u001f"), "\u001f")


def find_claims(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Claims of a chunk by named metric: chunk_id, company, metric, value, unit, period, direction, is_guidance, confidence, at.

    A sentence gives amounts in dollars, margins in percent and earnings per share; equal claims of a chunk are one, the
    first of them. ``at`` is the place of a claim among those of its chunk.
    """
    low = F.lower("s")
    guided = F.lit(False)
    for word in GUIDANCE_SIGNALS:
        guided = guided | low.contains(word)
    said = F.replace(F.upper(F.regexp_extract("s", PERIOD_IN_TEXT, 1)), F.lit("  "), F.lit(" "))
    rows = chunks.select("chunk_id", "company", F.posexplode(sentences_of(F.col(text))).alias("n", "s")).withColumn("is_guidance", guided).withColumn("said", said)
    groups = lambda pattern, *ks: F.arrays_zip(*[F.regexp_extract_all("s", F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in ks])
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    metric = F.replace(F.lower(F.trim("m.g1")), F.lit(" "), F.lit("_"))
    unit = F.when(F.lower("m.g4").isin("billion", "bn"), "USD_billions").otherwise("USD_millions")
    way = F.when(F.lower("m.g2").isin(*RISING), "rose").when(F.lower("m.g2").isin(*FALLING), "fell").otherwise("")
    keep = ["chunk_id", "company", "n", "is_guidance", "said"]
    money = rows.select(*keep, F.posexplode(groups(MONEY, 1, 2, 3, 4)).alias("k", "m")).select(*keep, F.lit(0).alias("kind"), "k", metric.alias("metric"), number("m.g3").alias("value"), unit.alias("unit"), F.col("said").alias("period"), way.alias("direction"), F.lit(0.75).alias("confidence"))
    share = rows.select(*keep, F.posexplode(groups(SHARE, 1, 3, 4)).alias("k", "m")).select(*keep, F.lit(1).alias("kind"), "k", metric.alias("metric"), number("m.g3").alias("value"), F.lit("percent").alias("unit"), F.upper(F.trim("m.g4")).alias("period"), F.lit("").alias("direction"), F.lit(0.70).alias("confidence"))
    each = rows.select(*keep, F.posexplode(groups(PER_SHARE, 2, 3)).alias("k", "m")).select(*keep, F.lit(2).alias("kind"), "k", F.lit("eps").alias("metric"), number("m.g2").alias("value"), F.lit("USD_per_share").alias("unit"), F.upper(F.trim("m.g3")).alias("period"), F.lit("").alias("direction"), F.lit(0.75).alias("confidence"))
    out = money.unionByName(share).unionByName(each).where("value IS NOT NULL")
    same = ["chunk_id", "company", "metric", "value", "unit", "period", "is_guidance"]
    first = out.groupBy(*same).agg(F.min(F.struct("n", "kind", "k", "direction", "confidence")).alias("f"))
    return first.select("chunk_id", "company", "metric", "value", "unit", "period", "f.direction", "is_guidance", "f.confidence", F.struct("f.n", "f.kind", "f.k").alias("at"))


def roll_up(claims: DataFrame) -> DataFrame:
    """One claim for each (company, metric, period, guidance): the most confident, the first of equals, with all its chunks."""
    keys = ["company", "metric", "period", "is_guidance"]
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "chunk_id", "at", "value", "unit", "direction")).alias("b")
    by = claims.groupBy(*keys).agg(best, F.array_sort(F.collect_set("chunk_id")).alias("chunks"))
    return by.select(*keys, F.col("b.value").alias("value"), F.col("b.unit").alias("unit"), F.col("b.direction").alias("direction"), (-F.col("b.c")).alias("confidence"), "chunks")


class RuleFactExtractor:
    """Fact extractor by rules; another one offers ``extract_facts`` with the same columns."""

    def extract_facts(self, chunks: DataFrame) -> DataFrame:
        return find_claims(chunks)


def run_facts(chunks: DataFrame, facts: DataFrame, as_of: str, extractor: RuleFactExtractor | None = None) -> DataFrame:
    """Claims of the chunks known at ``as_of``, rolled up; those that a reported fact (company, period_end, metric) answers go.

    Guidance always stays. ``chunks``: chunk_id, company, available_at, text; undated chunks are left out.
    """
    live = chunks.where(known_at(F.col("available_at"), as_of))
    rolled = roll_up((extractor or RuleFactExtractor()).extract_facts(live)).withColumn("period_end", period_end(F.col("period")))
    return reconcile_claims(rolled, facts, ["company", "period_end", "metric"])


def fact_label(metric: Column, value: Column, period: Column) -> Column:
    shown = F.when(F.abs(value) >= 1e9, F.format_string("%.2f billion", value / 1e9)).when(F.abs(value) >= 1e6, F.format_string("%.2f million", value / 1e6)).otherwise(F.format_string("%.2f", value))
    return F.concat_ws(" ", metric, shown, F.when(period.isNotNull(), F.concat(F.lit("("), period.cast("string"), F.lit(")"))))


def carry_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, n, line) with ``section``: the last heading at or before a line."""
    heading = F.when(F.col("line").rlike(r"^(?i:item\s+\d+[a-z]?\.)|^[A-Z][A-Z&\s]{4,}$|^\[\[\[SECTION_TITLE:"), F.col("line"))
    order = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(order))
