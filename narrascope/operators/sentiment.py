"""Sentiment of management by rules: stems with a negation window, hedges, stance; as columns, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.operators.extraction import ALIASES, ENTITY_RULES
from narrascope.operators.pit import known_at
from narrascope.operators.textops import fuse

#: Stems of both sides, negations, hedges and forward-looking words.
POSITIVE = r"\b(?:strong\w*|exceed\w*|record\w*|outstanding|robust|grow\w*|confident\w*|momentum|positive|beat\w*|outperform\w*|increas\w*|expand\w*|improv\w*|accelerat\w*|opportunit\w*|well-positioned|ahead of)"
NEGATIVE = r"\b(?:challeng\w*|difficult\w*|disappoint\w*|weaker|declin\w*|pressur\w*|headwind\w*|miss\w*|shortfall\w*|concern\w*|uncertain\w*|risk\w*|advers\w*|deteriorat\w*|slowdown\w*|reduc\w*|contract\w*|below expectation)"
NEGATION = r"(?i)^(not|no|never|neither|nor|cannot|can't|don't|doesn't|didn't|won't|wouldn't|shouldn't|isn't|aren't|wasn't|weren't|hardly|barely|scarcely)\b"
HEDGE = r"(?i)\b(may|might|could|would|should|if|subject to|provided|assuming|uncertain|depend|contingent|potential|possible|expect|anticipate|approximate|guidance|outlook|forecast)\b"
OPTIMISTIC = r"(?i)\b(expect|confident|look forward|well-positioned|growth|opportunity|momentum|accelerat|positive|bright|strong outlook|optimistic)\b"
CAUTIOUS = r"(?i)\b(cautious|monitor|uncertain|headwind|challenge|risk|volatile|depend on|subject to|if market|macro|may impact)\b"
GLOOMY = r"(?i)\b(decline|deteriorat|miss|below expectation|pressure|slowdown|concern|weak|adverse|reduce guidance|lower)\b"
NEGATION_TOKENS = 5

UP, DOWN = "\x01", "\x02"


def signals(text: Column) -> Column:
    """struct(up, down): stems of both sides; one with a negation among the five tokens before it counts for the other side.

    Stems are marked in the text; of a stem inside a token (after a hyphen) what stands before it is a token of its own.
    """
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"[{UP}{DOWN}]", " "), f"(?i){POSITIVE}", f"{UP}$0"), f"(?i){NEGATIVE}", f"{DOWN}$0")
    tokens = F.split(F.trim(F.regexp_replace(marked, r"\s+", " ")), " ")

    def of_token(all_tokens: Column, token: Column, i: Column) -> Column:
        """Signs of the stems in one token."""
        parts = F.split(token, f"(?=[{UP}{DOWN}])")  # what stands before the first mark, then a part for each mark
        before = lambda n: F.slice(all_tokens, F.greatest(F.lit(1), i + 1 - n), F.least(i, F.lit(n)))
        negated = lambda n: F.exists(before(n), lambda t: F.translate(t, UP + DOWN, "").rlike(NEGATION))

        def sign(part: Column, k: Column) -> Column:
            lead = F.translate(F.array_join(F.slice(parts, 1, k), ""), UP + DOWN, "")
            turned = F.when(lead == "", negated(NEGATION_TOKENS)).otherwise(lead.rlike(NEGATION) | negated(NEGATION_TOKENS - 1))
            return F.when(part.startswith(UP) != turned, 1).otherwise(-1)

        marks = F.filter(F.transform(parts, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda x: x["p"].rlike(f"^[{UP}{DOWN}]"))
        return F.transform(marks, lambda x: sign(x["p"], x["k"]))

    def counted(all_tokens: Column) -> Column:
        at = F.filter(F.transform(all_tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].rlike(f"[{UP}{DOWN}]"))
        signs = F.flatten(F.transform(at, lambda x: of_token(all_tokens, x["t"], x["i"])))
        return F.transform(F.array(signs), lambda s: F.struct(F.size(F.filter(s, lambda v: v > 0)).alias("up"), F.size(F.filter(s, lambda v: v < 0)).alias("down")))[0]

    return F.transform(F.array(tokens), counted)[0]


def company_in(text: Column) -> Column:
    """The company that a text is about: by its other names first, then by the entity rules; null where there is none."""
    out = F.lit(None).cast("string")
    for kind, name, pattern in reversed(ENTITY_RULES):
        if kind == "Company":
            out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    for short, name in reversed(ALIASES.items()):
        out = F.when(F.lower(text).contains(short), name).otherwise(out)
    return out


def score_sentiment(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with direction, confidence_tone, hedging, forward_stance and confidence of their text. A null text is empty."""
    said = F.coalesce(F.col(text), F.lit(""))
    out = rows.withColumn("_s", signals(said))
    up, down = F.col("_s.up"), F.col("_s.down")
    total = up + down
    glad, wary, gloomy = said.rlike(OPTIMISTIC), said.rlike(CAUTIOUS), said.rlike(GLOOMY)
    return out.select(
        *rows.columns,
        F.when(up > down, "positive").when(down > up, "negative").when(up > 0, "mixed").otherwise("neutral").alias("direction"),
        F.when(total >= 4, "high").when(total >= 2, "moderate").otherwise("low").alias("confidence_tone"),
        said.rlike(HEDGE).alias("hedging"),
        F.when(gloomy & ~glad, "negative").when(wary & ~glad, "cautious").when(glad & ~wary & ~gloomy, "optimistic").otherwise("neutral").alias("forward_stance"),
        F.when(total > 0, F.least(0.6 + total * 0.05, F.lit(0.9))).otherwise(0.5).alias("confidence"),
    )


class RuleSentimentExtractor:
    """Sentiment extractor by rules; another one offers ``extract_sentiment`` with the same columns."""

    def extract_sentiment(self, chunks: DataFrame) -> DataFrame:
        """chunk_id, company and the sentiment of each chunk that names a company."""
        return score_sentiment(chunks.withColumn("company", company_in(F.col("text"))).where("company IS NOT NULL")).drop("text")


#: Whose words a document or a section holds; the first rule that fits counts. Types and section words are parts of the name, in any case.
ATTRIBUTION = (
    ("management", ("10-k", "10-q", "40-f", "20-f", "annual report", "annual_report", "earnings_transcript", "earnings transcript", "mda"),
     ("management", "md&a", "management's discussion", "managements discussion", "discussion and analysis", "ceo", "chief executive", "outlook", "forward-looking")),
    ("media", ("news", "news_article", "press_release", "press release", "newswire"), ()),
    ("analyst", ("analyst_report", "analyst report", "research", "research_report", "sell-side", "sellside"), ()),
)


def speaker_role(document_type: Column, section_title: Column, rules=ATTRIBUTION) -> Column:
    """Whose words a chunk holds, by the type of its document or the title of its section; ``unknown`` where no rule fits.

    ``rules``: (role, parts of types, parts of titles), as a configuration gives them; a rule without parts never fits.
    """
    kind, section = F.lower(F.coalesce(document_type, F.lit(""))), F.lower(F.coalesce(section_title, F.lit("")))
    out = F.lit("unknown")
    for role, types, titles in reversed(rules):
        fits = F.lit(False)
        for c, words in ((kind, types), (section, titles)):
            for w in filter(None, words):
                fits = fits | c.contains(w.lower())
        out = F.when(fits, role or "unknown").otherwise(out)
    return out


def attribution_rules(found: dict) -> tuple:
    """Rules of a parsed configuration: its ``attribution`` list, or the fixed ones without such a list."""
    listed = found.get("attribution")
    return tuple((r.get("role") or "unknown", tuple(r.get("document_types") or ()), tuple(r.get("section_keywords") or ())) for r in listed) if listed is not None else ATTRIBUTION


def run_sentiment(chunks: DataFrame, as_of: str, extractor: RuleSentimentExtractor | None = None) -> DataFrame:
    """One reading for each (company, chunk) of what management said until ``as_of``; undated chunks are left out.

    ``chunks``: chunk_id, available_at, text, speaker_role (see ``speaker_role``; null, for chunks that nothing is known of: taken
    as management).
    """
    live = chunks.where(known_at(F.col("available_at"), as_of) & (F.coalesce("speaker_role", F.lit("management")) == "management") & (F.coalesce("text", F.lit("")) != ""))
    made = (extractor or RuleSentimentExtractor()).extract_sentiment(live.select("chunk_id", "available_at", "text"))
    order = Window.partitionBy(F.lower("company"), "chunk_id").orderBy("direction", "confidence", "company")
    return made.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fuse_with_tone(sentiment: DataFrame, tone: DataFrame, as_of: str) -> DataFrame:
    """Readings joined with the lexicon's tone of their chunk. A reading without one stays, undated and with zero shares.

    ``tone``: chunk_id, available_at, positive, negative, uncertainty; of a dated row only one known at ``as_of`` counts,
    and its readings go otherwise.
    """
    t = tone.select("chunk_id", F.col("available_at").alias("tone_day"), "positive", "negative", "uncertainty", F.lit(True).alias("_toned"))
    both = sentiment.drop("available_at").join(t, "chunk_id", "left")
    kept = both.where(F.col("_toned").isNull() | known_at(F.col("tone_day"), as_of))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    base = kept.select(*[c for c in kept.columns if c not in ("positive", "negative", "uncertainty", "_toned")], zero("positive"), zero("negative"), zero("uncertainty"))
    return fuse(base)


def sentiment_panel(fused: DataFrame, as_of: str) -> DataFrame:
    """Readings with a day known at ``as_of``: those that were fused without a tone row are never shown."""
    return fused.where(known_at(F.col("tone_day"), as_of))
