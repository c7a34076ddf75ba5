"""Rule extraction over chunks: entities, signed edges, their roll-ups with evidence, and the plug-in surface."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.functions.ids import edge_id, entity_id

#: Entity rules of the contract as (type, canonical name, pattern in any case).
ENTITY_RULES = (
    ("Company", "Acme Corp", r"\bacme\s+corp\b"),
    ("Company", "Beta Industries", r"\bbeta industries\b"),
    ("Company", "Hydro One", r"\bhydro one\b"),
    ("Company", "Cameco", r"\bcameco\b"),
    ("Company", "RBC", r"\brbc\b"),
    ("Commodity", "Uranium", r"\buranium\b"),
    ("Commodity", "Copper", r"\bcopper\b"),
    ("Commodity", "Oil", r"\boil\b"),
    ("Commodity", "Aluminum", r"\baluminum\b|\baluminium\b"),
    ("EconomicConcept", "Datacenter Power Demand", r"\bdatacenter\s+power\s+demand\b|\bpowder demand\b"),
    ("EconomicConcept", "Datacenter", r"\bdatacenter\b|\bdata\s+center\b"),
    ("EconomicConcept", "Electricity Demand", r"\belectricity\s+demand\b"),
    ("EconomicConcept", "Grid Infrastructure", r"\bgrid\s+infrastructure\b"),
    ("EconomicConcept", "Renewable Energy", r"\brenewable\s+energy\b"),
    ("EconomicConcept", "Supply Chain", r"\bsupply\s+chain\b"),
    ("EconomicConcept", "Capital Expenditure", r"\bcapital\s+expenditure\b|\bcapex\b"),
    ("EconomicConcept", "Transmission", r"\btransmission\b"),
    ("MacroIndicator", "Fed Funds Rate", r"\bfed\s+funds\s+rate\b|\bfederal\s+funds\s+rate\b"),
    ("MacroIndicator", "CPI", r"\bcpi\b"),
    ("MacroIndicator", "GDP", r"\bgdp\b"),
    ("MacroIndicator", "Interest Rate", r"\binterest\s+rate\b"),
    ("MacroIndicator", "Inflation", r"\binflation\b"),
    ("Event", "Rate Cut", r"\brate\s+cut\b"),
    ("Event", "Capex Increase", r"\bcapex\s+increase\b"),
    ("Event", "Production Outage", r"\bproduction\s+outage\b"),
    ("Event", "Earnings Call", r"\bearnings\s+call\b"),
    ("Geography", "Ontario", r"\bontario\b"),
    ("Geography", "Canada", r"\bcanada\b"),
    ("Geography", "Alberta", r"\balberta\b"),
    ("Geography", "North America", r"\bnorth america\b"),
)
#: Edge rules as (edge type, words that must stand in the text, target types, source type, confidence, signed).
TRIGGER_RULES = (
    ("exposed_to", ("exposed", "exposure"), ("Commodity", "EconomicConcept", "MacroIndicator"), "Company", 0.80, True),
    ("sensitive_to", ("sensitive", "sensitivity"), ("MacroIndicator",), "Company", 0.80, True),
    ("causes", ("cause",), ("Event",), "EconomicConcept", 0.75, True),
    ("benefits", ("benefit",), ("EconomicConcept", "Event"), "Company", 0.75, False),
    ("hurts", ("hurt", "pressured"), ("EconomicConcept", "Commodity", "MacroIndicator"), "Company", 0.75, False),
)
CO_OCCURS, CO_OCCURS_CONFIDENCE, ENTITY_CONFIDENCE = "co_occurs_with", 0.65, 0.85
#: Words that tell which way an edge works.
BENEFICIAL = r"(?i)\b(positively|beneficial|beneficially|tailwinds?|favorabl(?:e|y)|favourabl(?:e|y)|boost(?:s|ing)?|support(?:s|ing)?|help(?:s|ing)?|upside|strengthen(?:s|ing)?|advantageous)\b"
ADVERSE = r"(?i)\b(adversely|adverse|headwinds?|unfavorabl(?:e|y)|unfavourable|harm(?:s|ful|ing)?|pressure(?:s|d|ing)?|downside|negatively|negative|risk(?:s)?|damage(?:s|d|ing)?|detrimental|hurt(?:s|ing)?)\b"
#: Names that are no entities, corporate suffixes, and other names of companies.
NOISE_START = r"(?i)^\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|q[1-4]\b|\d{4}\b|\d{1,2}/\d{1,2})"
NOISE_PARTS = (
    "foreign private issuer", "annual meeting", "home country", "exchange act", "securities and exchange", "exchange commission", "registrant", "form 6-k",
    "form 40-f", "form 20-f", "press release", "board of directors", "fiscal year", "annual report", "quarterly report", "commission file", "rule 13a",
    "interim financial", "sedar", "edgar", "washington, d.c", "signature",
)
PERSON = r"^[A-Z][a-z]+(\s+[A-Z]\.?)*\s+[A-Z][a-z]+$"
SUFFIX = r"(?i)[\s,]+(inc|incorporated|ltd|limited|corp|corporation|company|co|plc|llc|lp)\.?\s*$"
ALIASES = {
    "su": "Suncor Energy", "suncor": "Suncor Energy", "enb": "Enbridge", "cnq": "Canadian Natural Resources", "canadian natural": "Canadian Natural Resources",
    "ry": "Royal Bank of Canada", "rbc": "Royal Bank of Canada", "royal bank": "Royal Bank of Canada", "bns": "Bank of Nova Scotia", "scotiabank": "Bank of Nova Scotia",
}


def direction_of(text: Column) -> Column:
    """1 or -1 where words of just one side stand in the text, else 0."""
    good, bad = text.rlike(BENEFICIAL), text.rlike(ADVERSE)
    return F.when(good & ~bad, 1).when(bad & ~good, -1).otherwise(0)


def collapsed(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def is_noise(name: Column) -> Column:
    """Under three characters, beginning like a date, or boilerplate of filings."""
    low = F.lower(name)
    parts = F.lit(False)
    for p in NOISE_PARTS:
        parts = parts | low.contains(p)
    return (F.length(F.trim(name)) < 3) | name.rlike(NOISE_START) | parts


def canonical_name(name: Column, entity_type: Column) -> Column:
    """White space collapsed; of a company its usual name, without its corporate suffix."""
    plain = collapsed(name)
    bare = F.trim(F.regexp_replace(plain, SUFFIX, ""))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    of = lambda c: F.try_element_at(known, F.lower(c))
    return F.when(entity_type == "Company", F.coalesce(of(bare), of(plain), F.when(bare != "", bare), plain)).otherwise(plain)


def clean_names(mentions: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Mentions (name, entity_type, ...) under canonical names; noise goes, and people's names that pass for companies.

    A company of the ``universe`` (name) or with a known other name is never taken for a person.
    """
    low = F.lower(F.trim("name"))
    person = (F.col("entity_type") == "Company") & F.trim("name").rlike(PERSON) & ~low.isin(*ALIASES)
    if universe is not None:
        known = universe.select(F.lower("name").alias("_low")).distinct().withColumn("_known", F.lit(True))
        mentions = mentions.withColumn("_low", low).join(known, "_low", "left").drop("_low")
        person = person & F.col("_known").isNull()
    kept = mentions.where(~is_noise(F.col("name")) & ~F.coalesce(person, F.lit(False))).drop("_known")
    kept = kept.withColumn("name", canonical_name(F.col("name"), F.col("entity_type")))
    return kept.where((F.col("name") != "") & ~is_noise(F.col("name")))


def find_entities(chunks: DataFrame, rules=ENTITY_RULES) -> DataFrame:
    """(chunk_id, available_at, text, found): entities of a chunk in the order of the rules, each once; empty where there are none."""
    hits = F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.struct(F.lit(t).alias("entity_type"), F.lit(n).alias("name"))) for t, n, p in rules])
    return chunks.select("chunk_id", "available_at", "text", F.array_compact(hits).alias("found"))


def mentions_of(found: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(chunk_id, available_at, entity_type, name), cleaned."""
    rows = found.select("chunk_id", "available_at", F.explode("found").alias("e")).select("chunk_id", "available_at", "e.*")
    return clean_names(rows, universe)


def _product(sources: Column, targets: Column, edge) -> Column:
    return F.flatten(F.transform(sources, lambda s: F.transform(targets, lambda t: edge(s, t))))


def edge_candidates(found: DataFrame, rules=TRIGGER_RULES) -> DataFrame:
    """(chunk_id, available_at, source, target, edge_type, confidence, direction) of every chunk.

    Entities of different types that stand in one chunk co-occur; trigger words make edges from each source to each
    target of fitting types. All pairs come from the few entities that the rules find in one chunk.
    """
    e = F.col("found")
    names = lambda types: F.transform(F.filter(e, lambda x: x["entity_type"].isin(*types)), lambda x: x["name"])
    edge = lambda s, t, kind, confidence, direction: F.struct(s.alias("source"), t.alias("target"), F.lit(kind).alias("edge_type"), F.lit(confidence).alias("confidence"), direction.alias("direction"))
    none = F.lit(0)
    pairs = F.flatten(F.transform(e, lambda a, i: F.transform(F.filter(F.slice(e, i + 2, F.greatest(F.size(e), F.lit(1))), lambda b: b["entity_type"] != a["entity_type"]), lambda b: edge(a["name"], b["name"], CO_OCCURS, CO_OCCURS_CONFIDENCE, none))))
    parts = [pairs]
    low, sign = F.lower("text"), F.col("_direction") if "_direction" in found.columns else direction_of(F.col("text"))
    for kind, words, targets, source, confidence, signed in rules:
        fires = F.lit(False)
        for w in words:
            fires = fires | low.contains(w)
        made = _product(names([source]), names(targets), partial(edge, kind=kind, confidence=confidence, direction=sign if signed else none))
        parts.append(F.when(fires, made).otherwise(F.array().cast("array<struct<source:string,target:string,edge_type:string,confidence:double,direction:int>>")))
    return found.select("chunk_id", "available_at", F.explode(F.concat(*parts)).alias("x")).select("chunk_id", "available_at", "x.*")


def roll_up_entities(mentions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row an entity (of each point of ``keys``): entity_id, entity_type, name, first_seen, source_chunk_ids.

    Name and day are those of the first chunk, in order of chunk_id, as the chunks are scanned; chunk ids are ordered.
    """
    first = F.min_by(F.struct("name", "available_at"), "chunk_id").alias("f")
    by = mentions.groupBy(*keys, "entity_type", F.lower("name").alias("_low")).agg(first, F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))
    return by.select(*keys, entity_id(F.col("entity_type"), F.col("_low")).alias("entity_id"), "entity_type", F.col("f.name").alias("name"), F.col("f.available_at").alias("first_seen"), "source_chunk_ids")


def roll_up_edges(candidates: DataFrame, entities: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each pair of names and type (of each point of ``keys``), under entity ids; edges with an end that is no entity go."""
    first = F.min_by(F.struct("available_at", "confidence", "direction"), F.struct("chunk_id", "confidence", "direction")).alias("f")
    by = candidates.groupBy(*keys, F.lower("source").alias("_s"), F.lower("target").alias("_t"), "edge_type").agg(first, F.array_sort(F.collect_set("chunk_id")).alias("evidence"))
    # names of several types: the last entity in order of its id stands, so that a name is one end
    ids = entities.groupBy(*keys, F.lower("name").alias("_n")).agg(F.max("entity_id").alias("id"))
    s, t = ids.select(*keys, F.col("_n").alias("_s"), F.col("id").alias("src")), ids.select(*keys, F.col("_n").alias("_t"), F.col("id").alias("dst"))
    both = by.join(s, [*keys, "_s"]).join(t, [*keys, "_t"])
    return both.select(*keys, edge_id(F.col("src"), F.col("dst"), F.col("edge_type")).alias("edge_id"), "src", "dst", "edge_type", F.col("f.confidence").alias("confidence"), F.lit("document_stated").alias("method"), F.col("f.direction").alias("direction"), F.col("f.available_at").alias("first_seen"), "evidence")


def canonical_ends(candidates: DataFrame, found: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Edge candidates under canonical names; those with an end that was cleaned away, and loops, go."""
    rows = found.select("chunk_id", "available_at", F.explode("found").alias("e")).select("chunk_id", "available_at", "e.*").withColumn("_raw", F.lower(F.trim("name")))
    names = clean_names(rows, universe).select("chunk_id", "_raw", "name").distinct()
    s, t = names.select("chunk_id", F.col("_raw").alias("_s"), F.col("name").alias("_source")), names.select("chunk_id", F.col("_raw").alias("_t"), F.col("name").alias("_target"))
    both = candidates.withColumn("_s", F.lower(F.trim("source"))).withColumn("_t", F.lower(F.trim("target"))).join(s, ["chunk_id", "_s"]).join(t, ["chunk_id", "_t"])
    return both.where("_source != _target").select("chunk_id", "available_at", F.col("_source").alias("source"), F.col("_target").alias("target"), "edge_type", "confidence", "direction")


def explanations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(edge_id, explanation, first chunk) in a fixed sentence for each edge type."""
    name = lambda end: entities.select(F.col("entity_id").alias(end), F.col("name").alias(f"_{end}"))
    said = {CO_OCCURS: " and {t} co-occur in the same chunk.", "exposed_to": " is exposed to {t}.", "sensitive_to": " is sensitive to {t}.", "causes": " causes {t}.", "benefits": " benefits from {t}.", "hurts": " is hurt by {t}."}
    sentence = F.lit(None).cast("string")
    for kind, end in said.items():
        a, b = end.split("{t}")
        lead = "" if kind == CO_OCCURS else "Text indicates "
        sentence = F.when(F.col("edge_type") == kind, F.concat(F.lit(lead), F.col("_src"), F.lit(a), F.col("_dst"), F.lit(b))).otherwise(sentence)
    return edges.join(name("src"), "src").join(name("dst"), "dst").select("edge_id", sentence.alias("explanation"), F.get("evidence", F.lit(0)).alias("chunk_id"))


class RuleExtractor:
    """Extractor by rules; another one offers ``extract`` with the same tables. ``chunks``: chunk_id, available_at, text."""

    def __init__(self, entity_rules=ENTITY_RULES, trigger_rules=TRIGGER_RULES, universe: DataFrame | None = None):
        self.entity_rules, self.trigger_rules, self.universe = entity_rules, trigger_rules, universe

    def extract(self, chunks: DataFrame) -> dict[str, DataFrame]:
        """mentions and candidates, under canonical names."""
        found = runtime.staged(find_entities(chunks.where("chunk_id IS NOT NULL AND text != ''"), self.entity_rules).withColumn("_direction", direction_of(F.col("text"))), "found-entities")  # texts are searched once
        return {"mentions": mentions_of(found, self.universe), "candidates": canonical_ends(edge_candidates(found, self.trigger_rules), found, self.universe)}


def run_extraction(chunks: DataFrame, extractor: RuleExtractor | None = None) -> dict[str, DataFrame]:
    """entities, edges, edge_explanations and entity_chunk_provenance of the chunks. Null and empty texts have none."""
    made = (extractor or RuleExtractor()).extract(chunks)
    entities = roll_up_entities(made["mentions"])
    edges = roll_up_edges(made["candidates"], entities)
    where = made["mentions"].select(entity_id(F.col("entity_type"), F.lower("name")).alias("entity_id"), "chunk_id", "available_at").distinct()
    return {"entities": entities, "edges": edges, "edge_explanations": explanations(edges, entities), "entity_chunk_provenance": where}
