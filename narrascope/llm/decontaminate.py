"""Benchmark passages in documents, also with other numbers, names and units; DataFrame functions alone.

Words become a template: numbers, names (words that begin with a capital, wherever they stand, as the first word of a
sentence may be a name) and units after numbers are typed slots. Windows of templates, and of plain words beside them,
are hash-joined with those of the benchmark. Where templates meet along one shift, what the slots hold must agree: each
value of the item stands for one value of the document. Neighbouring shifts are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.joins import join_sized
from narrascope.llm.quality import bound

#: Marks in token lines: before a name, slots, a point or comma between digits, a space inside a name.
NAME, NUMBER, UNIT, POINT, JOINT = "\x01", "\x02", "\x03", "\x04", "\x05"
#: Units that count as a slot after a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd mi mile miles mg g kg t lb lbs oz ml cl l s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years eur euro euros usd dollar dollars cent cents pct percent hz khz mhz w kw v a mb gb tb"
).split()

#: The capital that begins a word; and what separates tokens.
CAPITAL = "\\p{Lu}(?<![\\p{L}\\p{N}].)(?=\\p{Ll})"
GAP = f"[^\\p{{L}}\\p{{N}}{NAME}{JOINT}{POINT}]+"


def token_lines(text: Column) -> Column:
    """struct(words, raw, template), tokens in small letters, one space apart.

    ``words`` are the words of letters and digits alone. ``raw`` has numbers with their separators and names of several
    words as one token each, and ``template`` slots in their place: both have equally many.
    """

    def templates(values: Column) -> Column:
        named = F.regexp_replace(values, f"{NAME}[^ ]+", NAME)
        numbered = F.regexp_replace(F.concat(F.lit(" "), named, F.lit(" ")), " \\p{L}*+\\p{N}[^ ]*", f" {NUMBER}")
        return F.trim(F.regexp_replace(numbered, f"{NUMBER} (?:{'|'.join(UNITS)})(?= )", f"{NUMBER} {UNIT}"))

    def fields(values: Column) -> Column:
        words = F.replace(F.replace(F.replace(values, F.lit(NAME), F.lit("")), F.lit(JOINT), F.lit(" ")), F.lit(POINT), F.lit(" "))
        return F.struct(words.alias("words"), values.alias("raw"), templates(values).alias("template"))

    for mark in (NAME, POINT, JOINT):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    named = F.regexp_replace(F.regexp_replace(text, CAPITAL, f"{NAME}$0"), f"{NAME}([\\p{{L}}\\p{{N}}]+)[\x09-\x0D ]+(?={NAME})", f"{NAME}$1{JOINT}")
    named = F.regexp_replace(named, "[.,](?<=\\p{N}.)(?=\\p{N})", POINT)
    return bound(F.lower(F.trim(F.regexp_replace(named, GAP, " "))), fields)


def split(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def windows(tokens: Column, kind: int, n: int) -> Column:
    """Every run of ``n`` tokens: where it begins and a hash that the kind and ``n`` take part in."""

    def each(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(kind), F.lit(n), *[F.get(h, i + k) for k in range(n)]).alias("hash")))

    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    return bound(hashes, lambda h: F.when(F.size(h) < n, F.array().cast("array<struct<at:int,hash:bigint>>")).otherwise(each(h)))


def is_slot(token: Column) -> Column:
    return token.isin(NAME, NUMBER, UNIT)


TEMPLATE, WORDS = 0, 1
FIELDS = {TEMPLATE: "template", WORDS: "words"}


def contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, least_literals: int = 4, least_tokens: int = 13, least_share: float = 0.6) -> DataFrame:
    """Staged pairs (doc_id, item_id) of documents that hold a benchmark item: n_tokens covered, item_tokens, n_slots, consistent.

    A pair counts when windows along neighbouring shifts (each at most ``n`` from the next, as words put in or left out
    make them) together cover ``least_tokens`` tokens of the item, or ``least_share`` of one that is shorter. Windows of
    ``n`` words as they are (any case) always count. Windows of templates count with ``least_literals`` words besides
    slots, and only of shifts whose slots agree, however much they cover. Items under ``n`` tokens are found by one
    window of their whole length, however short. Null and empty texts hold nothing; rows that repeat a doc_id are one
    document, and so are rows that repeat an item_id; null ids are left out of the result; either table may be empty.
    A long text is one row of the scan, all its windows with it. Of other columns none is read, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item"), token_lines(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("l"))
    items = runtime.staged(items.select("item", *[split(F.col(f"l.{c}")).alias(c) for c in ("words", "raw", "template")]).distinct(), "items")
    literal = lambda tokens: F.size(F.filter(tokens, lambda t: ~is_slot(t)))
    index = None
    for kind, field in FIELDS.items():
        for k in range(1, n + 1):
            chosen = items.where(F.size(field) >= n) if k == n else items.where(F.size(field) == k)
            rows = chosen.select("item", F.col(field).alias("tokens"), F.explode(windows(F.col(field), kind, k)).alias("w"))
            if kind == TEMPLATE:
                rows = rows.where(literal(F.slice("tokens", F.col("w.at") + 1, k)) >= least_literals)
            rows = rows.select(F.lit(kind).alias("kind"), F.lit(k).alias("k"), "w.hash", "item", "w.at", F.size("tokens").alias("item_tokens"))
            index = rows if index is None else index.unionByName(rows)
    index = runtime.staged(index.groupBy("kind", "k", "hash").agg(F.collect_set(F.struct("item", "at", "item_tokens")).alias("places")), "item-windows")
    widths = sorted((r["kind"], r["k"]) for r in index.select("kind", "k").distinct().collect())  # 2 n at most

    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    of_text = bound(token_lines(F.col("text")), lambda l: F.concat(none, *[windows(split(l[FIELDS[kind]]), kind, k) for kind, k in widths]))
    rows = base.select("doc", F.explode(of_text).alias("w")).select("doc", F.col("w.at").alias("pos"), F.col("w.hash").alias("hash"))
    met = join_sized(rows, index, "hash").select("doc", "pos", "kind", "k", F.explode("places").alias("p"))
    met = met.select("doc", "kind", "k", "p.*", (F.col("pos") - F.col("p.at")).alias("shift"))
    runs = met.groupBy("doc", "item", "kind", "item_tokens", "shift").agg(F.array_sort(F.collect_set(F.struct("at", "k"))).alias("windows"))
    covered = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["at"], w["at"] + w["k"] - 1))))
    runs = runs.select("doc", "item", "kind", "item_tokens", "shift", covered.alias("covered"))
    along = Window.partitionBy("doc", "item", "kind", "item_tokens").orderBy("shift")
    breaks = F.coalesce((F.col("shift") - F.lag("shift").over(along) > n).cast("int"), F.lit(0))
    runs = runs.withColumn("break", breaks).withColumn("part", F.sum("break").over(along))
    need = F.least(F.lit(least_tokens), F.ceil(F.col("item_tokens") * least_share))
    part = ["doc", "item", "kind", "item_tokens", "part"]
    whole = runs.groupBy(*part).agg(F.collect_list(F.struct("shift", "covered")).alias("runs")).withColumn("n", F.size(F.array_distinct(F.flatten("runs.covered"))))
    whole = runtime.staged(whole.where(F.col("n") >= need), "runs")

    same = whole.where(F.col("kind") == WORDS).select("doc", "item", F.col("n").alias("n"), F.lit(True).alias("consistent"), F.lit(0).alias("slots"), "item_tokens")
    other = whole.where(F.col("kind") == TEMPLATE).select(*part, F.explode("runs").alias("r")).select(*part, "r.*")
    wanted = runtime.staged(other.select("doc").distinct(), "matched-documents")
    raw = join_sized(base, wanted, "doc").select("doc", split(token_lines(F.col("text"))["raw"]).alias("said"))
    full = raw.join(other, "doc").join(items, "item")
    pairs = F.array_distinct(F.transform(F.filter("covered", lambda i: is_slot(F.get("template", i))), lambda i: F.struct(F.get("template", i).alias("type"), F.get("raw", i).alias("item"), F.get("said", i + F.col("shift")).alias("doc"))))
    full = full.withColumn("pairs", pairs)
    full = full.withColumn("agree", F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["type"], p["item"])))))
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    # of rows that repeat an id, those whose slots agree are tried alone
    sums = full.groupBy(*part).agg(union(F.when(F.col("agree"), F.col("covered"))).alias("agreed"), F.size(union(F.when(F.col("agree"), F.col("pairs")))).alias("slots"))
    sums = sums.where(F.size("agreed") >= need)
    other = sums.select("doc", "item", F.size("agreed").alias("n"), F.lit(True).alias("consistent"), "slots", "item_tokens")
    best = same.unionByName(other).groupBy("doc", "item").agg(F.max(F.struct("n", "consistent", "slots", "item_tokens")).alias("b"))
    return runtime.staged(best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("b.n").cast("long").alias("n_tokens"), F.col("b.item_tokens").cast("long").alias("item_tokens"), F.col("b.slots").cast("long").alias("n_slots"), F.col("b.consistent").alias("consistent")), "contaminated")
