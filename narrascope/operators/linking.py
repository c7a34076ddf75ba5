"""Names of an alias table of any size, found in whole texts: the longest that begins first, without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.operators.textops import tokens

#: A table of names is sent to all executors up to this size; beyond it names and windows meet in a shuffle.
BROADCAST_BYTES = 24 << 20


def alias_names(aliases: DataFrame) -> DataFrame:
    """Staged (said, n_words, entity_id): each name as words in lower case; of several entities the first by id. Names without a word go."""
    w = tokens(F.col("alias"))
    rows = aliases.select(F.array_join(w, " ").alias("said"), F.size(w).alias("n_words"), "entity_id").where("n_words > 0 AND entity_id IS NOT NULL")
    return runtime.staged(rows.groupBy("said", "n_words").agg(F.min("entity_id").alias("entity_id")), "alias-names")


def _windows(words: Column, lengths: list[int]) -> Column:
    """(at, n_words, said) of all runs of words that are as long as some name."""
    some = F.array().cast("array<struct<at:int,n_words:int,said:string>>")

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
        made = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.lit(n).alias("n_words"), F.array_join(F.slice(words, i, n), " ").alias("said")))
        return F.coalesce(made, some)

    return F.concat(some, *[of(n) for n in lengths])


def _longest_first(found: Column) -> Column:
    """Of matches in order of place, longer ones first, those that begin where the last one that stays has ended."""
    kind = "array<struct<at:int,n_words:int,said:string,entity_id:string>>"
    zero = F.struct(F.lit(0).alias("done"), F.array().cast(kind).alias("kept"))

    def take(held: Column, x: Column) -> Column:
        one = F.struct(x["at"].alias("at"), x["n_words"].alias("n_words"), x["said"].alias("said"), x["entity_id"].alias("entity_id"))
        return F.when(x["at"] >= held["done"], F.struct((x["at"] + x["n_words"]).alias("done"), F.array_append(held["kept"], one).alias("kept"))).otherwise(held)

    return F.aggregate(F.array_sort(found), zero, take, lambda held: held["kept"])


def link_aliases(docs: DataFrame, aliases: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, n_words, alias, entity_id): where names stand in each text, in words from 0.

    ``docs``: key, text; ``aliases``: alias, entity_id. Texts are scanned once, and only runs of words as long as some name
    are looked up. Null texts and texts without a name have no row; rows that repeat a key count by their texts (a 64-bit
    hash), equal ones once. Names in any case; ids are strings.
    """
    names = alias_names(aliases.select("alias", F.col("entity_id").cast("string").alias("entity_id")))
    lengths = sorted(r["n_words"] for r in names.select("n_words").distinct().collect())  # at most the words of the longest name
    known = names.select("said", "entity_id")
    known = F.broadcast(known) if runtime.stored_bytes(names) <= BROADCAST_BYTES else known
    texts = docs.where("text IS NOT NULL").select(F.col(key).alias("_key"), F.xxhash64("text").alias("_text"), tokens(F.col("text")).alias("_words"))
    windows = texts.select("_key", "_text", F.explode(_windows(F.col("_words"), lengths)).alias("_w")).select("_key", "_text", "_w.*")
    met = windows.join(known, "said")
    # places of one text, the longest first at each
    ordered = F.struct("at", (-F.col("n_words")).alias("less"), "n_words", "said", "entity_id")
    by_text = met.groupBy("_key", "_text").agg(F.collect_set(ordered).alias("found"))
    kept = by_text.select("_key", F.explode(_longest_first(F.col("found"))).alias("_x"))
    return kept.select(F.col("_key").alias(key), F.col("_x.at").alias("place"), "_x.n_words", F.col("_x.said").alias("alias"), "_x.entity_id")
