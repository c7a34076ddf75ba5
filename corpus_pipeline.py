"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns documents with the columns
of ``documents``; the last returns the packed pieces. Between stages the rows are written as Parquet and read again.
Decisions are taken by doc_id: rows that repeat an id stay or go together. A null id is no id to decide by: such rows
stay, whatever they hold, except that a text which all is cut from goes. Null and empty texts are rejected by the first
stage with all short ones, if they have an id. Texts of any length are taken whole. Columns of ``documents`` beyond the
five of the contract are left out, whatever their names; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.decontaminate import contaminated
from narrascope.llm.joins import join_sized
from narrascope.llm.ngramjoin import ngram_components
from narrascope.llm.packing import pack
from narrascope.llm.quality import judge
from narrascope.llm.registry import table, vocabulary
from narrascope.llm.suffixes import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the language references reject go: short, empty and null texts among them."""
    rejected = runtime.staged(judge(docs).where("not kept").select("doc_id").distinct(), "rejected")
    return join_sized(docs, rejected, "doc_id", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that 5-word shingles link at 0.8 or more, the one with the smallest id stays, with all its rows."""
    runtime.settle(spark)
    groups = ngram_components(docs, n=5, num=80, den=100)
    gone = runtime.staged(groups.where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    return join_sized(docs, gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier in the corpus are cut out; what is left empty goes, null texts too."""
    runtime.settle(spark)
    return remove_repeats(docs, length=100).where(F.col("n_chars") > 0).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other slots, go; without items all stay."""
    runtime.settle(spark)
    found = runtime.staged(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return join_sized(docs, found, "doc_id", "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens; a null id is packed like any other."""
    runtime.settle(spark)
    return pack(docs, vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Near copies, suffix sorting and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
