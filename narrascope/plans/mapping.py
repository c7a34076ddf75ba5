"""Engine concepts over the star-schema tables: what stands for documents, companies, prices, themes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOCS_SQL = "(SELECT doc_id, text, lang, source, DATE '2024-01-01' + (doc_id % 365)::INT AS available_at FROM documents)"
PRICES_SQL = "(SELECT l_suppkey AS company_id, l_shipdate::DATE AS price_date, l_shipdate::DATE AS available_at, l_extendedprice / l_quantity AS close, l_orderkey, l_linenumber, l_partkey FROM lineitem)"
TRADES_SQL = "(SELECT l_suppkey, p_brand, l_shipdate::DATE AS day, l_discount, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"
SERIES_SQL = "(SELECT event_type, ts::DATE AS obs_date, round(sum(value), 6) AS value FROM events GROUP BY ALL)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.expr("date_add(DATE '2024-01-01', CAST(doc_id % 365 AS INT))").alias("available_at"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_id"), day.alias("price_date"), day.alias("available_at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), "l_orderkey", "l_linenumber", "l_partkey")


PRICE_TIE = ["l_orderkey", "l_linenumber", "l_partkey"]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand", F.to_date("l_shipdate").alias("day"), "l_discount", "l_quantity")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("obs_date")).agg(F.round(F.sum("value"), 6).alias("value"))


def points(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "as_of string, months int").withColumn("as_of", F.to_date("as_of"))


# suppliers linked to the parts they shipped
LINKS_SQL = "(SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
