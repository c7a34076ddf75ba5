"""Ingest that can be repeated: a table with a folder for each company, of which only the companies at hand are written.

A batch replaces the rows of its companies. The files of all others stay as they are, whatever the size of the table.
Each batch leaves a record of what it wrote; a batch whose record is there is not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators.evidence import table_digest
from narrascope.sources.catalog import _exists

RECORD = "batch string, n_rows bigint, digest string, mix string, n_companies bigint"


def _records(root: str) -> str:
    return f"{root.rstrip('/')}/_batches"


def committed(spark: SparkSession, root: str) -> DataFrame:
    """batch, n_rows, digest, mix, n_companies of the batches written so far."""
    return spark.read.schema(RECORD).parquet(_records(root)) if _exists(spark, _records(root)) else spark.createDataFrame([], RECORD)


def read_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/rows")


def ingest(rows: DataFrame, root: str, batch: str, company: str = "company_id", files_each: int = 1) -> bool:
    """Writes a batch; False if it was there already with the same rows. A batch of that name with other rows is refused.

    Rows without a company go to a company of their own. Only folders of companies in the batch are written, each by
    ``files_each`` tasks at most. A job that fails leaves the folders as they were and no record, so it can be run again.
    """
    spark = rows.sparkSession
    n, digest, mix = table_digest(rows).first()
    known = committed(spark, root).where(F.col("batch") == batch).first()
    if known is not None:
        if (known["n_rows"], known["digest"], known["mix"]) != (n, digest, mix):
            raise ValueError(f"batch {batch} was written with other rows")
        return False
    deal = F.pmod(F.xxhash64(*rows.columns), F.lit(files_each))
    rows.repartition(F.col(company), deal).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(company).parquet(f"{root.rstrip('/')}/rows")
    many = rows.select(company).distinct().count()
    spark.createDataFrame([(batch, n, digest, mix, many)], RECORD).coalesce(1).write.mode("append").parquet(_records(root))
    return True
