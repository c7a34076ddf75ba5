"""Writers: contract tables, appends, merges and the flat files of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.sources.catalog import LeakageError


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the contract's columns, in order and with its types; absent ones are null, unknown ones are an error."""
    extra = [c for c in df.columns if c not in schema.names]
    if extra:
        raise ValueError(f"columns outside the contract: {', '.join(extra)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, schema: T.StructType, path: str, partitions: list[str] | None = None, frozen: bool = False) -> None:
    """Typed Parquet, also when there are no rows. Frozen points are not written again."""
    if frozen:
        raise LeakageError("discovery is frozen")
    out = conform(df, schema).write.mode("overwrite")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)


def append_aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both under the columns of the first."""
    return old.unionByName(new.select(*[c for c in new.columns if c in old.columns]), allowMissingColumns=True)


def merge_runs(runs: list[DataFrame], key: list[str]) -> DataFrame:
    """One row a key: that of the last run which has it."""
    all_rows = None
    for k, df in enumerate(runs):
        df = df.withColumn("_run", F.lit(k))
        all_rows = df if all_rows is None else all_rows.unionByName(df, allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy(F.desc("_run"), *[c for c in all_rows.columns if c not in {*key, "_run"}])
    return all_rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_run")


def write_validation_csv(df: DataFrame, path: str, returns: list[str]) -> None:
    """Returns with six decimals, nothing for null."""
    shown = [F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("")).alias(c) if c in returns else F.col(c) for c in df.columns]
    df.select(*[F.when(F.col(c).isNull(), "").otherwise(x).alias(c) if c in returns else x for c, x in zip(df.columns, shown)]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_manifest(rows: DataFrame, columns: tuple[str, ...], path: str) -> None:
    """A manifest as CSV with the contract's columns in order; absent ones are empty."""
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_document(parts: dict[str, DataFrame], path: str, **fields) -> None:
    """One JSON document: plain fields, and a list of records for each table. For documents that a reader takes whole.

    Records are put together by one task, in order of their text; large tables are better read as tables.
    """
    spark = next(iter(parts.values())).sparkSession
    doc = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])
    for name, df in parts.items():
        rows = df.select(F.to_json(F.struct("*")).alias("j")).agg(F.array_sort(F.collect_list("j")).alias("j"))
        doc = doc.join(rows.select(F.concat(F.lit("["), F.array_join("j", ","), F.lit("]")).alias(f"_{name}")))  # one row each
    texts = [F.concat(F.lit(f'"{n}":'), f"_{n}") for n in parts]
    plain = F.to_json(F.struct(*[F.col(k) for k in fields])) if fields else F.lit("{}")
    head = F.expr("substring(p, 2, length(p) - 2)")
    body = doc.withColumn("p", plain).select(F.concat(F.lit("{"), F.concat_ws(",", F.when(head != "", head), *texts), F.lit("}")).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)
