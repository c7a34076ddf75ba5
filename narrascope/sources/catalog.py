"""Zones, views for analysts, and the freeze."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators.evidence import table_digest

VALIDATION_PREFIX = "v_val_"


class LeakageError(RuntimeError):
    """Validation data was asked for before discovery was frozen."""


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_artifacts(spark: SparkSession, patterns: list[str]) -> DataFrame | None:
    """Parquet files of several runs and points, joined by name; run_id and as_of come from the path ('' in the flat layout)."""
    live = [p for p in patterns if _exists(spark, p)]
    out = None
    for p in live:
        df = spark.read.option("mergeSchema", "true").parquet(p)
        where = F.col("_metadata.file_path")
        renamed = df.withColumnRenamed("run_id", "run_id_1")
        df = renamed.select(F.regexp_extract(where, r"/runs/([^/]+)/", 1).alias("run_id"), F.regexp_extract(where, r"/discovery/(\d{4}-\d{2}-\d{2})/", 1).alias("as_of"), "*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def guarded(zone: str, frozen: bool) -> None:
    if zone == "validation" and not frozen:
        raise LeakageError("validation data is closed until discovery is frozen")


@contextmanager
def analyst_session(spark: SparkSession, views: dict[str, str], frozen: bool) -> Iterator[SparkSession]:
    """A session of its own with one view a name; names whose files don't exist are left out, and views end with it."""
    session = spark.newSession()
    made = []
    try:
        for name, pattern in views.items():
            if name.startswith(VALIDATION_PREFIX):
                guarded("validation", frozen)
            if _exists(spark, pattern):
                df = session.read.parquet(pattern)
                # a projection, since a bare file relation could be inserted into
                df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns]).where(F.lit(True)).createOrReplaceTempView(name)
                made.append(name)
        yield session
    finally:
        for name in made:
            session.catalog.dropTempView(name)


def freeze(artifacts: dict[str, DataFrame], required: list[str]) -> dict[str, tuple]:
    """Digest of each artifact; all required ones must be there."""
    missing = [x for x in required if x not in artifacts]
    if missing:
        raise ValueError(f"cannot freeze without {', '.join(missing)}")
    return {name: tuple(table_digest(df).first()) for name, df in artifacts.items()}


def verify(frozen: dict[str, tuple], artifacts: dict[str, DataFrame]) -> list[str]:
    """Artifacts that differ from what was frozen."""
    return [name for name, digest in frozen.items() if name not in artifacts or tuple(table_digest(artifacts[name]).first()) != digest]
