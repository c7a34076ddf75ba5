"""Digests of a table in three levels, so that a change is found by reading one bucket: table, buckets of keys, rows.

The digest of a row is the sha256 of its values; buckets and the table add up two lanes of 60 bits of it, which no order
of rows or files changes and repeated rows don't cancel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def _said(columns: list[str]) -> Column:
    # the length before each value, so that no two rows are told the same
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns])


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a row, by the first bits of the digest of its keys."""
    return (F.conv(F.substring(F.sha2(_said(keys), 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def row_digests(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """keys, bucket and row, the digest of all columns."""
    return df.select(*keys, bucket_of(keys, buckets).alias("bucket"), F.sha2(_said(sorted(df.columns)), 256).alias("row"))


def bucket_digests(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, n_rows, digest, mix: at most ``buckets`` rows, to be kept beside a frozen table."""
    lane = lambda at: F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return row_digests(df, keys, buckets).groupBy("bucket").agg(F.count("*").alias("n_rows"), lane(1).alias("digest"), lane(16).alias("mix"))


def changed_buckets(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Buckets whose digests differ, or which only one side has."""
    a = frozen.select("bucket", F.struct("n_rows", "digest", "mix").alias("_a"))
    b = now.select("bucket", F.struct("n_rows", "digest", "mix").alias("_b"))
    return a.join(b, "bucket", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("bucket")


def changed_keys(old: DataFrame, new: DataFrame, keys: list[str], frozen: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """keys and change (added, removed, changed) between two states of a table.

    ``frozen``: the kept ``bucket_digests`` of ``old``, so that of it only the buckets in question are read. Rows that repeat
    a key are compared as a whole: their number and the sum of their digests.
    """
    kept = frozen if frozen is not None else bucket_digests(old, keys, buckets)
    open_ = F.broadcast(changed_buckets(kept, bucket_digests(new, keys, buckets)))  # at most ``buckets`` rows

    def side(df: DataFrame, name: str) -> DataFrame:
        lane = lambda at: F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(38,0)"))
        near = df.withColumn("_bucket", bucket_of(keys, buckets)).join(open_.withColumnRenamed("bucket", "_bucket"), "_bucket", "left_semi").drop("_bucket")
        return row_digests(near, keys, buckets).groupBy(*keys).agg(F.struct(F.count("*").alias("n"), lane(1).alias("a"), lane(16).alias("b")).alias(name))

    a, b = side(old, "_old"), side(new, "_new")
    b = b.select(*[F.col(k).alias(f"_n_{k}") for k in keys], "_new")
    same = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    both = a.join(b, same, "full").select(*[F.coalesce(k, f"_n_{k}").alias(k) for k in keys], "_old", "_new")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys, kind.alias("change"))
