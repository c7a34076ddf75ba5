"""Point-in-time gates and as-of lookups. Dates are DATE columns, never compared as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_day(value: Column) -> Column:
    """A date from a date, a timestamp or text that begins with an ISO day; null where there is none."""
    return F.coalesce(F.try_to_timestamp(F.substring(value.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def known_at(day: Column, as_of: Column | str, undated: str = "closed") -> Column:
    """Rows known at ``as_of``: ``closed`` leaves undated rows out, ``open`` lets them pass."""
    limit = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return (day.isNotNull() & (day <= limit)) if undated == "closed" else (day.isNull() | (day <= limit))


def at_points(rows: DataFrame, points: DataFrame, day: str) -> DataFrame:
    """Each row once for every point (as_of) at which it is known. ``points`` is a short list."""
    return rows.join(F.broadcast(points), known_at(F.col(day), F.col("as_of")))


def latest_signal(series: DataFrame, key: str, day: str, value: str, as_of: str, lag_days: int = 35, back_days: int = 80, flat_band: float = 0.01) -> DataFrame:
    """For each key the latest observation released by ``as_of``, the one about a quarter before, and the trend."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), lag_days)
    seen = series.where(F.col(value).isNotNull() & (F.col(day) <= cutoff))
    latest = seen.groupBy(key).agg(F.max(F.struct(day, value)).alias("now"))
    both = seen.join(latest, key)
    prior = F.max(F.when(F.col(day) <= F.date_sub(F.col(f"now.{day}"), back_days), F.struct(day, value)))
    out = both.groupBy(key).agg(F.max("now").alias("now"), prior.alias("before"))
    now, before = F.col(f"now.{value}"), F.coalesce(F.col(f"before.{value}"), F.col(f"now.{value}"))
    band = F.when(before == 0, F.lit(0.001)).otherwise(F.abs(before) * flat_band)
    trend = F.when(now - before > band, "rising").when(before - now > band, "falling").otherwise("flat")
    return out.select(key, F.col(f"now.{day}").alias("obs_date"), now.alias("value"), before.alias("prior"), trend.alias("trend"))


def zscore_regime(series: DataFrame, key: str, day: str, value: str, as_of: str, window_days: int, high: float = 1.0) -> DataFrame:
    """Latest value of each key against the mean and population deviation of its trailing window; two observations at least."""
    end = F.lit(as_of).cast("date")
    recent = series.where(F.col(value).isNotNull() & (F.col(day) <= end) & (F.col(day) > F.date_sub(end, window_days)))
    s = recent.groupBy(key).agg(F.max_by(value, day).alias("value"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n"))
    z = F.when((F.col("n") >= 2) & (F.col("sd") > 0), (F.col("value") - F.col("mean")) / F.col("sd"))
    return s.select(key, "n", F.round(z, 6).alias("z"), F.when(z >= high, "high").when(z <= -high, "low").when(z.isNotNull(), "normal").alias("regime"))


def month_ends(start: Column, as_of: Column) -> Column:
    """Month ends from start to as_of; the last one is as_of itself if its month is not over."""
    return F.array_distinct(F.transform(F.sequence(F.trunc(start, "month"), F.trunc(as_of, "month"), F.expr("interval 1 month")), lambda d: F.least(F.last_day(d.cast("date")), as_of)))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
