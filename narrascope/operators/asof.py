"""As-of lookups for many points at once, and regimes over rolling windows of days, without a group for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime


def asof(observations: DataFrame, cutoffs: DataFrame, key: str, day: str, value: str, cutoff: str) -> DataFrame:
    """``cutoffs`` with ``day`` and ``value`` of the last observation of the key on or before the cutoff (null if none).

    Observations and cutoffs are sorted together by key and day in ranges, each of which carries its last observation along;
    what a range begins with is handed over from the ranges before it. A key with most of the rows is spread over many
    ranges. Of observations of one day the largest counts; those without a day or a value are left out. Cutoffs without a
    key or a day stay, with nulls. ``cutoffs`` may repeat rows.
    """
    asked = cutoffs.withColumn("_more", F.struct(*cutoffs.columns))
    seen = observations.where(F.col(day).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(day).alias("_day"), F.lit(0).alias("_kind"), F.struct(F.col(day).alias("day"), F.col(value).alias("value")).alias("_seen"), F.lit(None).cast(asked.schema["_more"].dataType).alias("_more"))
    wanted = asked.select(F.col(key).alias("_key"), F.col(cutoff).alias("_day"), F.lit(1).alias("_kind"), F.lit(None).cast(seen.schema["_seen"].dataType).alias("_seen"), "_more")
    order = ["_key", "_day", "_kind", "_seen"]
    sorted_rows = seen.unionByName(wanted).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = runtime.staged(sorted_rows.withColumn("_part", F.spark_partition_id()), "asof-rows")
    ends = rows.where("_kind = 0").groupBy("_key", "_part").agg(F.max("_seen").alias("_last"))
    # at most a row for each key and range
    here = rows.select("_key", "_part").distinct().join(ends, ["_key", "_part"], "left")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = here.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select("_key", "_part", "_carry")
    along = Window.partitionBy("_part", "_key").orderBy("_day", "_kind", "_seen").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_own", F.last("_seen", ignorenulls=True).over(along)).where("_kind = 1")
    both = local.join(carried, ["_key", "_part"], "left").withColumn("_found", F.when(F.col("_day").isNotNull(), F.coalesce("_own", "_carry")))
    return both.select("_more.*", F.col("_found.day").alias(day), F.col("_found.value").alias(value))


def signals_at(series: DataFrame, points: DataFrame, key: str, day: str, value: str, lag_days: int = 35, back_days: int = 80, flat_band: float = 0.01) -> DataFrame:
    """(key, as_of, obs_date, value, prior, trend) for every row of ``points`` (key, as_of) that has an observation released by then.

    An observation is released ``lag_days`` after its day; the prior one is the last at least ``back_days`` older, else the
    same. Two lookups for all points together.
    """
    asked = points.select(key, "as_of", F.date_sub("as_of", lag_days).alias("_cut"))
    now = asof(series, asked, key, day, value, "_cut").where(F.col(day).isNotNull())
    now = now.select(key, "as_of", F.col(day).alias("_obs"), F.col(value).alias("_now"), F.date_sub(day, back_days).alias("_cut"))
    both = asof(series, now, key, day, value, "_cut")
    before = F.coalesce(F.col(value), F.col("_now"))
    band = F.when(before == 0, F.lit(0.001)).otherwise(F.abs(before) * flat_band)
    trend = F.when(F.col("_now") - before > band, "rising").when(before - F.col("_now") > band, "falling").otherwise("flat")
    return both.select(key, "as_of", F.col("_obs").alias("obs_date"), F.col("_now").alias("value"), before.alias("prior"), trend.alias("trend"))


def rolling_regimes(series: DataFrame, key: str, day: str, value: str, window_days: int, far: float = 1.0) -> DataFrame:
    """(key, day, value, n, z, regime) for every observation against the ``window_days`` days that end with it.

    Days are dealt into blocks of one window; a row is there for its own block and the next, so a frame never reaches
    beyond a block's rows and a long series is as many groups as it has blocks. Sums are exact decimals (six places), so
    they don't depend on order. Fewer than two observations, or equal ones, are ``normal``, without a z.
    """
    exact = F.col(value).cast("decimal(18,6)")
    rows = series.where(F.col(day).isNotNull() & F.col(value).isNotNull()).select(key, day, value, exact.alias("_v"), F.unix_date(day).alias("_n"))
    block = F.floor(F.col("_n") / window_days)
    dealt = rows.withColumn("_home", block).withColumn("_block", F.explode(F.array(block, block + 1)))
    frame = Window.partitionBy(key, "_block").orderBy("_n").rangeBetween(-(window_days - 1), 0)
    n, s, q = F.count("*").over(frame), F.sum("_v").over(frame), F.sum((F.col("_v") * F.col("_v")).cast("decimal(30,12)")).over(frame)
    sums = dealt.select(key, day, value, "_home", "_block", "_v", n.alias("n"), s.alias("_s"), q.alias("_q")).where("_home = _block")
    count = F.col("n").cast("decimal(18,0)")
    # n * sum of squares - square of the sum: exact, and 0 only where all are equal
    spread = (count * F.col("_q")).cast("decimal(38,12)") - (F.col("_s") * F.col("_s")).cast("decimal(38,12)")
    apart = (count * F.col("_v") - F.col("_s")).cast("double")
    z = F.when((F.col("n") >= 2) & (spread > 0), apart / F.sqrt(spread.cast("double")))
    out = sums.withColumn("z", z)
    return out.select(key, day, value, "n", F.round("z", 6).alias("z"), regime_label(F.col("z"), far).alias("regime"))


def regime_label(z: Column, far: float = 1.0) -> Column:
    return F.when(z > far, "elevated").when(z < -far, "depressed").otherwise("normal")
