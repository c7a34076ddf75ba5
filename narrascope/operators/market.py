"""Forward returns, baskets, benchmarks and outcome statistics."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime


def window_prices(prices: DataFrame, points: DataFrame) -> DataFrame:
    """Prices usable for each (as_of, months): strictly after as_of, by the window's end, known on their own day.

    The earliest and the latest day of all windows are read off the short list of points first, so that they reach the
    scan of prices as plain comparisons.
    """
    ends = points.withColumn("window_end", F.add_months("as_of", F.col("months")))
    lo, hi = ends.agg(F.min("as_of"), F.max("window_end")).first()
    fits = (F.col("price_date") > F.col("as_of")) & (F.col("price_date") <= F.col("window_end"))
    usable = F.col("close").isNotNull() & F.col("available_at").isNotNull() & (F.col("available_at") <= F.col("price_date"))
    live = prices.where(usable & (F.col("price_date") > F.lit(lo)) & (F.col("price_date") <= F.lit(hi)))
    return live.join(F.broadcast(ends), fits)


def sums_at_points(rows: DataFrame, points: DataFrame, day: str, keys: list[str], value: str, total: str) -> DataFrame:
    """Sum of ``value`` by key over the rows known at each point (as_of).

    Rows are summed once, under the first point that knows them, and only these sums are repeated for later points.
    """
    days = [r[0] for r in points.select("as_of").distinct().orderBy("as_of").collect()]  # a short list
    since = F.lit(None).cast("date")
    for p in reversed(days):
        since = F.when(F.col(day) <= F.lit(p), F.lit(p)).otherwise(since)
    once = rows.withColumn("_since", since).where("_since IS NOT NULL").groupBy("_since", *keys).agg(F.sum(value).alias("_sum"))
    return once.join(F.broadcast(points.select("as_of").distinct()), F.col("_since") <= F.col("as_of")).groupBy("as_of", *keys).agg(F.sum("_sum").alias(total))


def forward_returns(prices: DataFrame, points: DataFrame, tie: list[str]) -> DataFrame:
    """as_of, months, company_id, entry and exit day and price, return: first and last price of the window, in one aggregation."""
    place = F.struct("price_date", *tie, F.col("close").alias("_close"))
    ends = window_prices(prices, points).groupBy("as_of", "months", "company_id").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    change = F.when(F.col("a._close") != 0, F.col("b._close") / F.col("a._close") - 1)
    return ends.select("as_of", "months", "company_id", F.col("a.price_date").alias("entry_date"), F.col("b.price_date").alias("exit_date"), F.col("a._close").alias("entry"), F.col("b._close").alias("exit"), change.alias("ret"))


def top_baskets(exposure: DataFrame, n: int) -> DataFrame:
    """The n most exposed companies of each theme, ranked, with equal weights."""
    order = Window.partitionBy("theme").orderBy(F.desc("exposure"), F.asc("company_id"))
    top = exposure.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.withColumn("weight", F.round(1.0 / F.count("*").over(Window.partitionBy("theme")), 8)).select("theme", "company_id", "rank", "weight", "exposure")


def basket_returns(baskets: DataFrame, returns: DataFrame) -> DataFrame:
    """Weighted return of each basket over the companies that have data; weights are made whole again."""
    both = baskets.join(returns.where("ret is not null"), "company_id")
    return both.groupBy("theme", "as_of", "months").agg((F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("ret"), F.count("*").alias("n"), F.min("entry_date").alias("start"), F.max("exit_date").alias("end"))


def universe_return(returns: DataFrame) -> DataFrame:
    return returns.where("ret is not null").groupBy("as_of", "months").agg(F.avg("ret").alias("universe_ret"))


def sector_return(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """Mean over sectors of the mean return of a sector's companies."""
    by = returns.where("ret is not null").join(sectors, "company_id").groupBy("as_of", "months", "sector").agg(F.avg("ret").alias("r"))
    return by.groupBy("as_of", "months").agg(F.avg("r").alias("sector_ret"), F.count("*").alias("n_sectors"))


def coverage(prices: DataFrame, points: DataFrame) -> DataFrame:
    """Whether prices reach each window's end; over all rows, as the gate is on the table."""
    last = prices.agg(F.max("price_date").alias("last_price"))
    return points.withColumn("window_end", F.add_months("as_of", F.col("months"))).crossJoin(F.broadcast(last)).withColumn("covered", F.coalesce(F.col("last_price") >= F.col("window_end"), F.lit(False)))  # one row


def panel_statistics(excess: DataFrame, keys: list[str], least_points: int = 3) -> DataFrame:
    """Mean excess, hit rate and whether there are points enough for a claim."""
    return excess.where("excess is not null").groupBy(*keys).agg(F.avg("excess").alias("mean_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("hit_rate"), F.count("*").alias("n_points")).withColumn("claim", F.col("n_points") >= least_points)


def average_rank(value: str, keys: list[str]) -> Column:
    """1-based rank with ties at their mean."""
    order = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by group; null under two rows or where either side does not vary."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, keys)).withColumn("_y", average_rank(y, keys))
    s = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    vx, vy = F.col("n") * F.col("xx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("yy") - F.col("sy") * F.col("sy")
    return s.select(*keys, "n", F.when((F.col("n") >= 2) & (vx > 0) & (vy > 0), (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)).alias("rho"))


def score_projections(impacts: DataFrame, returns: DataFrame) -> DataFrame:
    """Direction hits of projected impacts (null where there is no return or none at all), and the trigger's hit rate on each row."""
    both = impacts.join(returns.select("company_id", "ret"), "company_id", "left")
    hit = F.when(F.col("ret").isNotNull() & (F.col("ret") != 0), (F.signum("ret") == F.col("direction")).cast("int"))
    return both.withColumn("hit", hit).withColumn("hit_rate", F.avg("hit").over(Window.partitionBy("trigger")))


def random_places(n_companies: int, n: int, seed: int = 42) -> list[int]:
    """Places, among the sorted ids of a universe, of the first n of its seeded shuffle."""
    places = list(range(n_companies))
    random.Random(seed).shuffle(places)
    return places[:n]


def random_baseline(companies: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(rank, company_id): the first n of a seeded shuffle of the sorted ids, of which the driver sees only the number."""
    placed = runtime.global_rank(companies.select("company_id").distinct(), ["company_id"], "place")
    chosen = random_places(placed.count(), n, seed)
    picks = companies.sparkSession.createDataFrame([(k, p) for k, p in enumerate(chosen)], "rank int, place long")
    return placed.join(F.broadcast(picks), "place").select("rank", "company_id")
