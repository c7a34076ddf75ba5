"""Validation of frozen themes against forward returns: baskets beside benchmarks, with coverage and caveats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.operators import market

UNIVERSE, SECTOR, RANDOM = "equal_weight_universe", "sector_equal_weight", "random_community_baseline"
BENCHMARKS = (UNIVERSE, SECTOR, RANDOM)
SNAPSHOT_CAVEAT = "single snapshot: illustrative only, no claim of excess return"
NO_SECTORS = "sector_equal_weight: no sector data available; used equal_weight_universe as fallback"
DEFERRED = "not yet implemented; deferred"


def benchmark_returns(returns: DataFrame, universe: DataFrame, names: tuple[str, ...] = BENCHMARKS, sample: int = 10, seed: int = 42) -> DataFrame:
    """(as_of, months, benchmark, benchmark_ret, benchmark_n, benchmark_caveat) of each point.

    ``universe``: company_id, sector. Sectors count alike, a company without one is of the sector 'unknown'; where none
    has one, all companies count alike and a caveat says so. A benchmark of another name has no return.
    """
    live = returns.where("ret IS NOT NULL").join(universe.select("company_id", "sector").distinct(), "company_id")
    whole = live.groupBy("as_of", "months").agg(F.avg("ret").alias("r"), F.count("*").alias("n"))
    points = returns.select("as_of", "months").distinct()
    has_sectors = bool(universe.where("sector IS NOT NULL AND sector != ''").limit(1).count())
    out = None
    for name in names:
        caveat = F.lit(None).cast("string")
        if name == UNIVERSE:
            rows = whole
        elif name == SECTOR and not has_sectors:
            rows, caveat = whole, F.lit(NO_SECTORS)
        elif name == SECTOR:
            sector = F.coalesce(F.when(F.col("sector").cast("string") != "", F.col("sector").cast("string")), F.lit("unknown"))
            by = live.groupBy("as_of", "months", sector.alias("s")).agg(F.avg("ret").alias("m"), F.count("*").alias("k"))
            rows = by.groupBy("as_of", "months").agg(F.avg("m").alias("r"), F.sum("k").alias("n"))
        elif name == RANDOM:
            chosen = market.random_baseline(universe, sample, seed)
            rows = live.join(F.broadcast(chosen.select("company_id")), "company_id").groupBy("as_of", "months").agg(F.avg("ret").alias("r"), F.count("*").alias("n"))
        else:
            rows, caveat = points.withColumn("r", F.lit(None).cast("double")).withColumn("n", F.lit(0).cast("long")), F.lit(f"{name}: {DEFERRED}")
        rows = points.join(rows, ["as_of", "months"], "left").select("as_of", "months", F.lit(name).alias("benchmark"), F.col("r").alias("benchmark_ret"), F.coalesce("n", F.lit(0)).alias("benchmark_n"), caveat.alias("benchmark_caveat"))
        out = rows if out is None else out.unionByName(rows)
    return out


def blocked_windows(prices: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows that prices do not reach: as_of, months, required_end."""
    return market.coverage(prices, windows).where("NOT covered").select("as_of", "months", F.col("window_end").alias("required_end"))


def validate_snapshot(exposure: DataFrame, prices: DataFrame, windows: DataFrame, universe: DataFrame, tie: list[str], top_n: int = 5, names: tuple[str, ...] = BENCHMARKS, seed: int = 42) -> DataFrame:
    """Each theme's basket beside each benchmark over each window that prices reach; one frozen snapshot, never a claim.

    ``exposure``: theme, company_id, exposure; ``windows``: as_of, months. Windows out of reach are left out and named
    in the caveats. Without a basket return, or one of the benchmark, there is no excess.
    """
    seen = market.coverage(prices, windows)
    live = seen.where("covered").select("as_of", "months")
    blocked = ", ".join(f"{r['months']}M" for r in seen.where("NOT covered").orderBy("months").collect())  # a short list
    returns = market.forward_returns(prices, live, tie)
    baskets = market.top_baskets(exposure, top_n)
    rows = market.basket_returns(baskets, returns)
    sizes = baskets.groupBy("theme").agg(F.count("*").alias("company_count"))
    grid = sizes.join(F.broadcast(live)).join(rows, ["theme", "as_of", "months"], "left")  # a row for each theme and window is what is asked for
    both = grid.join(F.broadcast(benchmark_returns(returns, universe, names, top_n, seed)), ["as_of", "months"], "left")
    caveats = F.concat_ws("; ", F.lit(SNAPSHOT_CAVEAT), "benchmark_caveat", F.lit(f"windows {blocked} had insufficient forward coverage and were skipped" if blocked else None).cast("string"))
    return both.select(
        "theme", "as_of", F.concat(F.col("months").cast("string"), F.lit("M")).alias("forward_window"), "company_count", F.coalesce("n", F.lit(0)).alias("sample_size"), F.col("start").alias("start_date"), F.col("end").alias("end_date"),
        "benchmark", F.col("ret").alias("basket_ret"), "benchmark_ret", (F.col("ret") - F.col("benchmark_ret")).alias("excess"), F.lit(True).alias("illustrative"), F.lit(False).alias("claim_supported"), caveats.alias("caveats"),
    )


def fixed_basket_walk(exposure: DataFrame, prices: DataFrame, points: DataFrame, universe: DataFrame, tie: list[str], top_n: int = 5, baseline: str = UNIVERSE, least_points: int = 3, seed: int = 42) -> DataFrame:
    """One basket of all themes' companies, alike in weight, entered at each point: its return, the baseline's, excess.

    Points that prices do not reach are skipped, with the reason, and never shrunk. Each row has the panel's number of
    valid points, mean excess, hit rate and whether they are enough for a claim.
    """
    seen = market.coverage(prices, points)
    live = seen.where("covered").select("as_of", "months")
    returns = market.forward_returns(prices, live, tie)
    companies = market.top_baskets(exposure, top_n).select("company_id").distinct()
    mine = returns.where("ret IS NOT NULL").join(companies, "company_id", "left_semi").groupBy("as_of", "months").agg(F.avg("ret").alias("basket_ret"))
    base = benchmark_returns(returns, universe, (baseline,), top_n, seed).select("as_of", "months", F.col("benchmark_ret").alias("baseline_ret"))
    rows = seen.join(mine, ["as_of", "months"], "left").join(base, ["as_of", "months"], "left")
    # what is left of equal returns by the order of sums is no excess
    rows = rows.withColumn("excess", F.round(F.col("basket_ret") - F.col("baseline_ret"), 12)).withColumn("skipped_reason", F.when(~F.col("covered"), F.concat(F.lit("insufficient_forward_coverage: prices must reach "), F.col("window_end").cast("string"))))
    panel = Window.partitionBy()  # a row for each point
    n = F.count("excess").over(panel)
    return rows.select("as_of", "months", "basket_ret", "baseline_ret", "excess", "skipped_reason", n.alias("n_points"), F.avg("excess").over(panel).alias("mean_excess"), F.avg((F.col("excess") > 0).cast("double")).over(panel).alias("hit_rate"), (n >= least_points).alias("claim_supported"))
