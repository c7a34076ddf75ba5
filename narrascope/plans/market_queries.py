"""Queries on prices, signals, baskets and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.operators import asof, market, pit
from narrascope.plans import mapping as m

AS_OF = "1998-01-01"


def pit_filter(spark, d):
    return m.documents(spark, d).where(pit.known_at(F.col("available_at"), "2024-06-30")).select("doc_id", "available_at")


def pit_null_policies(spark, d):
    rows = m.documents(spark, d).withColumn("day", F.when(F.col("doc_id") % 10 != 0, F.col("available_at")))
    n = lambda policy: F.sum(pit.known_at(F.col("day"), "2024-06-30", policy).cast("long"))
    return rows.groupBy("lang").agg(n("closed").alias("n_closed"), n("open").alias("n_open"))


def asof_latest_signal(spark, d):
    return pit.latest_signal(m.series(spark, d), "event_type", "obs_date", "value", "2024-01-28", lag_days=5, back_days=10)


def regime_zscore(spark, d):
    return pit.zscore_regime(m.series(spark, d), "event_type", "obs_date", "value", "2024-01-25", 20)


def _user_series(spark, d):
    """Each user's daily sums."""
    rows = m.table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("obs_date"))
    return runtime.staged(rows.agg(F.round(F.sum(F.col("value").cast("decimal(18,6)")), 6).cast("double").alias("value")), "user-series")


def asof_signals(spark, d):
    """Of every user on every day that any user has: the last sum released by then, the one before, and the trend."""
    s = _user_series(spark, d)
    points = s.select("user_id").distinct().join(F.broadcast(s.select(F.col("obs_date").alias("as_of")).distinct()))  # a user for each day of the panel
    return asof.signals_at(s, points, "user_id", "obs_date", "value", lag_days=2, back_days=5)


def rolling_regimes(spark, d):
    return asof.rolling_regimes(_user_series(spark, d), "user_id", "obs_date", "value", 9).select("user_id", "obs_date", "n", "z", "regime")


def _returns(spark, d, rows):
    return market.forward_returns(m.prices(spark, d), m.points(spark, rows), m.PRICE_TIE)


def forward_return(spark, d):
    r = _returns(spark, d, [(AS_OF, 3)])
    return r.select("company_id", "entry_date", "exit_date", F.round("ret", 6).alias("ret"))


def _exposure(spark, d):
    t = m.trades(spark, d).where(pit.known_at(F.col("day"), AS_OF))
    return t.groupBy(F.col("p_brand").alias("theme"), F.col("l_suppkey").alias("company_id")).agg(F.round(F.sum("l_discount"), 4).alias("exposure"))


def basket_topn(spark, d):
    return market.top_baskets(_exposure(spark, d), 5)


def basket_vs_universe(spark, d):
    r = runtime.staged(_returns(spark, d, [(AS_OF, 3)]), "returns")
    b = market.basket_returns(market.top_baskets(_exposure(spark, d), 5), r)
    out = b.join(F.broadcast(market.universe_return(r)), ["as_of", "months"])
    return out.select("theme", "n", F.round("ret", 6).alias("basket_ret"), F.round("universe_ret", 6).alias("universe_ret"), F.round(F.col("ret") - F.col("universe_ret"), 6).alias("excess"))


def _sectors(spark, d):
    return m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_nationkey").alias("sector"))


def sector_benchmark(spark, d):
    s = market.sector_return(_returns(spark, d, [(AS_OF, 3), (AS_OF, 6)]), _sectors(spark, d))
    return s.select("as_of", "months", F.round("sector_ret", 6).alias("sector_ret"), "n_sectors")


POINTS = [("1996-01-01", 3), ("1997-01-01", 3), ("1998-01-01", 3), ("1999-01-01", 3), ("2001-10-01", 3)]


def walk_forward_panel(spark, d):
    """Every point uses what was known then; points that prices do not reach are left out."""
    points = m.points(spark, POINTS)
    prices = m.prices(spark, d)
    live = runtime.staged(market.coverage(prices, points).where("covered").select("as_of", "months"), "points")
    t = m.trades(spark, d).select("day", "l_discount", F.col("p_brand").alias("brand"), F.col("l_suppkey").alias("company_id"))
    e = market.sums_at_points(t, live, "day", ["brand", "company_id"], "l_discount", "exposure").withColumn("exposure", F.round("exposure", 4))
    e = e.withColumn("theme", F.concat_ws("|", F.col("as_of").cast("string"), "brand"))
    baskets = market.top_baskets(e, 5).withColumn("as_of", F.to_date(F.split("theme", r"\|")[0])).withColumn("brand", F.split("theme", r"\|")[1])
    r = market.forward_returns(prices, live, m.PRICE_TIE)
    b = baskets.join(r.where("ret is not null"), ["as_of", "company_id"]).groupBy("as_of", "months", "brand").agg((F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("ret"))
    x = b.join(F.broadcast(market.universe_return(r)), ["as_of", "months"]).withColumn("excess", F.round(F.col("ret") - F.col("universe_ret"), 9))
    s = market.panel_statistics(x, ["brand"])
    return s.select("brand", F.round("mean_excess", 6).alias("mean_excess"), F.round("hit_rate", 6).alias("hit_rate"), "n_points", "claim")


def coverage_gate(spark, d):
    return market.coverage(m.prices(spark, d), m.points(spark, [*POINTS, ("2001-11-01", 1), ("2001-08-01", 3)])).select("as_of", "months", "window_end", "covered")


def restatement_dedup(spark, d):
    return pit.first_of(m.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey", F.to_date("o_orderdate").alias("filed"))


def derived_ratio(spark, d):
    o = m.table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    side = lambda status, name: o.where(F.col("o_orderstatus") == status).groupBy("o_custkey", "year").agg(F.sum("o_totalprice").alias(name))
    return side("F", "num").join(side("O", "den"), ["o_custkey", "year"]).where("den != 0").select("o_custkey", "year", F.round(F.col("num") / F.col("den"), 6).alias("ratio"))


def spearman_by_group(spark, d):
    r = _returns(spark, d, [(AS_OF, 3)]).select("company_id", "ret")
    e = _exposure(spark, d).join(r, "company_id").withColumn("abs_ret", F.round(F.abs("ret"), 9))
    s = market.spearman(e, ["theme"], "exposure", "abs_ret")
    return s.select("theme", "n", F.round("rho", 6).alias("rho"))


def hit_rate(spark, d):
    r = _returns(spark, d, [(AS_OF, 3)])
    impacts = _exposure(spark, d).select(F.col("theme").alias("trigger"), "company_id", F.when(F.col("company_id") % 2 == 0, 1).otherwise(-1).alias("direction"))
    s = market.score_projections(impacts, r)
    return s.select("trigger", "company_id", "direction", "hit", F.round("hit_rate", 6).alias("hit_rate"))


def random_baseline(spark, d):
    return market.random_baseline(m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id")), 10)


RET = f"""
rets AS (SELECT company_id, entry_date, exit_date, exit / entry - 1 AS ret FROM (
  SELECT company_id,
    first(price_date ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) AS entry_date,
    first(close ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) AS entry,
    last(price_date ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) AS exit_date,
    last(close ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) AS exit
  FROM {m.PRICES_SQL} p WHERE price_date > DATE '{AS_OF}' AND price_date <= DATE '{AS_OF}' + INTERVAL 3 MONTH GROUP BY company_id))"""
EXPO = f"expo AS (SELECT p_brand AS theme, l_suppkey AS company_id, round(sum(l_discount), 4) AS exposure FROM {m.TRADES_SQL} t WHERE day <= DATE '{AS_OF}' GROUP BY ALL)"
TOP = "top AS (SELECT *, round(1.0 / count(*) OVER (PARTITION BY theme), 8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY exposure DESC, company_id) AS rank FROM expo) WHERE rank <= 5)"
POINTS_SQL = ", ".join(f"(DATE '{a}', {n})" for a, n in POINTS)

SQL = {
    "pit_filter": f"SELECT doc_id, available_at FROM {m.DOCS_SQL} d WHERE available_at <= DATE '2024-06-30'",
    "pit_null_policies": f"SELECT lang, sum((day IS NOT NULL AND day <= DATE '2024-06-30')::BIGINT)::BIGINT AS n_closed, sum((day IS NULL OR day <= DATE '2024-06-30')::BIGINT)::BIGINT AS n_open FROM (SELECT lang, CASE WHEN doc_id % 10 <> 0 THEN available_at END AS day FROM {m.DOCS_SQL} d) GROUP BY lang",
    "asof_latest_signal": f"""WITH s AS (SELECT * FROM {m.SERIES_SQL} x WHERE obs_date <= DATE '2024-01-28' - 5),
 n AS (SELECT event_type, max(obs_date) AS obs_date, max_by(value, obs_date) AS value FROM s GROUP BY 1),
 b AS (SELECT n.event_type, max_by(s.value, s.obs_date) AS prior FROM n JOIN s ON s.event_type = n.event_type AND s.obs_date <= n.obs_date - 10 GROUP BY 1)
SELECT event_type, obs_date, value, coalesce(prior, value) AS prior, CASE WHEN value - coalesce(prior, value) > band THEN 'rising' WHEN coalesce(prior, value) - value > band THEN 'falling' ELSE 'flat' END AS trend
FROM (SELECT *, CASE WHEN coalesce(prior, value) = 0 THEN 0.001 ELSE abs(coalesce(prior, value)) * 0.01 END AS band FROM n LEFT JOIN b USING (event_type))""",
    "asof_signals": """WITH s AS (SELECT user_id, ts::DATE AS obs_date, sum(value::DECIMAL(18,6))::DOUBLE AS value FROM events GROUP BY ALL),
 p AS (SELECT user_id, as_of, as_of - 2 AS cut FROM (SELECT DISTINCT user_id FROM s), (SELECT DISTINCT obs_date AS as_of FROM s)),
 n AS (SELECT p.user_id, as_of, s.obs_date, s.value, s.obs_date - 5 AS back FROM p ASOF JOIN s ON p.user_id = s.user_id AND p.cut >= s.obs_date),
 b AS (SELECT n.*, coalesce(s.value, n.value) AS prior FROM n ASOF LEFT JOIN s ON n.user_id = s.user_id AND n.back >= s.obs_date)
SELECT user_id, as_of, obs_date, value, prior, CASE WHEN value - prior > band THEN 'rising' WHEN prior - value > band THEN 'falling' ELSE 'flat' END AS trend FROM (SELECT *, CASE WHEN prior = 0 THEN 0.001 ELSE abs(prior) * 0.01 END AS band FROM b)""",
    "rolling_regimes": """WITH s AS (SELECT user_id, ts::DATE AS obs_date, sum(value::DECIMAL(18,6))::DECIMAL(18,6) AS v FROM events GROUP BY ALL),
 w AS (SELECT user_id, obs_date, v, count(*) OVER f AS n, sum(v) OVER f AS s, sum((v * v)::DECIMAL(30,12)) OVER f AS q FROM s WINDOW f AS (PARTITION BY user_id ORDER BY obs_date RANGE BETWEEN INTERVAL 8 DAYS PRECEDING AND CURRENT ROW)),
 z AS (SELECT user_id, obs_date, n, CASE WHEN n >= 2 AND n * q - (s * s)::DECIMAL(38,12) > 0 THEN (n * v - s)::DOUBLE / sqrt((n * q - (s * s)::DECIMAL(38,12))::DOUBLE) END AS z FROM w)
SELECT user_id, obs_date, n, round(z, 6) AS z, CASE WHEN z > 1 THEN 'elevated' WHEN z < -1 THEN 'depressed' ELSE 'normal' END AS regime FROM z""",
    "regime_zscore": f"""SELECT event_type, n, round(z, 6) AS z, CASE WHEN z >= 1 THEN 'high' WHEN z <= -1 THEN 'low' WHEN z IS NOT NULL THEN 'normal' END AS regime FROM (
 SELECT event_type, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(value) > 0 THEN (max_by(value, obs_date) - avg(value)) / stddev_pop(value) END AS z
 FROM {m.SERIES_SQL} x WHERE obs_date <= DATE '2024-01-25' AND obs_date > DATE '2024-01-25' - 20 GROUP BY 1)""",
    "forward_return": f"WITH {RET} SELECT company_id, entry_date, exit_date, round(ret, 6) AS ret FROM rets",
    "basket_topn": f"WITH {EXPO}, {TOP} SELECT theme, company_id, rank::INT AS rank, weight, exposure FROM top",
    "basket_vs_universe": f"WITH {RET}, {EXPO}, {TOP}, u AS (SELECT avg(ret) AS u FROM rets) SELECT theme, count(*) AS n, round(sum(weight * ret) / sum(weight), 6) AS basket_ret, round(any_value(u), 6) AS universe_ret, round(sum(weight * ret) / sum(weight) - any_value(u), 6) AS excess FROM top JOIN rets USING (company_id), u GROUP BY theme",
    "sector_benchmark": f"""WITH pts AS (SELECT * FROM (VALUES (DATE '{AS_OF}', 3), (DATE '{AS_OF}', 6)) v(as_of, months)),
 r AS (SELECT as_of, months, company_id, last(close ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) / first(close ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) - 1 AS ret
  FROM {m.PRICES_SQL} p JOIN pts ON price_date > as_of AND price_date <= as_of + to_months(months) GROUP BY ALL)
SELECT as_of, months, round(avg(r), 6) AS sector_ret, count(*) AS n_sectors FROM (SELECT as_of, months, s_nationkey, avg(ret) AS r FROM r JOIN supplier ON company_id = s_suppkey GROUP BY ALL) GROUP BY ALL""",
    "walk_forward_panel": f"""WITH pts AS (SELECT * FROM (VALUES {POINTS_SQL}) v(as_of, months) WHERE (SELECT max(l_shipdate::DATE) FROM lineitem) >= (as_of + to_months(months))),
 r AS (SELECT as_of, months, company_id, last(close ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) / first(close ORDER BY price_date, l_orderkey, l_linenumber, l_partkey, close) - 1 AS ret
  FROM {m.PRICES_SQL} p JOIN pts ON price_date > as_of AND price_date <= as_of + to_months(months) GROUP BY ALL),
 e AS (SELECT as_of, p_brand AS brand, l_suppkey AS company_id, round(sum(l_discount), 4) AS exposure FROM {m.TRADES_SQL} t JOIN pts ON day <= as_of GROUP BY ALL),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, brand ORDER BY exposure DESC, company_id) AS rank FROM e) WHERE rank <= 5),
 b AS (SELECT as_of, brand, avg(ret) AS ret FROM t JOIN r USING (as_of, company_id) GROUP BY ALL),
 x AS (SELECT brand, round(b.ret - u.ret, 9) AS excess FROM b JOIN (SELECT as_of, avg(ret) AS ret FROM r GROUP BY 1) u USING (as_of))
SELECT brand, round(avg(excess), 6) AS mean_excess, round(avg((excess > 0)::INT), 6) AS hit_rate, count(*) AS n_points, count(*) >= 3 AS claim FROM x GROUP BY brand""",
    "coverage_gate": f"SELECT as_of, months, (as_of + to_months(months))::DATE AS window_end, (SELECT max(l_shipdate::DATE) FROM lineitem) >= (as_of + to_months(months)) AS covered FROM (VALUES {POINTS_SQL}, (DATE '2001-11-01', 1), (DATE '2001-08-01', 3)) v(as_of, months)",
    "restatement_dedup": "SELECT o_custkey, o_orderstatus, o_orderkey, o_orderdate::DATE AS filed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1",
    "derived_ratio": "SELECT o_custkey, year, round(num / den, 6) AS ratio FROM (SELECT o_custkey, year(o_orderdate)::INT AS year, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS num, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS den FROM orders GROUP BY ALL) WHERE num IS NOT NULL AND den <> 0",
    "spearman_by_group": f"""WITH {RET}, {EXPO}, e AS (SELECT theme, exposure AS x, round(abs(ret), 9) AS y FROM expo JOIN rets USING (company_id)),
 k AS (SELECT theme, rank() OVER (PARTITION BY theme ORDER BY x) + (count(*) OVER (PARTITION BY theme, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY theme ORDER BY y) + (count(*) OVER (PARTITION BY theme, y) - 1) / 2.0 AS ry FROM e)
SELECT theme, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY theme""",
    "hit_rate": f"""WITH {RET}, {EXPO}, h AS (SELECT theme AS trigger, company_id, CASE WHEN company_id % 2 = 0 THEN 1 ELSE -1 END AS direction, ret FROM expo LEFT JOIN rets USING (company_id)),
 g AS (SELECT *, CASE WHEN ret IS NOT NULL AND ret <> 0 THEN (sign(ret) = direction)::INT END AS hit FROM h)
SELECT trigger, company_id, direction, hit, round(avg(hit) OVER (PARTITION BY trigger), 6) AS hit_rate FROM g""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "random_baseline"]}
