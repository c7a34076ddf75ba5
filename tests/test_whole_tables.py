"""Queries without SQL take all rows of their tables."""

from narrascope.operators import market
from narrascope.plans import registry


def test_louvain_takes_old_and_small_lines(spark, tmp_path):
    spark.sql("SELECT 1L AS l_suppkey, 1L AS l_partkey, 2.0D AS l_quantity, TIMESTAMP_NTZ '1995-01-02 00:00:00' AS l_shipdate UNION ALL SELECT 2L, 2L, 50.0D, TIMESTAMP_NTZ '2001-10-01 00:00:00'").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.community for r in registry.queries()["louvain_communities"](spark, str(tmp_path)).collect()}
    assert set(got) == {"s1", "p1", "s2", "p2"} and got["s1"] == got["p1"] != got["s2"] == got["p2"]


def test_random_baseline_draws_from_all_suppliers(spark, tmp_path):
    spark.range(1, 301).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [r.company_id for r in registry.queries()["random_baseline"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [k + 1 for k in market.random_places(300, 10)] and max(got) > 100
