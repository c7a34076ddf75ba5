import os

import pytest
from pyspark.sql import functions as F

from narrascope.operators import digests
from narrascope.sources import ingest


def files(root):
    return {os.path.join(d, n) for d, _, names in os.walk(f"{root}/rows") for n in names if n.endswith(".parquet")}


def test_a_batch_touches_its_companies_alone(spark, tmp_path):
    root = str(tmp_path / "facts")
    rows = lambda cs, v: spark.createDataFrame([(c, k, v + k) for c in cs for k in range(5)], "company_id string, period int, value int")
    assert ingest.ingest(rows(["a", "b", "c"], 0), root, "first")
    before = files(root)
    assert ingest.ingest(rows(["b", "d"], 100), root, "second", files_each=3)
    after = files(root)
    untouched = {f for f in before if "company_id=b" not in f}
    assert untouched <= after and not {f for f in before if "company_id=b" in f} & after
    got = {(r.company_id, r.period): r.value for r in ingest.read_table(spark, root).collect()}
    assert got == {(c, k): (100 if c in "bd" else 0) + k for c in "abcd" for k in range(5)}
    assert not ingest.ingest(rows(["b", "d"], 100), root, "second") and files(root) == after
    with pytest.raises(ValueError):
        ingest.ingest(rows(["b"], 7), root, "second")
    assert {(r.batch, r.n_rows, r.n_companies) for r in ingest.committed(spark, root).collect()} == {("first", 15, 3), ("second", 10, 2)}


def test_changes_are_found_in_their_buckets(spark):
    old = spark.createDataFrame([(k, f"v{k}", None if k % 3 else 1.5) for k in range(400)] + [(None, "no key", 0.0), (7, "twin", None)], "key long, said string, x double").repartition(4)
    frozen = digests.bucket_digests(old, ["key"], 64)
    assert digests.changed_buckets(frozen, digests.bucket_digests(old.coalesce(1), ["key"], 64)).count() == 0
    new = old.where("key IS NULL OR key NOT IN (5, 9)").withColumn("said", F.when(F.col("key") == 11, "other").otherwise(F.col("said"))).unionByName(spark.createDataFrame([(900, "new", None), (7, "twin", None)], old.schema))
    assert 0 < digests.changed_buckets(frozen, digests.bucket_digests(new, ["key"], 64)).count() <= 5
    got = {(r.key, r.change) for r in digests.changed_keys(old, new, ["key"], frozen, 64).collect()}
    assert got == {(5, "removed"), (9, "removed"), (11, "changed"), (900, "added"), (7, "changed")}
    assert digests.changed_keys(old, old, ["key"]).count() == 0 and digests.changed_keys(old.limit(0), old.limit(0), ["key"]).count() == 0
    gone = {(r.key, r.change) for r in digests.changed_keys(old, old.where("key IS NOT NULL"), ["key"], buckets=16).collect()}
    assert gone == {(None, "removed")}
