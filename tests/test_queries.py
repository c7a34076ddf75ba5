"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import differences  # noqa: E402

from narrascope.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(spark, SF, name, registry.queries()[name], registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0
