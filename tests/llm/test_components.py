import random

import pytest

from narrascope.operators import components


@pytest.mark.parametrize("few", [0, 10**6])
def test_smallest_reachable(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (-5, 100)] + [(1000, 1000 + r.randint(1, 300)) for _ in range(80)] + [(2000 + r.randint(0, 60), 2000 + r.randint(0, 60)) for _ in range(50)]
    r.shuffle(edges)
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
