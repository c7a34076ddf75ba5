"""As-of lookups, rolling regimes, searches by seed bits and by label against plain versions."""

import datetime as dt
import random
from fractions import Fraction

from pyspark.sql import functions as F

from narrascope.operators import anchors, asof, graph


def day(k):
    return None if k is None else dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_asof_over_many_ranges(spark):
    draw = random.Random(1)
    seen = [("hot", day(draw.randrange(300)), float(k)) for k in range(900)] + [(f"k{k % 40}", day(draw.randrange(300)), float(k)) for k in range(300)]
    seen += [("hot", None, 1.0), ("hot", day(3), None), (None, day(4), 5.0)]
    asked = [("hot", day(draw.randrange(-5, 320)), f"a{k}") for k in range(700)] + [(f"k{draw.randrange(45)}", day(draw.randrange(320)), f"b{k}") for k in range(300)]
    asked += [("hot", day(10), "twin"), ("hot", day(10), "twin"), ("hot", None, "no day"), (None, day(9), "no key"), ("nobody", day(9), "none")]
    left = spark.createDataFrame(seen, "key string, day date, value double").repartition(3)
    right = spark.createDataFrame(asked, "key string, cut date, label string").repartition(2)
    got = asof.asof(left, right, "key", "day", "value", "cut").collect()

    def last(key, cut):
        fit = [(d, v) for k, d, v in seen if k == key and None not in (d, v, cut, key) and d <= cut]
        return max(fit) if fit else (None, None)

    plain = [(k, c, x, *last(k, c)) for k, c, x in asked if k is not None]
    assert sorted((tuple(r) for r in got if r.key is not None), key=str) == sorted(plain, key=str)
    assert len(got) == len(asked)
    assert asof.asof(left.limit(0), right, "key", "day", "value", "cut").where("day IS NOT NULL").count() == 0
    assert asof.asof(left, right.limit(0), "key", "day", "value", "cut").count() == 0


def test_signals_at_points(spark):
    s = spark.createDataFrame([("a", day(0), 10.0), ("a", day(100), 10.05), ("a", day(200), 12.0), ("b", day(50), 1.0)], "key string, day date, value double")
    points = spark.createDataFrame([(k, day(d)) for k in "ab" for d in (20, 140, 240, 84)], "key string, as_of date")
    got = {(r.key, (r.as_of - day(0)).days): (r.value, r.prior, r.trend) for r in asof.signals_at(s, points, "key", "day", "value").collect()}
    assert got == {("a", 140): (10.05, 10.0, "flat"), ("a", 240): (12.0, 10.05, "rising"), ("a", 84): (10.0, 10.0, "flat"), ("b", 140): (1.0, 1.0, "flat"), ("b", 240): (1.0, 1.0, "flat")}


def test_rolling_regimes(spark):
    draw = random.Random(2)
    rows = [("hot", day(d), draw.randrange(1000) / 8) for d in range(200) if d % 7] + [("flat", day(d), 2.5) for d in range(9)] + [("lone", day(5), 1.0), ("gap", day(0), 1.0), ("gap", day(90), 3.0), ("gap", None, 3.0), ("gap", day(91), None)]
    got = {(r.key, r.day): (r.n, r.z, r.regime) for r in asof.rolling_regimes(spark.createDataFrame(rows, "key string, day date, value double").repartition(4), "key", "day", "value", 20).collect()}
    kept = [r for r in rows if None not in r]
    assert len(got) == len(kept)
    for key, at, value in kept:
        own = [Fraction(v) for k, d, v in kept if k == key and 0 <= (at - d).days < 20]
        mean = sum(own) / len(own)
        var = sum((x - mean) ** 2 for x in own) / len(own)
        z = float(Fraction(value) - mean) / float(var) ** 0.5 if len(own) > 1 and var else None
        n, mine, label = got[key, at]
        assert n == len(own) and (mine is None) == (z is None) and (z is None or abs(mine - z) < 2e-6)
        assert label == ("normal" if z is None or abs(z) <= 1 else "elevated" if z > 1 else "depressed")


def test_search_from_many_seeds(spark):
    draw = random.Random(3)
    edges = [(f"n{draw.randrange(120)}", f"n{draw.randrange(120)}") for _ in range(150)] + [("n0", "n0")] + [("hub", f"n{k}") for k in range(0, 120, 9)]
    seeds = [(f"s{k:03d}", f"n{draw.randrange(130)}") for k in range(140)] + [("s000", "n1"), ("s000", "n1")]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for seed in {s for s, _ in seeds}:
        dist = {n: 0 for s, n in seeds if s == seed}
        front = list(dist)
        for hop in range(1, 5):
            front = sorted({y for x in front for y in near.get(x, ()) if y not in dist})
            dist |= dict.fromkeys(front, hop)
        want |= {(seed, n, d) for n, d in dist.items()}
    found = graph.bfs(spark.createDataFrame(seeds, "seed string, node string"), spark.createDataFrame(edges, "src string, dst string"), 4).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_labels_by_their_parts(spark):
    draw = random.Random(4)
    labels = {f"n{k:03d}": "".join(draw.choice("abAB é") for _ in range(draw.randrange(1, 9))) for k in range(300)} | {"gone": None, "long": "x" * 5000 + "needle"}
    nodes = spark.createDataFrame(list(labels.items()), "node_id string, label string")
    wanted = ["a", "ab", "abé", "BAB ", "needle", "zzz", "", "n001", labels["n002"].upper(), "xxxx"]
    w = spark.createDataFrame([(x,) for x in wanted], "wanted string")
    index = anchors.label_index(nodes)
    got = {}
    for r in anchors.containing(w, index).collect():
        got.setdefault(r.wanted, set()).add(r.node_id)
    fits = {x: {n for n, t in labels.items() if t and x and x.lower() in t.lower()} for x in wanted}
    assert got == {x: s for x, s in fits.items() if s}
    some = {r.wanted: (r.n, r.node_ids) for r in anchors.candidates(w, index, most=3).collect()}
    assert some == {x: (len(s), sorted(s)[:3]) for x, s in fits.items() if s}
    how = {r.wanted: (r.node_id, r.how) for r in anchors.resolve(nodes, w, index).collect()}
    assert how["needle"] == ("long", "part") and how["n001"] == ("n001", "id") and how["zzz"] == (None, "none") and how[""] == (None, "none") and how[labels["n002"].upper()][1] == "label"
    plan = anchors.resolve(nodes, w, index)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
