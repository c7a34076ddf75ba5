import hashlib
import math

import numpy as np

from narrascope.llm import centroids


def brute(rows, k=16, rounds=3, width=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            v = [float(np.float32(x)) for x in v]
            kept.append((i, v, [int(x) * 64 if abs(x) > 2**55 else math.floor(64 * x) for x in v]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    held = [q for _, _, q in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min((apart(q, c), j) for j, c in enumerate(held))
    for _ in range(rounds):
        at = [near(q)[1] for _, _, q in kept]
        held = [[sum(x) // len(own) for x in zip(*own)] if (own := [q for (_, _, q), a in zip(kept, at) if a == j]) else c for j, c in enumerate(held)]
    last = [near(q) for _, _, q in kept]
    own = {}
    for d, j in last:
        own[j] = own.get(j, 0) + d
    fits = lambda x: x if x < 2**63 else None
    return [(i, j, fits(d), fits(own[j]), fits(sum(own.values())), sha(",".join(map(str, held[j])))) for (i, _, _), (d, j) in zip(kept, last)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cluster string").repartition(4)
    return sorted(map(tuple, centroids.cluster(df, **more).collect()), key=str)


def test_against_brute_force(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 400)]  # a third of all are copies
    rows += [(7, rows[9][1]), (None, rows[3][1]), (2**60 + 1, rows[4][1])]
    rows += [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65), (904, [None] + [0.0] * 63), (905, [math.nan] + [0.0] * 63), (906, [-math.inf] + [0.0] * 63)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_ties_and_empty_centroids(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(60)]  # 16 centroids on two places: fourteen stay empty
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_large_components_are_exact(spark):
    rows = [(i, [float(10**7 * (i % 5) + i)] * 64) for i in range(40)] + [(50 + i, [1e9 * i] * 64) for i in range(5)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    rows += [(99, [3e38] * 64), (100, [-3e38] * 64)]
    got = run(spark, rows)
    assert got == sorted(brute(rows), key=str) and {r[4] for r in got} == {None}


def test_few_or_no_vectors(spark):
    assert run(spark, []) == []
    rows = [(i, [i / 7] * 64) for i in range(3)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
