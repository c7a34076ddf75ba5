"""Plain Lloyd clustering of integer vectors: exact, with the same result on any number of machines.

Vectors are quantised to integers, centroids are broadcast, each batch takes its squared differences to every centroid in
NumPy, and the nearest wins (the lower number among equals). A task adds up its vectors by cluster; the sums meet in a
``groupBy`` of k x width x limbs rows a task, which is all that is shuffled or comes to the driver. A sum travels as
limbs of 32 bits, so that it is exact whatever its size.

Kept are vectors of exactly ``width`` components, none null and none without end or no number; others, and null or
empty vectors, get no row. Rows that repeat an id, or a vector, are points of their own; equal ids stand among the first
centroids in order of their components; a null id enters the digest as nothing. With fewer points than k there are as
many centroids; without any the result is empty. Components beyond 2**26 are worked out in whole Python numbers; a
distance (or a sum of distances) that no 64 bits hold is null. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import runtime

#: Beyond this a squared distance of 64 components may pass 63 bits.
EXACT = 1 << 26
LIMB = 32
LONGEST = (1 << 63) - 1


def whole(width: int, name: str = "embedding") -> Column:
    """True for vectors that take part."""
    c = F.col(name)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return c.isNotNull() & (F.size(c) == width) & ~F.exists(c, lambda x: bad(x.cast("double")))


def quantise(vectors: np.ndarray, scale: int = 64) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where a component is too large for them."""
    scaled = np.floor(vectors * scale)
    if not scaled.size or (np.abs(scaled) <= EXACT).all():
        return scaled.astype(np.int64)
    return np.array([[int(x) * scale if abs(x) >= 2.0**60 else math.floor(x * scale) for x in v] for v in vectors.tolist()], dtype=object)


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each point, the lowest of equals, and its squared distance."""
    exact = points.dtype == object or any(abs(x) > EXACT for c in centroids for x in c)
    held = points.astype(object) if exact else points
    apart = np.empty((len(points), len(centroids)), dtype=object if exact else np.int64)
    for k, c in enumerate(centroids):
        gap = held - np.array(c, dtype=apart.dtype)
        apart[:, k] = (gap * gap).sum(axis=1)
    at = apart.argmin(axis=1)
    return at, apart[np.arange(len(points)), at]


def _limbs(value: int) -> list[tuple[int, int]]:
    """(limb, part) of an integer: value = sum of part << (LIMB * limb), all parts of its sign."""
    sign, value, out, k = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        out.append((k, sign * (value & ((1 << LIMB) - 1))))
        value, k = value >> LIMB, k + 1
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, width)


def _sums(kept: DataFrame, centroids: list[list[int]], scale: int) -> dict[tuple[int, int], int]:
    """(cluster, component) -> sum over the cluster's vectors; component -1 counts them. At most k * (width + 1) entries."""
    held, width = kept.sparkSession.sparkContext.broadcast(centroids), len(centroids[0])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            points = quantise(_matrix(batch["embedding"], width), scale)
            at, _ = nearest(points, held.value)
            for k in np.unique(at).tolist():
                own = points[at == k]
                for j, x in enumerate([len(own), *own.sum(axis=0).tolist()], -1):
                    total[k, j] = total.get((k, j), 0) + int(x)
        rows = [(k, j, limb, part) for (k, j), x in total.items() for limb, part in _limbs(x)]
        yield pd.DataFrame(rows, columns=["cluster", "component", "limb", "part"])

    parts = kept.select("embedding").mapInPandas(add, "cluster int, component int, limb int, part long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum("part").alias("part")).collect():
        at = (r["cluster"], r["component"])
        out[at] = out.get(at, 0) + (r["part"] << (LIMB * r["limb"]))
    return out


def first_centroids(kept: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``1:<id>``, in that order."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("_key"), "embedding").orderBy("_key", "embedding").limit(k).collect()
    return [quantise(np.array([r["embedding"]], dtype=np.float64), scale)[0].tolist() for r in rows]


def lloyd(kept: DataFrame, centroids: list[list[int]], rounds: int, scale: int) -> list[list[int]]:
    """Centroids after ``rounds``; one that gets no vector stays where it is."""
    for _ in range(rounds if centroids else 0):
        sums = _sums(kept, centroids, scale)
        centroids = [[sums.get((k, j), 0) // sums[k, -1] for j in range(len(c))] if sums.get((k, -1)) else c for k, c in enumerate(centroids)]
    return centroids


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    runtime.ship(spark)
    kept = vectors.select("vec_id", "embedding").where(whole(width))
    schema = "_id string, cluster int, distance long"
    centroids = lloyd(kept, first_centroids(kept, k, scale), rounds, scale)
    held = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, apart = nearest(quantise(_matrix(batch["embedding"], width), scale), held.value)
            fits = pd.array([x if x <= LONGEST else None for x in apart.tolist()], dtype="Int64")
            yield pd.DataFrame({"_id": batch["_id"], "cluster": at, "distance": fits})

    given = kept.select(F.col("vec_id").cast("string").alias("_id"), "embedding")  # pandas has no nulls among integers
    placed = runtime.staged(given.mapInPandas(assign, schema), "clusters")
    # a row a cluster; a sum that has a null in it, or leaves 64 bits, is null
    total = lambda c: F.when(F.count("*") == F.count(c), F.sum(F.col(c).cast("decimal(38,0)")))
    own = placed.groupBy("cluster").agg(total("distance").alias("_own")).collect()
    everything = sum(r["_own"] for r in own) if all(r["_own"] is not None for r in own) else None
    fit = lambda x: int(x) if x is not None and x <= LONGEST else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(r["cluster"], fit(r["_own"]), fit(everything), digests[r["cluster"]]) for r in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = placed.join(F.broadcast(facts), "cluster")  # at most k rows
    kind = vectors.schema["vec_id"].dataType
    return named.select(F.col("_id").cast(kind).alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
