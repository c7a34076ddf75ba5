"""Connected components: few edges in one task, many by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope import runtime

#: Edges that one task may take; beyond it the work is shared out.
FEW_EDGES = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest node of each component, of at most FEW_EDGES edges."""
    root: dict = {}
    kind = None

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Staged (node, component) for every node of ``edges`` (u, v: numbers or strings alike): the smallest node it reaches.

    Every round halves long chains or better; each is written to the shared folder, so lineage stays short. Hubs
    are no burden: minima are taken before the shuffle and joined back. Loops are left out.
    """
    kind = edges.schema["u"].dataType.simpleString()
    now = runtime.staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.count() <= FEW_EDGES:
        runtime.ship(edges.sparkSession)
        return runtime.staged(now.coalesce(1).mapInArrow(_union_find, f"node {kind}, component {kind}"), "components")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = runtime.staged(small, "stars")
        several = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        deeper = now.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if not several.unionByName(deeper).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return runtime.staged(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
