"""Merkle manifest of a dataset: one tree a source, a tree over the sources, and a proof for every row.

Leaves are the sha256 of a row's columns. The leaves of a source stand in order of their ids; while there are several
nodes, every ``FAN`` consecutive ones become their digest. The subroots, in order of source, become the root likewise.

Blocks of ``FAN ** BLOCK_LEVELS`` nodes are reduced by the cluster, round after round, until at most ``TOP_NODES`` are
left. The driver builds the tree above these and broadcasts, for each of them, its suffix path: the siblings from
there to the root. Executors then walk the blocks again from the top down, set the path of a block before that of its
members, and fold every row. What the driver holds is bounded by ``TOP_NODES``, whatever the number of rows or sources.

Nulls: a null column enters a leaf as ``-``; null ids come first in their source and are never tampered; a null source
is a source of its own, before all others. Rows that repeat an id are told apart by their leaf; equal rows are equal
leaves, each with a place of its own. Texts of any length are digested whole, as UTF-8. An empty table has no rows and
no root. Columns beyond the five are left out, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.joins import join_dealt

FAN = 16
#: Levels that a block takes in one round: 4,096 nodes, some 300 KB of digests in a group.
BLOCK_LEVELS = 3
#: Nodes that the driver takes: a suffix path is some 5 KB, so at most 10 MB are broadcast.
TOP_NODES = 2_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    value = c.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    fixed = [field(F.col(name)) for name in FIELDS[:-1]]
    return F.sha2(F.concat(*fixed, field(text)), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """tree (the source as a key that is never null and keeps its order), doc_id, leaf, changed (the leaf after tampering, else null)."""
    lowered = F.translate("text", UPPER, LOWER)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select(*FIELDS).select(tree.alias("tree"), "doc_id", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(lowered)).alias("changed"))


def every_fifth() -> Column:
    """Rows whose id, in decimal, has an unsigned crc32 that 5 divides."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _height(n: int) -> int:
    """Levels from n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, and what each level makes of them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def _siblings(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node in its run, level by level, digests joined."""
    left, right = [], []
    for nodes in levels[:-1]:
        run = place - place % FAN
        left.append("".join(nodes[run:place]))
        right.append("".join(nodes[place + 1 : run + FAN]))
        place //= FAN
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right):
        node = digest([a, node, b])
    return node


def place_in_tree(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with pos, the place in the tree from 0, and n, the nodes of the tree."""
    ranked = runtime.global_rank(runtime.staged(rows, "merkle-hashed"), ["tree", *order], "_rank")
    sizes = runtime.staged(ranked.groupBy("tree").agg(F.min("_rank").alias("_first"), F.count("*").alias("n")), "merkle-sizes")
    return join_dealt(ranked, sizes, "tree", "_rank").withColumn("pos", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def _block(levels: int) -> Column:
    return F.expr(f"pos div {FAN**levels}").alias("_block")


def reduce_blocks(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, pos, hash, n) one round up: each block of a tree becomes one node; a tree of one node stays as it is."""
    size = FAN**levels

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        n = int(batch["n"].iloc[0])
        top = _reduced(batch["hash"].tolist(), min(levels, _height(n)))[-1]
        return pd.DataFrame({"tree": [batch["tree"].iloc[0]], "pos": [int(batch["pos"].iloc[0]) // size], "hash": [top[0]], "n": [-(-n // size)]})

    return nodes.select("tree", "pos", "hash", "n").groupBy("tree", _block(levels)).applyInPandas(one, "tree string, pos long, hash string, n long")


def top_paths(nodes: list[tuple[str, int, str]], one_tree: bool) -> dict[tuple[str, int], tuple]:
    """Suffix path of each top node: left and right siblings up to the root, subroot, root. ``one_tree``: the nodes are of the tree over the sources."""
    trees: dict[str, list[str]] = {}
    for tree, _, node in sorted(nodes, key=lambda x: (x[0].encode(), x[1])):
        trees.setdefault(tree, []).append(node)
    built = {tree: _reduced(own, _height(len(own))) for tree, own in trees.items()}
    if one_tree:
        levels = built.get("", [[""]])
        return {("", i): (*_siblings(levels, i), None, levels[-1][0]) for i in range(len(levels[0]))}
    over = _reduced([levels[-1][0] for levels in built.values()], _height(len(built)))
    out = {}
    for k, (tree, levels) in enumerate(built.items()):
        above = _siblings(over, k)
        for i in range(len(levels[0])):
            left, right = _siblings(levels, i)
            out[tree, i] = (left + above[0], right + above[1], levels[-1][0], over[-1][0])
    return out


PATH = "left array<string>, right array<string>, subroot string, root string"


def _with_paths(nodes: DataFrame, above: DataFrame | dict, levels: int) -> DataFrame:
    """(tree, pos, hash, left, right, subroot, root) of all nodes, from the paths of the blocks that they make."""
    schema = f"tree string, pos long, hash string, {PATH}"

    def spread(batch: pd.DataFrame, path: tuple) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        own = _reduced(batch["hash"].tolist(), min(levels, _height(int(batch["n"].iloc[0]))))
        sides = [_siblings(own, i) for i in range(len(batch))]
        out = batch[["tree", "pos", "hash"]].copy()
        out["left"], out["right"] = [[*a, *path[0]] for a, _ in sides], [[*b, *path[1]] for _, b in sides]
        out["subroot"], out["root"] = path[2], path[3]
        return out

    keyed = nodes.select("tree", "pos", "hash", "n", _block(levels))
    if isinstance(above, dict):
        paths = nodes.sparkSession.sparkContext.broadcast(above)
        return keyed.groupBy("tree", "_block").applyInPandas(lambda b: spread(b, paths.value[b["tree"].iloc[0], int(b["_block"].iloc[0])]), schema)

    def both(batch: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        p = path.iloc[0]
        return spread(batch, (p["left"], p["right"], p["subroot"], p["root"]))

    return keyed.groupBy("tree", "_block").cogroup(above.withColumnRenamed("pos", "_block").groupBy("tree", "_block")).applyInPandas(both, schema)


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = BLOCK_LEVELS, most_top: int = TOP_NODES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``proof_sha256`` digests the siblings level by level; ``folded_root`` is folded from the row as it is after tampering
    (rows where ``tampered`` holds have their text's A-Z lower-cased) with the siblings of the tree as it was.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    rows = runtime.staged(place_in_tree(leaves(docs, every_fifth() if tampered is None else tampered), ["doc_id", "leaf"]), "merkle-leaves")
    # upwards: (nodes of a round, what joined them): blocks of a tree, or the subroots as one tree over all
    rounds: list[tuple[DataFrame, str]] = []
    nodes, one_tree = rows.withColumnRenamed("leaf", "hash"), False
    while True:
        rounds.append((nodes, "blocks"))
        nodes = runtime.staged(reduce_blocks(nodes, levels), "merkle-nodes")
        count, longest = nodes.agg(F.count("*"), F.max("n")).first()
        if count <= most_top:
            break
        if longest == 1 and not one_tree:  # more sources than the driver takes: their tree is reduced by the cluster too
            over = runtime.staged(runtime.global_rank(nodes.select("tree", "hash"), ["tree"], "pos"), "merkle-subroots")
            rounds.append((over, "sources"))
            nodes, one_tree = over.select(F.lit("").alias("tree"), "pos", "hash", F.lit(count).alias("n")), True
    top = [(r["tree"], r["pos"], r["hash"]) for r in nodes.select("tree", "pos", "hash").collect()]  # at most most_top
    above: DataFrame | dict = top_paths(top, one_tree)
    # downwards: each round's nodes get their paths from the blocks above them
    for nodes, kind in reversed(rounds[1:]):
        if kind == "blocks":
            above = runtime.staged(_with_paths(nodes, above, levels).drop("hash"), "merkle-paths")
        else:
            paths = above.select("pos", "left", "right", "root")
            above = runtime.staged(nodes.join(paths, "pos").select("tree", F.lit(0).cast("long").alias("pos"), "left", "right", F.col("hash").alias("subroot"), "root"), "merkle-paths")
    return _folded(rows, above, levels)


def _folded(rows: DataFrame, above: DataFrame | dict, levels: int) -> DataFrame:
    """Proofs and folds of the rows of each block, from the path of the block."""
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def finish(batch: pd.DataFrame, path: tuple) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        own = _reduced(batch["leaf"].tolist(), min(levels, _height(int(batch["n"].iloc[0]))))
        block, (left, right, subroot, root) = own[-1][0], path
        subroot = subroot or block
        # the way from the block to the root is the same for all whose fold comes out at the block's own digest
        beyond = fold(block, left, right)
        proofs, folds = [], []
        for i, (node, changed) in enumerate(zip(batch["leaf"], batch["changed"])):
            a, b = _siblings(own, i)
            proofs.append(digest([x for pair in zip([*a, *left], [*b, *right]) for x in pair]))
            at_block = fold(changed or node, a, b)
            folds.append(beyond if at_block == block else fold(at_block, left, right))
        out = batch[["doc_id", "leaf"]].copy()
        out["subroot"], out["root"], out["proof_sha256"], out["folded_root"] = subroot, root, proofs, folds
        out["verified"] = [f == root for f in folds]
        return out

    kind = rows.schema["doc_id"].dataType
    keyed = rows.select("tree", "pos", "n", "leaf", "changed", F.col("doc_id").cast("string").alias("doc_id"), _block(levels))  # pandas has no nulls among integers
    if isinstance(above, dict):
        paths = rows.sparkSession.sparkContext.broadcast(above)
        out = keyed.groupBy("tree", "_block").applyInPandas(lambda b: finish(b, paths.value[b["tree"].iloc[0], int(b["_block"].iloc[0])]), schema)
    else:

        def both(batch: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
            p = path.iloc[0]
            return finish(batch, (list(p["left"]), list(p["right"]), p["subroot"], p["root"]))

        out = keyed.groupBy("tree", "_block").cogroup(above.withColumnRenamed("pos", "_block").groupBy("tree", "_block")).applyInPandas(both, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
