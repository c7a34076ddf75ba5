"""Jaccard join of documents on word n-grams, up to its connected components.

Exact, by prefix filtering with set relations used to skip work twice:

* index level: the entries of an inverted list lie in blocks by set size and by position, and a pair of blocks is passed
  over as a whole when its smallest positions and its sizes cannot reach the needed overlap; only blocks that can are
  opened, and their entries are held against each other one by one;
* answer level: equal sets are one class; neighbours in a list are compared first, and what they link is one group. A
  set that is very similar (0.95) to another takes that one as its leader. Of what is left open between groups only
  leaders are compared: the overlaps of their followers are derived from that one answer and the few shingles by which
  a follower differs, as bounds, and a pair is compared itself only where the bounds leave it open.

The outcome is components: links inside a group are never computed. Shingles are ordered by a count sketch of fixed size
over the whole corpus (rare first), then by hash, so a passage that a large part of the corpus shares stays out of the
prefixes of the rest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.bytescan import LOWER, U64, Hasher, _splitmix, chunks, mix, split_words, text_bytes
from narrascope.llm.joins import join_dealt, join_sized
from narrascope.operators.components import components

NO_ID = -(1 << 63)
SKETCH_BITS = 20
_BLOCK = 4096
#: An inverted list is dealt to one more task for each so many entries that the sketch foresees.
LIST_ROWS = 1_000
#: Comparisons of a set at each turn that makes groups grow; what the turns leave open is settled after.
NEIGHBOURS = 12
LAGS = 12
MOST_TURNS = 4
#: A set follows another one from this similarity on; positions that a block of an inverted list spans.
ALIKE = 95, 100
POSITIONS = 4
_STEPS = _splitmix(64, 4242) | U64(1)


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of texts that lie end to end, and their number by text.

    A text with fewer words has one for its whole sequence; without words it has none.
    """
    low = LOWER[data]
    start, end, reach = split_words(low, off)
    word = Hasher(low).ranges(start, end)
    count = np.diff(reach)
    some = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.repeat(reach[:-1], some) + np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
    padded = np.concatenate((word, np.zeros(n, np.uint64)))
    out = np.zeros(len(first), np.uint64)
    short = np.repeat(count < n, some)
    width = np.repeat(np.minimum(count, n), some)
    for k in range(n):
        part = padded[first + k] * _STEPS[k]
        if short.any():
            part[width <= k] = 0
        out += part
    return mix(out + width.astype(np.uint64)), some


def sets(data: np.ndarray, off: np.ndarray, n: int, rank: np.ndarray | None = None) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; with ``rank`` in order of sketch class first (top byte)."""
    h, some = shingles(data, off, n)
    if rank is not None:
        h = (rank[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << U64(56)) | (h >> U64(8))
    out, lo = [], 0
    for k in some.tolist():
        x = np.sort(h[lo : lo + k])
        out.append(x[np.append(True, x[1:] != x[:-1])] if k else x)
        lo += k
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))


FACT = "doc long, n long, digest binary, block int, counts binary"


def _facts(n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc", "n", "digest", "block", "counts"]
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            sizes, digests = [], []
            for i, j in chunks(off):
                for x in sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n):
                    sizes.append(len(x))
                    digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    np.add.at(sketch, (x >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        full = [b for b in range(0, len(sketch), _BLOCK) if sketch[b : b + _BLOCK].any()]
        if full:
            k = len(full)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([b // _BLOCK for b in full], pa.int32()), pa.array([zlib.compress(sketch[b : b + _BLOCK].tobytes(), 1) for b in full], pa.binary())], names)

    return scan


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(raw), np.int32).astype(np.int64)
            total[b] = total[b] + x if b in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def sketch_classes(facts: DataFrame) -> np.ndarray:
    """One byte for each slot of the sketch: the base-2 logarithm of its count, in halves. A table of fixed size."""
    blocks = facts.where("block is not null").select("block", "counts").repartition(16, "block").mapInArrow(_sum_blocks, "block int, counts binary")
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for b, raw in blocks.collect():  # 2 ** SKETCH_BITS numbers in all
        counts[b * _BLOCK : (b + 1) * _BLOCK] = np.frombuffer(bytes(raw), np.int32)
    return (2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


ENTRY = "token long, doc long, place long"


def _prefixes(n: int, num: int, den: int, rank: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            docs = batch.column(0).to_numpy()
            for i, j in chunks(off, 1 << 20):
                found = sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n, rank)
                size = np.array([len(x) for x in found], np.int64)
                keep = np.where(size > 0, size - (num * size + den - 1) // den + 1, 0)
                token = np.concatenate([x[:k] for x, k in zip(found, keep.tolist())])
                pos = np.arange(len(token)) - np.repeat(np.cumsum(keep) - keep, keep)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.repeat(docs[i:j], keep)), pa.array((np.repeat(size, keep) << 32) | pos)], ["token", "doc", "place"])

    return scan


def _reaches(sx, px, sy, py, num: int, den: int):
    """Whether sets of these sizes that first meet at these positions can be similar enough; works on columns and arrays alike."""
    need = (sx + sy) * num
    least = F.least if not isinstance(sx, np.ndarray) else np.minimum
    return (least(sx - px, sy - py) * (num + den) >= need) & (sx * den >= sy * num) & (sy * den >= sx * num)


LIST = "token long, doc long, place long"


def _lists(long_from: int):
    """Rows come sorted by (token, place, doc). Lists of one entry go.

    A list that the sketch foresees at ``long_from`` entries or more may go on in other tasks and stays whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the row before; the row before if nothing says yet that its list is longer
        for batch in batches:
            token, doc, place = (batch.column(k).to_numpy() for k in range(3))
            if not len(token):
                continue
            joined = token[1:] == token[:-1]
            with_last = np.append(last is not None and token[0] == last[0], joined)
            with_next = np.append(joined, False)
            keep = with_last | with_next
            keep |= np.exp2((token.view(np.uint64) >> U64(56)) / 2.0) >= long_from
            out = [(token[keep], doc[keep], place[keep])]
            if held is not None and with_last[0]:
                out.insert(0, tuple(np.array([x]) for x in held))
            last = token[-1], doc[-1], place[-1]
            held = None if keep[-1] else last
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["token", "doc", "place"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], ["token", "doc", "place"])

    return scan


def _before(num: int, den: int, lags: int):
    """Rows (token, doc, place, own) come sorted by token. Out: each entry with those of other groups among the ``lags`` before it, if the two may be similar."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(4)]
            old = 0 if carry is None else len(carry[0])
            if old:
                rows = [np.concatenate(x) for x in zip(carry, rows)]
            token, doc, place, own = rows
            size, pos = place >> 32, place & 0xFFFFFFFF
            for lag in range(1, min(lags, len(token) - 1) + 1):
                ok = (token[lag:] == token[:-lag]) & (own[lag:] != own[:-lag])
                ok[: max(0, old - lag)] = False
                at = np.flatnonzero(ok) + lag
                at = at[_reaches(size[at - lag], pos[at - lag], size[at], pos[at], num, den)]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(doc[at - lag])], ["doc", "other"])
            carry = [x[-lags:] for x in rows]

    return scan


def _nearest(lists: DataFrame, groups: DataFrame | None, turn: int, num: int, den: int) -> DataFrame:
    """Pairs (x < y) to compare next: for each set the few sets of other groups that most often stand just before it in its lists.

    Lists are in order of size and position at first, and in another random order at each later turn.
    """
    rows = lists.withColumn("own", F.col("doc")) if groups is None else lists.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("own", F.coalesce("component", "doc"))
    if groups is not None:
        rows = rows.join(rows.groupBy("token").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a != b").select("token"), "token")
    # long lists are dealt out here, too; each part looks for neighbours of its own
    parts = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.shiftrightunsigned("token", 56) / 2) / LIST_ROWS)).cast("long")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("token", "doc", F.lit(turn)), parts)).withColumn("_at", F.col("place") if turn == 0 else F.xxhash64("doc", F.lit(turn)))
    pairs = rows.repartition("token", "_part").sortWithinPartitions("token", "_part", "_at", "doc").select("token", "doc", "place", "own").mapInArrow(_before(num, den, 2 if turn == 0 else LAGS), "doc long, other long")
    votes = pairs.groupBy("doc", "other").agg(F.count("*").alias("n"))
    best = votes.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "other"))).where(F.col("k") <= NEIGHBOURS)
    return best.select(F.least("doc", "other").alias("x"), F.greatest("doc", "other").alias("y")).distinct()


def _left_open(lists: DataFrame, groups: DataFrame) -> int:
    """Pairs of entries of different groups, at most, in all lists."""
    rows = lists.join(groups.withColumnRenamed("node", "doc"), "doc", "left").groupBy("token", F.coalesce("component", "doc").alias("own")).agg(F.count("*").alias("n"))
    sizes = rows.groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("main"))
    return int(sizes.agg(F.sum(F.col("n") * (F.col("n") - F.col("main")))).first()[0] or 0)


MEMBER = "block long, deal int, doc long, bytes binary"
#: Sets that one task holds against the head of a block, about; more are dealt to other tasks, with the head.
BLOCK_SETS = 200


def _ship_sets(n: int):
    """The sets (48 bits a shingle) of the documents asked for, once for each block and deal that asks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            docs, blocks, deals = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for i, j in chunks(off, 1 << 20):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for k, x in enumerate(sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], n)):
                    packed = np.ascontiguousarray((x >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                    for b, d in zip(blocks[i + k], deals[i + k]):
                        out[0].append(b), out[1].append(d), out[2].append(docs[i + k]), out[3].append(packed)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["block", "deal", "doc", "bytes"])

    return scan


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


OVERLAP = "u long, v long, common long, nu long, nv long"


def _overlaps(num: int, den: int):
    """Rows come sorted by block and deal, the head first; out: members (u) similar enough to the head (v), with overlap and sizes. With ``num`` 0 all."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, head = None, None
        for batch in batches:
            out = []
            for b, doc, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if doc == b:
                    if block != b:
                        block, head = b, _unpacked(raw.as_py())
                    continue
                if block != b:
                    continue
                x = _unpacked(raw.as_py())
                common = len(np.intersect1d(head, x, assume_unique=True))
                if den * common >= num * (len(head) + len(x) - common):
                    out.append((doc, b, common, len(x), len(head)))
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "common", "nu", "nv"])

    return scan


def _compared(texts: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Staged overlaps of those of the pairs (x < y) that are similar enough, on whole sets."""
    # a set that very many are held against is sent to several tasks
    many = runtime.staged(pairs.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_SETS), "popular-sets")
    deals = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK_SETS)
    dealt = join_sized(pairs, many, "x", "left").select("x", "y", F.pmod(F.xxhash64("y"), deals).cast("int").alias("deal"))
    ask = lambda c: F.struct(F.col(c).alias("doc"), F.col("x").alias("block"), "deal")
    asked = dealt.select(F.explode(F.array(ask("x"), ask("y"))).alias("e")).select("e.*").groupBy("doc").agg(F.collect_set(F.struct("block", "deal")).alias("b"))
    asked = runtime.staged(asked.select("doc", F.col("b.block").alias("blocks"), F.col("b.deal").alias("deals")), "asked")
    members = join_sized(texts, asked, "doc").select("doc", "text", "blocks", "deals").mapInArrow(_ship_sets(n), MEMBER)
    members = members.repartition("block", "deal").sortWithinPartitions("block", "deal", F.col("doc") != F.col("block"))
    return runtime.staged(members.mapInArrow(_overlaps(num, den), OVERLAP), "overlaps")


def leaders_of(links: DataFrame, num: int | None = None, den: int | None = None) -> DataFrame:
    """(doc, leader, minus, plus): followers, and how many shingles only the leader or only the follower has.

    Of sets that are alike, one without a smaller one like it is a leader; another follows the smallest leader that it
    is like, if there is one.
    """
    num, den = (num, den) if num else ALIKE
    close = links.where(den * F.col("common") >= num * (F.col("nu") + F.col("nv") - F.col("common")))
    both = close.select(F.col("u").alias("doc"), F.col("v").alias("leader"), "common", F.col("nu").alias("own"), F.col("nv").alias("theirs"))
    both = both.unionByName(close.select(F.col("v").alias("doc"), F.col("u").alias("leader"), "common", F.col("nv").alias("own"), F.col("nu").alias("theirs"))).where("leader < doc")
    led = both.select(F.col("doc").alias("leader")).distinct()
    first = both.join(led, "leader", "left_anti").groupBy("doc").agg(F.min_by(F.struct("leader", (F.col("theirs") - F.col("common")).alias("minus"), (F.col("own") - F.col("common")).alias("plus")), "leader").alias("l"))
    return runtime.staged(first.select("doc", "l.*"), "leaders")


def _derived(texts: DataFrame, pairs: DataFrame, links: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(u, v) of those pairs (x, y, with sizes nx, ny) that are links, from the overlaps of their leaders where that decides it."""
    led = leaders_of(links)
    side = lambda c, l, m, p: led.select(F.col("doc").alias(c), F.col("leader").alias(l), F.col("minus").alias(m), F.col("plus").alias(p))
    rows = pairs.join(side("x", "lx", "mx", "px"), "x", "left").join(side("y", "ly", "my", "py"), "y", "left")
    zero = lambda *cs: sum((F.coalesce(c, F.lit(0)) for c in cs), F.lit(0))
    a, b = F.coalesce("lx", "x"), F.coalesce("ly", "y")
    rows = runtime.staged(rows.select("x", "y", "nx", "ny", F.least(a, b).alias("r"), F.greatest(a, b).alias("s"), zero("mx", "my").alias("minus"), zero("px", "py").alias("plus")), "open-pairs")
    known = _compared(texts, rows.select(F.col("r").alias("x"), F.col("s").alias("y")).distinct(), n, 0, 1)
    rows = rows.join(known.select(F.col("v").alias("r"), F.col("u").alias("s"), "common"), ["r", "s"], "left")
    common = F.coalesce("common", F.lit(0))
    enough = lambda c: c * (num + den) >= num * (F.col("nx") + F.col("ny"))
    rows = runtime.staged(rows.select("x", "y", enough(common - F.col("minus")).alias("sure"), enough(F.least(common + F.col("plus"), "nx", "ny")).alias("open")).where("open"), "bounded-pairs")
    undecided = rows.where("NOT sure")
    found = rows.where("sure").select(F.col("y").alias("u"), F.col("x").alias("v"))
    if undecided.limit(1).count():
        found = found.unionByName(_compared(texts, undecided.select("x", "y"), n, num, den).select("u", "v"))
    return found


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link when den * intersection >= num * union of their sets of word n-grams. Null and empty texts
    have the empty set and link with nothing; a text with fewer than ``n`` words has its whole sequence as its one
    n-gram. Rows that repeat an id are one document, so that its texts lie in one component; a null id counts as the
    smallest. A text of any length has its set made in one task. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    texts = _texts(docs)
    said = F.xxhash64(F.coalesce("text", F.lit("")))
    several = texts.groupBy("doc").agg(F.min(said).alias("a"), F.max(said).alias("b")).where("a != b").select("doc")
    several = runtime.staged(several.withColumn("split", F.lit(True)), "ids-of-several-texts")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    if not several.limit(1).count():
        out = _components_of(texts, n, num, den)
        return out.select(known("doc").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))
    # each text of such an id is joined as a document of its own
    own = F.when(F.col("split"), F.xxhash64("doc", F.coalesce("text", F.lit("")))).otherwise(F.col("doc"))
    keyed = join_sized(texts, several, "doc", "left").select(own.alias("own"), "doc", "text")
    names = runtime.staged(keyed.select("own", "doc").distinct(), "own-ids")
    found = _components_of(keyed.select(F.col("own").alias("doc"), "text"), n, num, den)
    found = runtime.staged(found.withColumnRenamed("doc", "own").join(names, "own").select("doc", "n", "component"), "texts-in-components")
    edges = join_sized(found, several, "doc").groupBy("doc", "component").agg(F.lit(1)).select("doc", F.col("component").alias("u"))
    edges = edges.join(edges.groupBy("doc").agg(F.min("u").alias("v")), "doc").select("u", "v")
    joined = components(edges)
    found = join_sized(found.withColumnRenamed("component", "node"), joined, "node", "left").select("doc", "n", F.coalesce("component", "node").alias("whole"))
    found = runtime.staged(found, "whole-components")
    out = found.join(found.groupBy("whole").agg(F.min("doc").alias("component")), "whole")
    return out.select(known("doc").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def _components_of(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc, n, component) of texts (doc, text) where rows that repeat a doc have the same text."""
    spark = texts.sparkSession
    runtime.prepare(spark)
    facts = runtime.staged(texts.mapInArrow(_facts(n), FACT), "facts")
    rank = sketch_classes(facts)
    rows = facts.where("block is null").select("doc", "n", "digest")
    # sets that only one document has need no join, and a class of many copies is one row
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).where("rep != last").drop("last")
    members = join_dealt(rows, runtime.staged(classes, "classes"), "digest", "doc")
    members = runtime.staged(members.select("doc", "n", F.coalesce("rep", "doc").alias("rep")), "members")
    copies = runtime.staged(members.where("doc != rep").select("doc").distinct(), "copies")
    heads = join_sized(texts, copies, "doc", "left_anti")

    entries = heads.select("doc", "text").mapInArrow(_prefixes(n, num, den, rank), ENTRY)
    # the top byte is twice the logarithm of the foreseen length; a list has one part below 2 * LIST_ROWS
    parts = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.shiftrightunsigned("token", 56) / 2) / LIST_ROWS)).cast("long")
    dealt = entries.withColumn("_part", F.pmod(F.xxhash64("token", "doc"), parts)).repartition("token", "_part").sortWithinPartitions("token", "place", "doc").drop("_part")
    lists = runtime.staged(dealt.mapInArrow(_lists(2 * LIST_ROWS), LIST), "lists")

    groups, tested, known = None, None, None
    for turn in range(MOST_TURNS):
        near = _nearest(lists, groups, turn, num, den)
        near = runtime.staged(near if tested is None else near.join(tested, ["x", "y"], "left_anti"), "neighbours")
        tested = near if tested is None else runtime.staged(tested.unionByName(near), "tested")
        links = _compared(heads, near, n, num, den)
        n_links = links.count()
        if n_links:
            known = links if known is None else known.unionByName(links)
            old = [] if groups is None else [groups.select(F.col("node").alias("u"), F.col("component").alias("v"))]
            pairs = links.select("u", "v")
            groups = components(pairs.unionByName(old[0]) if old else pairs)
        if groups is None or not n_links or _left_open(lists, groups) <= lists.count():
            break
    if groups is None:
        groups, known = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], OVERLAP)
    rest = runtime.staged(_other_groups(lists, groups, num, den).join(tested, ["x", "y"], "left_anti"), "other-groups")
    if rest.limit(1).count():
        more = _derived(heads, rest, known, n, num, den)
        if more.limit(1).count():
            groups = components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    return members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "n", F.coalesce("component", "rep").alias("component"))


def _other_groups(lists: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (x < y, sizes nx, ny) that meet in a list and lie in different groups.

    Of each list the largest group is only met by the others. Entries lie in blocks by size class and by position; two
    blocks that cannot reach the needed overlap at their smallest positions, for any of their sizes, are never opened.
    """
    rows = lists.select("token", "doc", "place").join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    size, pos = (F.col("place") / (1 << 32)).cast("long"), F.col("place") % (1 << 32)
    # sizes of similar sets lie in the same class or in neighbouring ones
    rows = rows.select("token", "doc", size.alias("size"), pos.alias("pos"), F.coalesce("component", "doc").alias("own"))
    rows = runtime.staged(rows.withColumn("sizes", F.floor(F.log("size") / float(np.log(den / num))).cast("int")).withColumn("at", F.floor(F.log2(F.col("pos") / POSITIONS + 1)).cast("int")), "grouped-lists")
    shares = rows.groupBy("token", "own").agg(F.count("*").alias("n"))
    main = shares.groupBy("token").agg(F.max(F.struct("n", "own")).alias("m"), F.count("*").alias("k")).where("k > 1").select("token", F.col("m.own").alias("main"))
    rows = rows.join(runtime.staged(main, "lists-of-several-groups"), "token")

    block = rows.groupBy("token", "sizes", "at").agg(F.min("pos").alias("lo"), F.min("size").alias("least"), F.max("size").alias("most"), F.max((F.col("own") != F.col("main")).cast("int")).alias("others"), F.min("own").alias("a"), F.max("own").alias("b"))
    left = block.where("others = 1").withColumn("near", F.explode(F.array(F.col("sizes") - 1, F.col("sizes"), F.col("sizes") + 1))).alias("l")
    right = block.withColumn("near", F.col("sizes")).alias("r")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    # the overlap of any two sets of the blocks is at most that of their largest at the smallest positions, and needs at least that of their smallest
    reaches = F.least(l("most") - l("lo"), r("most") - r("lo")) * (num + den) >= (l("least") + r("least")) * num
    several = (l("a") != l("b")) | (r("a") != r("b")) | (l("a") != r("a"))
    opened = left.join(right, (l("token") == r("token")) & (l("near") == r("near")) & reaches & several)
    opened = runtime.staged(opened.select(l("token").alias("token"), l("sizes").alias("l_sizes"), l("at").alias("l_at"), r("sizes").alias("r_sizes"), r("at").alias("r_at")), "opened-blocks")

    named = lambda p: rows.select("token", F.col("sizes").alias(f"{p}_sizes"), F.col("at").alias(f"{p}_at"), *[F.col(c).alias(f"{p}_{c}") for c in ("doc", "size", "pos", "own")], F.col("main").alias(f"{p}_main"))
    both = opened.join(named("l").where("l_own != l_main"), ["token", "l_sizes", "l_at"]).join(named("r"), ["token", "r_sizes", "r_at"])
    meet = (F.col("l_own") != F.col("r_own")) & ((F.col("r_own") == F.col("r_main")) | (F.col("l_doc") < F.col("r_doc"))) & _reaches(F.col("l_size"), F.col("l_pos"), F.col("r_size"), F.col("r_pos"), num, den)
    first = F.col("l_doc") < F.col("r_doc")
    pair = [F.least("l_doc", "r_doc").alias("x"), F.greatest("l_doc", "r_doc").alias("y"), F.when(first, F.col("l_size")).otherwise(F.col("r_size")).alias("nx"), F.when(first, F.col("r_size")).otherwise(F.col("l_size")).alias("ny")]
    return both.where(meet).select(*pair).distinct()
