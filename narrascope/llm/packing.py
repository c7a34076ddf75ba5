"""Best-fit packing planned over the histogram of lengths.

Pieces are counted by length, the plan is made on counts (at most ``capacity`` of them), and every piece then
takes its planned slot by its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.bytescan import chunks, text_bytes
from narrascope.llm.joins import join_sized
from narrascope.llm.tokenfile import with_end

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one part of a length, about: parts, not lengths, are dealt to tasks.
RANK_ROWS = 1_000


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, last rank + 1, first sequence, offset).

    Items of ranks lo..hi - 1 of the length go to as many consecutive sequences, all at the same offset.
    Sequences with equal room are kept as runs of numbers, so the work follows the number of different lengths.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(room: int, lo: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((lo, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                break
            room = rooms[at]
            lo, n = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            k = min(n, left)
            out.append((length, rank, rank + k, lo, capacity - room))
            give(room, lo + k, n - k)
            give(room - length, lo, k)
            rank, left = rank + k, left - k
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            for j in range(each):
                k = full + (j < rest)
                if k:
                    out.append((length, rank, rank + k, opened, j * length))
                    rank += k
            give(capacity - each * length, opened, full)
            if rest:
                give(capacity - rest * length, opened + full, 1)
            opened += full + (rest > 0)
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of every document; only documents over ``capacity`` are cut, and the first piece takes the rest."""
    runtime.prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from narrascope.llm.tokenize import encoder

        enc = encoder(tokenizer)
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            names = batch.column(0)
            for i, j in chunks(off, 1 << 20):
                ids, n = with_end(*enc.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i]), end_id)
                wide = memoryview(ids.astype("<u4")).cast("B")
                n_pieces = -(-n // capacity)
                doc = np.repeat(np.arange(j - i), n_pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                first = np.where(n % capacity, n % capacity, capacity)
                length = np.where(number == 0, first[doc], capacity)
                start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
                lo = (np.cumsum(n) - n)[doc] + start
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": names.slice(i, j - i).take(pa.array(doc)), "piece": pa.array(number.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(sums, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE)


def rank_within(df: DataFrame, key: str, counts: dict[int, int], order: list[str]) -> DataFrame:
    """``rank`` from 0 within each key (a small number, counted in ``counts``): ranks within parts, plus what lies in the parts before.

    A key has a part for each RANK_ROWS of its rows, so none of them grows with the input.
    """
    parts = F.get(F.lit([max(1, -(-counts.get(k, 0) // RANK_ROWS)) for k in range(max(counts, default=0) + 1)]), F.col(key).cast("int"))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), parts).cast("int"))
    sizes = df.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runtime.staged(sizes.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "part-sizes")
    local = df.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    # a row for each key and each RANK_ROWS rows
    return join_sized(local, sizes, [key, "_part"]).withColumn("rank", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as best fit finds.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty and holds
    the end id alone; rows that repeat an id are packed each, and equal rows are interchangeable; a null id is packed
    like any other; a text of any length is encoded whole in one task and cut; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    pieces = runtime.staged(cut_pieces(docs, tokenizer, capacity=capacity, end_id=end_id), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = plan_best_fit(counts, capacity)
    slots = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, first long, offset long")
    ranked = rank_within(pieces, "length", counts, ["doc_id", "piece", "ids_crc32"])
    # the plan has a few rows for each length, whatever the number of documents
    joined = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return joined.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
