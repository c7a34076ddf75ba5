"""Token-id files of directly addressable codes.

Ids are cut into chunks of 8 bits. Level 0 holds the low chunk of every id; a bitmap marks ids that go on, and
level k + 1 holds the next chunk of just those. A rank directory (one count for each 512 bits) turns a position
of one level into the position on the next, so any token is read with one byte and one popcount a level and
nothing is decoded in blocks.

File: magic, the numbers of documents, of levels and of chunks on each level (64 bits each), then the sections:
which documents have an id, their ids, their starts (with the end), and for each level chunk bytes, bitmap, rank
directory. All little-endian.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.bytescan import chunks, text_bytes

MAGIC = b"DACTOK1\0"
BLOCK = 512
#: A file is closed after so many tokens.
FILE_TOKENS = 1 << 24


class Level:
    def __init__(self, chunk: np.ndarray, bits: np.ndarray, rank: np.ndarray):
        self.chunk, self.bits, self.rank = chunk, bits, rank


def encode_levels(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        packed = np.packbits(more, bitorder="little")
        packed = np.concatenate((packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)))
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)))
        levels.append(Level(rest.astype(np.uint8), packed, rank))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


class TokenFile:
    """One file, read whole or by position."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        head = np.frombuffer(raw, "<u8", 2, 8)
        self.n_docs, n_levels = int(head[0]), int(head[1])
        self.at = 24
        sizes = np.frombuffer(raw, "<u8", n_levels, self.at)
        self.at += 8 * n_levels

        def take(kind: str, n: int) -> np.ndarray:
            out = np.frombuffer(raw, kind, n, self.at)
            self.at += out.nbytes
            return out

        self.has_id = take("u1", self.n_docs).astype(bool)
        self.doc_id = take("<i8", self.n_docs)
        self.starts = take("<i8", self.n_docs + 1)
        self.levels = []
        for n in map(int, sizes):
            blocks = -(-n // BLOCK)
            self.levels.append(Level(take("u1", n), take("u1", blocks * BLOCK // 8), take("<u8", blocks + 1)))

    def __len__(self) -> int:
        return int(self.starts[-1])

    def token(self, i: int) -> int:
        """Token ``i`` of the file, by rank alone."""
        out = 0
        for k, level in enumerate(self.levels):
            out |= int(level.chunk[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not level.bits[byte] >> bit & 1:
                break
            i = self._rank(level, i)
        return out

    @staticmethod
    def _rank(level: Level, i: int) -> int:
        """Ones before position ``i``."""
        block = i // BLOCK
        lo = block * BLOCK // 8
        span = np.unpackbits(level.bits[lo : i // 8 + 1], bitorder="little")[: i - block * BLOCK]
        return int(level.rank[block]) + int(span.sum())

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo..hi - 1."""
        out = np.zeros(hi - lo, np.uint32)
        where: np.ndarray | slice = slice(None)
        for k, level in enumerate(self.levels):
            part = level.chunk[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            out[where] |= part
            flags = np.unpackbits(level.bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            if not flags.any():
                break
            where = np.flatnonzero(flags) if isinstance(where, slice) else where[flags]
            lo, hi = (self._rank(level, lo), self._rank(level, hi)) if hi < len(level.chunk) else (self._rank(level, lo), int(level.rank[-1]))
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


class StoredTokens:
    """Any token of a stored file by a few short reads: a byte, part of a bitmap block and one rank a level."""

    def __init__(self, uri: str):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(uri)
        self.file, self.bytes_read = files.open_input_file(path), 0
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, n_levels = np.frombuffer(self._read(8, 16), "<u8").tolist()
        at = 24 + 8 * n_levels + self.n_docs
        self.ids_at, self.starts_at = at, at + 8 * self.n_docs
        at = self.starts_at + 8 * (self.n_docs + 1)
        self.levels = []  # where chunks, bitmap and ranks lie
        for n in np.frombuffer(self._read(24, 8 * n_levels), "<u8").tolist():
            blocks = -(-n // BLOCK)
            self.levels.append((at, at + n, at + n + blocks * BLOCK // 8))
            at += n + blocks * BLOCK // 8 + 8 * (blocks + 1)
        self.n_tokens = int(np.frombuffer(self._read(self.starts_at + 8 * self.n_docs, 8), "<i8")[0])

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def __len__(self) -> int:
        return self.n_tokens

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        self.bytes_read += n
        return self.file.read(n)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for k, (chunk, bits, rank) in enumerate(self.levels):
            out |= self._read(chunk + i, 1)[0] << (8 * k)
            block = i // BLOCK
            span = self._read(bits + block * BLOCK // 8, i % BLOCK // 8 + 1)
            flags = np.unpackbits(np.frombuffer(span, np.uint8), bitorder="little")[: i % BLOCK + 1]
            if not flags[-1]:
                break
            i = int(np.frombuffer(self._read(rank + 8 * block, 8), "<u8")[0]) + int(flags[:-1].sum())
        return out

    def document_span(self, k: int) -> tuple[int | None, int, int]:
        """Id, start and end of document ``k`` in the file."""
        lo, hi = np.frombuffer(self._read(self.starts_at + 8 * k, 16), "<i8").tolist()
        known = self._read(self.ids_at - self.n_docs + k, 1)[0]
        return (int(np.frombuffer(self._read(self.ids_at + 8 * k, 8), "<i8")[0]) if known else None), lo, hi


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file, in order."""
    levels = encode_levels(ids)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [MAGIC, np.array([len(doc_ids), len(levels)], "<u8").tobytes(), np.array([len(x.chunk) for x in levels], "<u8").tobytes(), known.tobytes()]
    parts += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.concatenate(([0], np.cumsum(counts))).astype("<i8").tobytes()]
    for level in levels:
        parts += [level.chunk.tobytes(), level.bits.tobytes(), level.rank.astype("<u8").tobytes()]
    return parts


def store(uri: str, parts: list[bytes]) -> None:
    """Written under another name and then moved, so that a file is whole or absent."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(f"{path}.part") as out:
        for x in parts:
            out.write(x)
    files.move(f"{path}.part", path)


def load(uri: str) -> bytes:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        return f.read()


SHARD = "part int, seq int, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode ``docs`` in ascending id order into token files; one row a file: part, seq, path, n_docs, n_tokens, start.

    Null texts count as empty; rows that repeat an id are all written, in order of their text; a null id comes
    first; a long text is encoded whole, in one file; an empty table has no files; other columns are ignored, whatever
    their names. Each task writes the files of its own range of ids; a repeated task writes new files, and only those
    of the attempt that ended are listed. ``start`` is the number of ids in all files before.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    folder = runtime.fresh_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from narrascope.llm.tokenize import encoder

        enc = encoder(tokenizer)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        doc_ids: list[int | None] = []
        counts: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            path = f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.dac"
            ids = np.concatenate(pieces) if pieces else np.zeros(0, np.uint16)
            store(path, encode_file(doc_ids, np.concatenate(counts), ids))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})
            doc_ids.clear(), counts.clear(), pieces.clear()
            held, seq = 0, seq + 1
            return row

        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in chunks(off, 1 << 20):
                ids, n = enc.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                if end_id is not None:
                    ids, n = with_end(ids, n, end_id)
                doc_ids += names[i:j]
                counts.append(n)
                pieces.append(ids)
                held += len(ids)
                if held >= file_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = texts.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = runtime.staged(ordered.mapInArrow(write, SHARD), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append an id to every text."""
    kind = ids.dtype if end_id <= np.iinfo(ids.dtype).max else np.uint32
    out = np.empty(len(ids) + len(counts), kind)
    ends = np.cumsum(counts + 1) - 1
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = ids
    out[ends] = end_id
    return out, counts + 1


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(files: DataFrame) -> DataFrame:
    """One row a document, from the files: its id, where it starts among all ids, its length and their crc32."""
    spark = files.sparkSession
    runtime.prepare(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(load(path))
                size = np.diff(file.starts)
                sums = np.empty(file.n_docs, np.int64)
                lo = 0
                while lo < file.n_docs:  # some million tokens at a time
                    hi = max(lo + 1, int(np.searchsorted(file.starts, file.starts[lo] + (1 << 21), side="right")) - 1)
                    base = int(file.starts[lo])
                    ids = memoryview(file.tokens(base, int(file.starts[hi])).astype("<u4")).cast("B")
                    for k in range(lo, hi):
                        sums[k] = zlib.crc32(ids[4 * (int(file.starts[k]) - base) : 4 * (int(file.starts[k + 1]) - base)])
                    lo = hi
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_id, pa.int64(), mask=~file.has_id), "start": pa.array(file.starts[:-1] + start), "n_tokens": pa.array(size), "ids_crc32": pa.array(sums)})

    wide = max(1, min(10_000, files.count()))
    return files.select("path", "start").repartition(wide).mapInArrow(read, READ)
