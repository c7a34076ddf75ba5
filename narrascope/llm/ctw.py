"""Context-tree weighting over bytes, and a word-count baseline, learned from one part of a corpus and scoring all of it.

A byte is eight binary decisions. Every decision has one Krichevsky-Trofimov estimator for each context of the last
0..depth bytes; a context's block probability is half its own estimate and half the product of its children's, so all
depths are mixed by how well each has coded the training text. Counts are frozen before scoring.

The corpus gives its distinct (depth + 1)-grams of bytes with their counts; tasks send them as sorted, compressed runs.
Subtrees below two bytes of context are worked out in parallel, one of the eight decisions at a time; the two levels
above have at most 256 * 255 nodes. The outcome is a table from gram to bits, which scoring tasks read from the shared
folder in shards of bounded size, one pass for each shard, in which only grams of that shard are looked up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.bytescan import LOWER, U64, Directory, Hasher, chunks, mix, release, split_words, text_bytes

#: Keys of one shard of a table in a scoring task's memory.
WORD_SHARD, GRAM_SHARD = 3_000_000, 5_000_000
#: Grams whose subtrees are worked out at once, about 200 bytes each at depth 7; one two-byte context is never divided.
BLOCK = 1 << 17
#: Distinct keys that a counting task holds before it passes them on, and those it gathers before it sorts them in.
HELD, GATHERED = 2_500_000, 1_000_000
FOLDS, HELD_OUT = 7, 2
WORD, GRAM, TOTAL = 0, 1, 2

RUN = "kind int, part int, n long, run binary"


def is_held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str("" if x is None else x).encode()) % FOLDS == HELD_OUT for x in ids], bool)


def padded(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text after ``depth`` zero bytes and before one, and where each begins (n + 1 long)."""
    n = len(off) - 1
    starts = off + np.arange(n + 1) * (depth + 1)
    out = np.zeros(int(starts[-1]), np.uint8)
    size = np.diff(off)
    out[np.arange(len(data)) + np.repeat((np.arange(n) + 1) * (depth + 1) - 1, size)] = data
    return out, starts


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The (depth + 1)-gram that begins at each byte (and ends at a coded one), oldest byte first."""
    n = len(data) - depth
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.ndarray((n,), ">u8", buffer=wide.data, strides=(1,)).astype(np.uint64)
    return key >> U64(8 * (7 - depth)) if depth < 7 else key


def coded(starts: np.ndarray, depth: int) -> np.ndarray:
    """Grams of each text: its bytes and the end. They begin where the padded text does."""
    return np.diff(starts) - depth


def tally(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    if weight is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weight, first) if len(first) else weight


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tally(*(np.concatenate(x) for x in zip(*parts))) if len(parts) > 1 else parts[0]


def pack_run(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences, and 64-bit values; both in byte planes, so that what is alike lies together."""
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes(np.diff(keys, prepend=U64(0))) + planes(np.ascontiguousarray(values)))


def unpack_run(raw: bytes, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(2, 8, -1)
    wide = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in planes]
    return np.cumsum(wide[0], dtype=np.uint64), wide[1].view(kind)


def part_of(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """Grams of one two-byte context go to one part."""
    named = (keys >> U64(8)) & U64(0xFFFF) if kind == GRAM else keys.copy()
    return (mix(named * U64(0x9E3779B97F4A7C15)) % U64(parts)).astype(np.uint16)


def _rows(kind: int, part: list, n: list, run: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array(run, pa.binary())], ["kind", "part", "n", "run"])


def count(depth: int, parts: int):
    """Runs of words (training texts) and grams (all texts, those of held-out ones with count 0), and of tokens and training texts (keys 0 and 1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k in (WORD, GRAM)}
        fresh: dict[int, list] = {WORD: [], GRAM: []}
        tokens = n_train = 0

        def sorted_in(kind: int) -> None:
            held[kind] = merged([held[kind], *fresh[kind]])
            fresh[kind] = []

        def passed_on(kind: int) -> Iterator[pa.RecordBatch]:
            keys, sums = held[kind]
            part = part_of(kind, keys, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    yield _rows(kind, [p], [len(own)], [pack_run(keys[own], sums[own])])
            held[kind] = (keys[:0], sums[:0])

        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            train = ~is_held_out(batch.column(0).to_pylist())
            for i, j in chunks(off, 1 << 20):
                low = LOWER[raw[off[i] : off[j]]]
                rel = off[i : j + 1] - off[i]
                own = train[i:j]
                start, end, reach = split_words(low, rel)
                n = np.diff(reach)
                fresh[WORD].append(tally(Hasher(low).ranges(start, end)[np.repeat(own, n)]))
                tokens += int(n[own].sum() + own.sum())
                n_train += int(own.sum())
                data, starts = padded(low, rel, depth)
                key, size = grams(data, depth), coded(starts, depth)
                between = (starts[1:-1, None] - 1 - np.arange(depth)).ravel()  # grams that would cross texts
                for chosen, weight in ((own, 1), (~own, 0)):
                    if chosen.all():
                        keep = np.ones(len(key), bool)
                    else:
                        turn = np.zeros(len(key) + 1, np.int8)
                        np.add.at(turn, starts[:-1][chosen], 1)
                        np.add.at(turn, np.minimum(starts[:-1][chosen] + size[chosen], len(key)), -1)
                        keep = np.cumsum(turn[:-1], dtype=np.int8).astype(bool)
                    keep[between] = False
                    some, times = tally(key[keep])
                    fresh[GRAM].append((some, times * weight))
                for kind in (WORD, GRAM):
                    if sum(len(k) for k, _ in fresh[kind]) > GATHERED:
                        sorted_in(kind)
                        if len(held[kind][0]) > HELD:
                            yield from passed_on(kind)
        for kind in (WORD, GRAM):
            sorted_in(kind)
            yield from passed_on(kind)
        yield _rows(TOTAL, [0], [2], [pack_run(np.arange(2, dtype=np.uint64), np.array([tokens, n_train], np.int64))])

    return scan


def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (kind, part): one run for each."""
    at, found, size = None, [], 0

    def whole() -> pa.RecordBatch:
        keys, sums = merged(found)
        return _rows(at[0], [at[1]], [len(keys)], [pack_run(keys, sums)])

    for batch in batches:
        for kind, part, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if at is not None and at != (kind, part):
                yield whole()
                found, size = [], 0
            at = (kind, part)
            found.append(unpack_run(run.as_buffer()))
            size += len(found[-1][0])
            if size > 2 * len(found[0][0]) + GATHERED:  # sums are taken before there are many copies
                found = [merged(found)]
                size = len(found[0][0])
    if found:
        yield whole()


def _lgamma_table(most: int = 1 << 16) -> np.ndarray:
    """log of the gamma function at k + 1/2."""
    steps = np.log(np.arange(most, dtype=np.float64) + 0.5)
    return np.concatenate(([0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(steps)))


_HALF = _lgamma_table()
_WHOLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 1 << 16, dtype=np.float64)))))


def _looked_up(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    """log gamma(n + shift): a table, and Stirling's series beyond it."""
    out = table[np.minimum(n, len(table) - 1)]
    far = np.nonzero(n >= len(table))
    if len(far[0]):
        x = n[far] + shift
        out[far] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_half_gamma(n: np.ndarray) -> np.ndarray:
    return _looked_up(_HALF, n, 0.5)


def log_factorial(n: np.ndarray) -> np.ndarray:
    return _looked_up(_WHOLE, n, 1.0)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log block probability of n0 zeros and n1 ones under the estimator."""
    return log_half_gamma(n0) + log_half_gamma(n1) - math.log(math.pi) - log_factorial(n0 + n1)


def weigh(n0: np.ndarray, n1: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log weighted probability of nodes with children, and the weight of their own estimate given the training text."""
    own = log_kt(n0, n1)
    both = np.logaddexp(own, log_children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def nearest_first(key: np.ndarray, depth: int) -> np.ndarray:
    """The gram with its context from the nearest byte to the oldest, and the coded byte last."""
    out = key & U64(0xFF)
    for k in range(1, depth + 1):
        out |= ((key >> U64(8 * k)) & U64(0xFF)) << U64(8 * (depth + 1 - k))
    return out


def bit_of(key: np.ndarray, level: int) -> np.ndarray:
    return ((key >> U64(7 - level)) & U64(1)).astype(bool)


def node_of(key: np.ndarray, level: int) -> np.ndarray:
    """Node of a byte's decision at ``level``: a one and the bits before it."""
    return ((key & U64(0xFF)) >> U64(8 - level)).astype(np.int64) | (1 << level)


class Nodes:
    """Context nodes of one depth for one of the eight decisions, by grams sorted nearest byte first."""

    def __init__(self, key: np.ndarray, n: np.ndarray, level: int):
        place = key >> U64(8 - level)
        new = np.append(True, place[1:] != place[:-1])
        self.first = np.flatnonzero(new)
        self.of = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.bit = bit_of(key, level)
        self.n1 = np.add.reduceat(n * self.bit, self.first)
        self.n0 = np.add.reduceat(n, self.first) - self.n1
        self.logp = self.post = None

    def taken(self) -> np.ndarray:
        """The estimator's probability of each gram's bit."""
        both = self.n0 + self.n1 + 1.0
        return np.where(self.bit, ((self.n1 + 0.5) / both)[self.of], ((self.n0 + 0.5) / both)[self.of])


class Subtrees:
    """All context nodes from ``depth`` bytes down to ``top`` bytes, of grams that hold whole subtrees.

    The eight decisions of a byte have trees of their own, which are worked out one after another.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        key = nearest_first(key, depth)
        self.order = np.argsort(key)
        self.key, self.n, self.up = {depth: key[self.order]}, {depth: n[self.order].astype(np.int64)}, {}
        for d in range(depth - 1, top - 1, -1):
            deeper = self.key[d + 1]
            self.key[d], self.up[d] = np.unique(((deeper >> U64(16)) << U64(8)) | (deeper & U64(0xFF)), return_inverse=True)
            self.n[d] = np.bincount(self.up[d], self.n[d + 1], len(self.key[d])).astype(np.int64)

    def nodes(self, level: int) -> dict[int, Nodes]:
        out = {}
        for d in range(self.depth, self.top - 1, -1):
            t = out[d] = Nodes(self.key[d], self.n[d], level)
            if d == self.depth:
                t.logp = log_kt(t.n0, t.n1)
            else:
                below = out[d + 1]
                t.logp, t.post = weigh(t.n0, t.n1, np.bincount(t.of[self.up[d][below.first]], below.logp, len(t.first)))
        return out

    def bits(self, base: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Code length of each gram, in the order they were given; ``base`` and ``left`` are what the levels above ``top`` give and leave."""
        total = np.zeros(len(self.order))
        for level in range(8):
            nodes = self.nodes(level)
            key = self.key[self.top]
            above, node = (key >> U64(8 * self.top)).astype(np.int64), node_of(key, level)
            p, rest = base[above, node, nodes[self.top].bit.astype(np.int64)], left[above, node]
            for d in range(self.top, self.depth + 1):
                t = nodes[d]
                if d > self.top:
                    p, rest = p[self.up[d - 1]], rest[self.up[d - 1]]
                if d == self.depth:
                    total -= np.log2(p + rest * t.taken())
                else:
                    post = t.post[t.of]
                    p += rest * post * t.taken()
                    rest = rest * (1 - post)
        out = np.empty(len(total))
        out[self.order] = total
        return out


NODE = "c1 int, node int, n0 double, n1 double, logp double"


def _blocks(key: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts in runs of whole two-byte contexts."""
    last = ((key >> U64(8)) & U64(0xFFFF)).astype(np.uint16)
    order = np.argsort(last, kind="stable")
    key, n, last = key[order], n[order], last[order]
    ends = np.append(np.flatnonzero(last[1:] != last[:-1]) + 1, len(key))
    i = 0
    while i < len(key):
        j = int(ends[max(np.searchsorted(ends, i + BLOCK, "right") - 1, np.searchsorted(ends, i, "right"))])
        yield key[i:j], n[i:j]
        i = j


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for run in batch.column(0):
            yield from _blocks(*unpack_run(run.as_buffer()))
    release()


def _top_nodes(depth: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 256, 256))
        for key, n in _runs(batches):
            trees = Subtrees(key, n, depth, 2)
            for level in range(8):
                t = trees.nodes(level)[2]
                first = trees.key[2][t.first]
                where = ((first >> U64(16)).astype(np.int64) << 8) | node_of(first, level)
                for k, x in enumerate((t.n0, t.n1, t.logp)):
                    sums[k] += np.bincount(where, x, 1 << 16).reshape(256, 256)
        c1, node = np.nonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(c1.astype(np.int32)), pa.array(node.astype(np.int32)), *[pa.array(x[c1, node]) for x in sums]], ["c1", "node", "n0", "n1", "logp"])

    return scan


def upper_levels(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """From sums by (last byte, node): what depths 0 and 1 add to a bit's probability, and what they leave to depth 2.

    Arrays (256 last bytes, 256 nodes, bit) and (256, 256).
    """
    n0, n1, children = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for c1, node, a, b, logp in rows:
        n0[c1, node], n1[c1, node], children[c1, node] = a, b, logp
    logp, post1 = weigh(n0.astype(np.int64), n1.astype(np.int64), children)
    m0, m1 = n0.sum(axis=0), n1.sum(axis=0)
    _, post0 = weigh(m0.astype(np.int64), m1.astype(np.int64), logp.sum(axis=0))
    kt1 = np.stack(((n0 + 0.5), (n1 + 0.5)), axis=2) / (n0 + n1 + 1.0)[:, :, None]
    kt0 = np.stack(((m0 + 0.5), (m1 + 0.5)), axis=1) / (m0 + m1 + 1.0)[:, None]
    base = post0[None, :, None] * kt0[None] + (1 - post0)[None, :, None] * post1[:, :, None] * kt1
    return base, (1 - post0)[None, :] * (1 - post1)


def spread(key: np.ndarray) -> np.ndarray:
    """Another name for each 64-bit key, evenly spread."""
    return mix(key * U64(0x9E3779B97F4A7C15))


def shard_of(name: np.ndarray, shards: int) -> np.ndarray:
    """By the leading 32 bits of names that are evenly spread."""
    return ((name >> U64(32)) * U64(shards)) >> U64(32)


SHARD = "shard int, run binary"


def _sharded(names: np.ndarray, values: np.ndarray, shards: int) -> pa.RecordBatch:
    order = np.argsort(names)
    names, values = names[order], values[order]
    cuts = np.searchsorted(shard_of(names, shards), np.arange(shards + 1))
    runs = [pack_run(names[a:b], values[a:b]) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array(runs, pa.binary())], ["shard", "run"])


def _gram_bits(depth: int, base: np.ndarray, left: np.ndarray, shards: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _runs(batches):
            yield _sharded(spread(key), Subtrees(key, n, depth, 2).bits(base, left), shards)

    return scan


def _word_values(denominator: float, shards: int):
    """By how much more than an unknown word each known one adds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0):
                key, n = unpack_run(run.as_buffer())
                yield _sharded(key, np.log10((n + 1) / denominator) + math.log10(denominator), shards)

    return scan


class Table:
    """One shard of a table from evenly spread 64-bit name to number, read from its Parquet files."""

    def __init__(self, path: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        found = [(np.zeros(0, np.uint64), np.zeros(0))]
        if files.get_file_info(folder).type == fs.FileType.Directory:
            for f in files.get_file_info(fs.FileSelector(folder)):
                if f.path.endswith(".parquet"):
                    for batch in pq.ParquetFile(f.path, filesystem=files).iter_batches(16, columns=["run"]):
                        found += [unpack_run(x.as_buffer(), np.float64) for x in batch.column(0)]
        names, values = [x for x, _ in found], [x for _, x in found]
        del found
        names = np.concatenate(names)
        order = np.argsort(names)
        names = names[order]
        values = np.concatenate([*values, np.zeros(1)])
        values[:-1] = values[:-1][order]
        del order
        self.directory, self.value = Directory(names), values

    def get(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent), and which are there."""
        at = self.directory.find(names)
        return self.value[at], at >= 0


_TABLES: dict[str, tuple[str, Table]] = {}


def _table(kind: str, path: str) -> Table:
    """A task holds one shard of words and one of grams."""
    if kind not in _TABLES or _TABLES[kind][0] != path:
        _TABLES.pop(kind, None)
        release()
        _TABLES[kind] = path, Table(path)
        release()
    return _TABLES[kind][1]


PART = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, bits double"


def _score(depth: int, words: str | None, gram: str | None, turn: int, shards: tuple[int, int], n_docs: int, denominator: float):
    """Adds what one shard of each table knows; the first pass also counts tokens and the end."""
    unknown = -math.log10(denominator)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_table = _table("words", words) if words else None
        gram_table = _table("grams", gram) if gram else None
        for batch in batches:
            raw, off = text_bytes(batch.column(2))
            n_rows = batch.num_rows
            n_tokens, n_known, n_bytes = (np.zeros(n_rows, np.int64) for _ in range(3))
            base, bits = np.zeros(n_rows), np.zeros(n_rows)
            for i, j in chunks(off, 1 << 20):
                low = LOWER[raw[off[i] : off[j]]]
                rel = off[i : j + 1] - off[i]
                if word_table is not None or turn == 0:
                    start, end, reach = split_words(low, rel)
                    n = np.diff(reach)
                    if turn == 0:
                        n_tokens[i:j] = n + 1
                        n_bytes[i:j] = np.diff(rel) + 1
                        n_known[i:j] = n_docs > 0
                        base[i:j] = n * unknown + math.log10((n_docs + 1) / denominator)
                    if word_table is not None:
                        value, there = word_table.get(Hasher(low).ranges(start, end))
                        owner = np.repeat(np.arange(j - i), n)
                        n_known[i:j] += np.bincount(owner, there, j - i).astype(np.int64)
                        base[i:j] += np.bincount(owner, value, j - i)
                if gram_table is not None:
                    data, starts = padded(low, rel, depth)
                    name = spread(grams(data, depth))
                    value = np.zeros(len(name) + 1)
                    if shards[1] > 1:
                        mine = np.flatnonzero(shard_of(name, shards[1]) == turn)
                        value[mine] = gram_table.get(name[mine])[0]
                    else:
                        value[:-1] = gram_table.get(name)[0]
                    reach = np.stack((starts[:-1], starts[:-1] + coded(starts, depth)), axis=1).ravel()
                    bits[i:j] += np.add.reduceat(value, reach)[::2]
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(is_held_out(ids.to_pylist())), *map(pa.array, (n_tokens, n_known, n_bytes, base, bits))], [x.split(" ")[0] for x in PART.split(", ")])

    return scan


def score_documents(docs: DataFrame, depth: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    Texts are scored whole, in small letters (A-Z), as UTF-8 bytes with an end; null texts are empty. ``score`` is the
    base-10 logarithm of the model's probability of the text, ``bits_per_byte`` the code length it stands for over the
    bytes and the end, ``base_score`` the logarithm under a word model with add-one counts. Rows that repeat an id are
    scored each and fall into one fold; a null id counts as an empty one; an empty table gives no rows; of other
    columns none is read. A long text is coded in one piece: a task holds some 60 bytes for each of its bytes.
    Depth 2 to 7. ``docs`` is read again for each shard and must give its rows in the same order (a stored table does).
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = min(1 << 14, max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counted = texts.mapInArrow(count(depth, parts), RUN)
    runs = runtime.staged(counted.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(join_runs, RUN), "runs")
    totals = [unpack_run(bytes(r["run"]))[1] for r in runs.where(F.col("kind") == TOTAL).collect()]  # two numbers
    n_tokens, n_docs = (int(x) for x in totals[0]) if totals else (0, 0)
    distinct = {r["kind"]: int(r["n"]) for r in runs.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # by kind
    denominator = distinct.get(WORD, 0) + n_tokens + (n_docs > 0) + 1.0
    shards = tuple(max(1, -(-distinct.get(k, 0) // most)) for k, most in ((WORD, WORD_SHARD), (GRAM, GRAM_SHARD)))

    def written(table: DataFrame, label: str) -> str:
        path = runtime.fresh_path(spark, label)
        table.write.partitionBy("shard").parquet(path)
        return path

    words = written(runs.where(F.col("kind") == WORD).select("run").mapInArrow(_word_values(denominator, shards[0]), SHARD), "word-values")
    rows = runs.where(F.col("kind") == GRAM).select("run")
    top = rows.mapInArrow(_top_nodes(depth), NODE).groupBy("c1", "node").agg(F.sum("n0"), F.sum("n1"), F.sum("logp")).collect()  # at most 256 * 255 rows
    grams_at = written(rows.mapInArrow(_gram_bits(depth, *upper_levels(top), shards[1]), SHARD), "gram-values")

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    passes = []
    for k in range(max(shards)):
        w, g = (f"{path}/shard={k}" if k < n else None for path, n in zip((words, grams_at), shards))
        passes.append(numbered.mapInArrow(_score(depth, w, g, k, shards, n_docs, denominator), PART))
    out = passes[0]
    if len(passes) > 1:
        for p in passes[1:]:
            out = out.unionByName(p)
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base", "bits")])
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("bits") * -math.log10(2)).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte")
    )
