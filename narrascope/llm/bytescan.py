"""Vectorised scans over the UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 19


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) + U64(seed)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = _splitmix(256, 77)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(n: int, name: str, base: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _POWERS[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes ``x``."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Hasher:
    """Polynomial hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data = data
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[data] * _powers(n, "p", _BASE), out=self.prefix[1:])
        self.inverse = _powers(n + 1, "i", _BASE_INV)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Well mixed; the length takes part."""
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    def windows(self, width: int) -> np.ndarray:
        """Of every window of ``width`` bytes."""
        if len(self.prefix) <= width:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.prefix[width:] - self.prefix[:-width]) * self.inverse[: len(self.prefix) - width])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    kind = np.int64 if wide else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def release() -> None:
    """Give freed memory back to the system: a worker process outlives its task and keeps it otherwise."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def chunks(off: np.ndarray, most: int = CHUNK):
    """Row ranges whose bytes together stay near ``most`` (one long text may exceed it)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
    release()


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not white space."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~IS_SPACE[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def split_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end: starts, ends, and the number of words before each text (n + 1 long)."""
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[solid[cut] & solid[cut - 1]]
    first[both] = True
    last[both - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


class Directory:
    """Sorted unique 64-bit keys found by their leading bits: about three memory reads a key."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, U64(0xFFFFFFFFFFFFFFFF))
        self.bits = min(26, max(1, int(len(keys)).bit_length()))
        self.shift = U64(64 - self.bits)
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.n = len(keys)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, -1 where it is absent."""
        at = self.first[wanted >> self.shift].astype(np.int64)
        seen = self.keys[at]
        todo = np.flatnonzero(seen < wanted)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < wanted[todo]]
        at[(self.keys[at] != wanted) | (at >= self.n)] = -1
        return at
