"""Byte-level BPE over whole columns: every distinct piece is encoded once by the tokenizers library, the rest is array work.

A text may be cut before a single space, or around a single line feed, that stands between two letters,
digits or marks, and between a letter and a stop: the pre-tokenizer of these vocabularies ends a token there
in any case. Pieces recur far
more often than texts, so a process keeps the ids of the pieces it has met (keyed by 64-bit hash, at most
``CACHE`` pieces, then it starts anew). Strings of special tokens in a text become their ids, as in a plain call of the
library; a vocabulary whose special strings could be cut, or take white space with them, is refused.
"""

from __future__ import annotations

import json
import os

import numpy as np

from narrascope.llm.bytescan import Directory, Hasher, _splitmix

CACHE = 300_000

_GRAPHIC = np.zeros(256, dtype=bool)
_GRAPHIC[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = True
_LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True
_LATIN = 0xC3


def _unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin; each text begins one."""
    n = len(data)
    start = np.zeros(n + 1, dtype=bool)
    if n > 2:
        solid = _GRAPHIC[data]
        before = solid.copy()
        before[1:] |= (data[:-1] == _LATIN) & (data[1:] >= 0x80)
        after = solid | (data == _LATIN)
        edge = before[:-2] & after[2:]
        mid = data[1:-1]
        gap = np.flatnonzero(edge & ((mid == 0x20) | (mid == 0x0A))) + 1
        start[gap] = True
        lf = gap[data[gap] == 0x0A]
        start[lf + 1] = True
        start[1:n] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    start[off] = True
    start[n] = False
    return np.flatnonzero(start)


def _byte_lengths(tokenizer, path: str) -> np.ndarray:
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    added = tokenizer.get_added_tokens_decoder()
    size = np.ones(max([*vocab.values(), *added]) + 1, dtype=np.int64)
    for token, i in vocab.items():
        size[i] = len(token)  # one character stands for one byte
    for i, token in added.items():
        size[i] = len(token.content.encode())
    return size


class PieceEncoder:
    """Encodes texts that lie end to end in one buffer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        for t in self.tokenizer.get_added_tokens_decoder().values():
            held = np.frombuffer(t.content.encode(), np.uint8)
            if t.lstrip or t.rstrip or t.single_word or len(_unit_starts(held, np.zeros(1, np.int64))) > 1:
                raise ValueError(f"pieces do not keep the special token {t.content!r} whole")
        self.size = _byte_lengths(self.tokenizer, path)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint16 if len(self.size) <= 1 << 16 else np.uint32)
        self.directory = Directory(self.keys)
        self.new_keys, self.new_at, self.new_count = [], [], []
        self.extra: dict[int, tuple[int, int]] = {}

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        first, last = data[starts], data[ends - 1]
        spaced = (first == 0x20) & (ends - starts > 1) & _GRAPHIC[last]
        plain = _GRAPHIC[first] & _GRAPHIC[last]
        counts = np.zeros(len(starts), np.int32)
        pieces = []
        order = []
        for chosen, glue in ((np.flatnonzero(spaced), b""), (np.flatnonzero(plain), b"\n"), (np.flatnonzero(~spaced & ~plain), None)):
            if len(chosen):
                texts = [data[s:e].tobytes() for s, e in zip(starts[chosen].tolist(), ends[chosen].tolist())]
                ids, n = self._encode(texts, glue)
                counts[chosen] = n
                pieces.append(ids)
                order.append(chosen)
        order = np.concatenate(order)
        at = np.empty(len(starts), np.int64)
        at[order] = len(self.pool) + np.concatenate(([0], np.cumsum(counts[order])[:-1]))
        self.pool = np.concatenate((self.pool, np.concatenate(pieces).astype(self.pool.dtype)))
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys)
        self.directory = Directory(keys[order])
        self.keys = self.directory.keys[:-1]
        self.at = np.concatenate((self.at, at))[order]
        self.count = np.concatenate((self.count, counts))[order]

    def _encode(self, texts: list[bytes], glue: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and the number of ids of each.

        Pieces that start with a space follow one another as they would in a text; others are set apart by
        line feeds, which are tokens of their own there. With no glue every piece goes alone.
        """
        if glue is None:
            each = [x.ids for x in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]
            return np.array([i for x in each for i in x], dtype=np.int64), np.array([len(x) for x in each], dtype=np.int32)
        groups, group, held = [], [], 0
        for t in texts:
            group.append(t)
            held += len(t)
            if held > 4000:
                groups.append(group)
                group, held = [], 0
        if group:
            groups.append(group)
        done = self.tokenizer.encode_batch_fast([(glue.join(g) + glue).decode("utf-8") for g in groups], add_special_tokens=False)
        ids, counts = [], []
        for g, x in zip(groups, done):
            got = np.array(x.ids, dtype=np.int64)
            reach = np.cumsum(self.size[got])
            cuts = np.cumsum([len(t) + len(glue) for t in g])
            stop = np.searchsorted(reach, cuts)
            if len(reach) and reach[-1] == cuts[-1] and np.array_equal(reach[stop], cuts):
                n = np.diff(np.concatenate(([0], stop + 1)))
                if glue:
                    keep = np.ones(len(got), bool)
                    keep[stop] = False
                    got, n = got[keep], n - 1
                ids.append(got)
                counts.append(n)
            else:  # a piece reaches into its neighbour: one by one
                alone = self._encode(g, None)
                ids.append(alone[0])
                counts.append(alone[1])
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts ``data[off[i]:off[i + 1]]`` and the number of ids of each text. ``off[0]`` is 0."""
        n_text = len(off) - 1
        if off[-1] == 0:
            return np.zeros(0, self.pool.dtype), np.zeros(n_text, np.int64)
        if len(self.keys) > CACHE:  # before anything is looked up: what these texts need must be there together
            self._reset()
        starts = _unit_starts(data, off[:-1][off[:-1] < off[-1]])
        ends = np.append(starts[1:], len(data))
        keys = Hasher(data).ranges(starts, ends)
        found = self.directory.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, first = np.unique(keys[missing], return_index=True)
            pick = missing[first]
            self._learn(data, starts[pick], ends[pick], fresh)
            found = self.directory.find(keys)
        count = self.count[found].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(self.at[found] - total[:-1], count) + np.arange(total[-1])]
        bound = total[np.searchsorted(starts, off)]
        return ids, np.diff(bound)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
