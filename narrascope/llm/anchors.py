"""Anchored runs: every window of ``length`` bytes is named by the least hashed q-gram inside it (the leftmost of equals).

Windows that share an anchor position form a run. The anchor is chosen by content alone, so equal windows of any
two texts lie in runs with equal anchors.
"""

from __future__ import annotations

import numpy as np

from narrascope.llm.bytescan import U64, Hasher

_POSITION_BITS = 24
_SEGMENT = 1 << 18


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Runs:
    """start, n (windows), anchor (position) of each run, and the text it lies in."""

    def __init__(self, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, text: np.ndarray):
        self.start, self.n, self.anchor, self.text = start, n, anchor, text


def find_runs(hasher: Hasher, off: np.ndarray, q: int, length: int) -> tuple[Runs, np.ndarray]:
    """Runs of texts that lie end to end (no window crosses texts), and the anchors' hashes."""
    grams = hasher.windows(q)
    total = int(off[-1]) - length + 1
    if total <= 0:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none), np.zeros(0, np.uint64)
    anchor = np.empty(total, np.int64)
    width, low = length - q + 1, U64((1 << _POSITION_BITS) - 1)
    for a in range(0, total, _SEGMENT):
        b = min(total, a + _SEGMENT)
        keys = (grams[a : b + width - 1] & ~low) | np.arange(b + width - 1 - a, dtype=np.uint64)
        anchor[a:b] = (sliding_min(keys, width) & low).astype(np.int64) + a
    bad = np.zeros(total + 1, np.int32)
    cuts = off[1:-1]
    np.add.at(bad, np.clip(cuts - length + 1, 0, total), 1)
    np.add.at(bad, np.minimum(cuts, total), -1)
    bad = np.cumsum(bad[:-1]) > 0
    anchor[bad] = -1
    edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    start = np.concatenate(([0], edge))
    n = np.diff(np.append(start, total))
    at = anchor[start]
    text = np.searchsorted(off, start, side="right") - 1
    # two texts' windows never touch: at least length - 1 bad ones lie between them
    good = at >= 0
    start, n, at, text = start[good], n[good], at[good], text[good]
    return Runs(start, n, at, text), grams[at]
