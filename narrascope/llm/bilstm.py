"""A character tagger in NumPy: bidirectional LSTM, linear-chain CRF, Adam; batches of windows of equal length.

Labels are 0 (outside) and, for kind k, 1 + 2k (first character) and 2 + 2k (the others). Characters enter by class:
printable ASCII each its own, other letters, digits, white space and the rest by group, and one for padding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD, N_CLASSES = 0, 102


def _class_table() -> np.ndarray:
    table = np.full(256, 96, dtype=np.uint8)
    table[0x20:0x7F] = np.arange(1, 96)
    for c in "\t\n\v\f\r":
        table[ord(c)] = 97
    return table


_ASCII = _class_table()


def classes(text: str) -> np.ndarray:
    """One class a code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _ASCII[np.minimum(points, 255)]
    for at in np.flatnonzero(points > 127).tolist():
        c = chr(points[at])
        out[at] = 98 if c.isupper() else 99 if c.isalpha() else 100 if c.isdigit() else 97 if c.isspace() else 101
    return out


@dataclass
class Tagger:
    """Weights: input tables and recurrences of both directions, the output layer, transitions and first scores."""

    weights: dict[str, np.ndarray]

    @property
    def labels(self) -> int:
        return self.weights["first"].shape[0]

    @staticmethod
    def fresh(kinds: int, hidden: int, seed: int) -> Tagger:
        draw, n = np.random.default_rng(seed), 2 * kinds + 1
        some = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
        w = {}
        for d in "fb":
            w[f"in_{d}"] = some(N_CLASSES, 4 * hidden, by=0.3)
            w[f"in_{d}"][:, hidden : 2 * hidden] += 1.0  # cells begin by remembering
            w[f"re_{d}"] = some(hidden, 4 * hidden, by=0.5 / np.sqrt(hidden))
        w["out"], w["bias"] = some(2 * hidden, n, by=0.3), np.zeros(n, np.float32)
        w["step"], w["first"] = np.zeros((n, n), np.float32), np.zeros(n, np.float32)
        for k in range(kinds):  # an inner character follows one of its kind: fixed, not learnt
            w["step"][:, 2 + 2 * k] = -30
            w["step"][[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
            w["first"][2 + 2 * k] = -30
        return Tagger(w)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, hidden) of one direction; what the way back needs, if kept."""
        table, re = self.weights[f"in_{d}"], self.weights[f"re_{d}"]
        h = re.shape[0]
        steps, batch = x.shape
        state, cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        out, held = np.empty((steps, batch, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[t]] + state @ re
            gates = 0.5 * np.tanh(0.5 * z[:, : 3 * h]) + 0.5  # input, forget, output
            new = np.tanh(z[:, 3 * h :])
            before, was = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            bent = np.tanh(cell)
            state = gates[:, 2 * h :] * bent
            out[t] = state
            if keep:
                held.append((t, gates, new, before, was, bent))
        return out, held

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, label) of windows given as (time, batch) classes."""
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2)
        return both @ self.weights["out"] + self.weights["bias"]

    def _chains(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward sums, the factors of each step, and log of the whole."""
        steps = e.shape[0]
        peak = e.max(axis=2, keepdims=True)
        emit, move = np.exp(e - peak), np.exp(self.weights["step"])
        alpha, beta, size = np.empty_like(emit), np.empty_like(emit), np.empty(e.shape[:2], np.float32)
        a = np.exp(self.weights["first"]) * emit[0]
        for t in range(steps):
            if t:
                a = (a @ move) * emit[t]
            size[t] = a.sum(axis=1)
            a = a / size[t][:, None]
            alpha[t] = a
        b = np.ones_like(a)
        beta[-1] = b
        for t in range(steps - 2, -1, -1):
            b = ((b * emit[t + 1]) @ move.T) / size[t + 1][:, None]
            beta[t] = b
        return alpha, beta, emit / size[:, :, None], (np.log(size) + peak[:, :, 0]).sum(axis=0)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of labels (time, batch), and its gradient."""
        w, (steps, batch) = self.weights, x.shape
        fwd, held_f = self._run(x, "f", True)
        bwd, held_b = self._run(x, "b", True)
        both = np.concatenate([fwd, bwd], axis=2)
        e = both @ w["out"] + w["bias"]
        alpha, beta, emit, whole = self._chains(e)
        of = np.arange(batch)
        gold = e[np.arange(steps)[:, None], of, y].sum(axis=0) + w["first"][y[0]] + w["step"][y[:-1], y[1:]].sum(axis=0)
        de = alpha * beta
        g = {"first": de[0].sum(axis=0), "step": np.zeros_like(w["step"])}
        move = np.exp(w["step"])
        for t in range(1, steps):
            g["step"] += move * (alpha[t - 1].T @ (beta[t] * emit[t]))
        np.subtract.at(g["step"], (y[:-1], y[1:]), 1)
        np.subtract.at(g["first"], y[0], 1)
        de[np.arange(steps)[:, None], of, y] -= 1
        g["out"] = np.einsum("tbh,tbl->hl", both, de)
        g["bias"] = de.sum(axis=(0, 1))
        back, h = de @ w["out"].T, fwd.shape[2]
        for d, held, part in (("f", held_f, back[:, :, :h]), ("b", held_b, back[:, :, h:])):
            g[f"in_{d}"], g[f"re_{d}"] = self._back(x, d, held, part)
        fixed = w["step"] <= -30
        g["step"][fixed], g["first"][w["first"] <= -30] = 0, 0
        return float((whole - gold).mean()), {k: v / batch for k, v in g.items()}

    def _back(self, x: np.ndarray, d: str, held: list, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        re = self.weights[f"re_{d}"]
        h = re.shape[0]
        g_in, g_re, one = np.zeros_like(self.weights[f"in_{d}"]), np.zeros_like(re), np.eye(N_CLASSES, dtype=re.dtype)
        d_state, d_cell = np.zeros_like(part[0]), np.zeros_like(part[0])
        for t, gates, new, before, was, bent in reversed(held):
            d_state = d_state + part[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            d_cell = d_cell + d_state * o * (1 - bent * bent)
            dz = np.concatenate([d_cell * new * i * (1 - i), d_cell * before * f * (1 - f), d_state * bent * o * (1 - o), d_cell * i * (1 - new * new)], axis=1)
            g_in += one[x[t]].T @ dz
            g_re += was.T @ dz
            d_state, d_cell = dz @ re.T, d_cell * f
        return g_in, g_re

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> list[float]:
        """Adam over random batches of windows (time, all); returns the losses."""
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for n in range(1, steps + 1):
            pick = draw.integers(0, x.shape[1], batch)
            loss, g = self.gradient(x[:, pick], y[:, pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            now = rate * min(1.0, 2 * (1 - (n - 1) / steps))
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                self.weights[k] -= (now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels (time, batch), and the probability of each under the whole window."""
        e = self.scores(x)
        steps, batch, n = e.shape
        best, back = self.weights["first"] + e[0], np.empty((steps, batch, n), np.int8)
        for t in range(1, steps):
            way = best[:, :, None] + self.weights["step"]
            back[t] = way.argmax(axis=1)
            best = way.max(axis=1) + e[t]
        path, of = np.empty((steps, batch), np.int64), np.arange(batch)
        path[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][of, path[t]]
        alpha, beta, _, _ = self._chains(e)
        sure = alpha * beta
        return path, (sure / sure.sum(axis=2, keepdims=True))[np.arange(steps)[:, None], of, path]
