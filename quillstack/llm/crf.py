"""A linear-chain conditional random field in numpy.

A position is described by the features of its own unit (a word, a line) and of its neighbours, so scores are computed once per distinct
unit and gathered along the sequences. Sequences are trained and decoded in padded batches.
"""

from __future__ import annotations

import numpy as np


class Chain:
    """``offsets`` are the neighbours looked at; features unknown in training have no weight."""

    def __init__(self, labels: list[str], offsets: tuple[int, ...] = (-1, 0, 1)):
        self.labels, self.offsets = labels, offsets
        self.index: dict[str, int] = {}

    # Units: lists of features. Unit 0 is the edge of a sequence.
    def flat(self, units: list[list[str]], grow: bool = False) -> tuple[np.ndarray, np.ndarray]:
        ids, owner = [], []
        for u, feats in enumerate(units):
            for f in feats:
                k = self.index.setdefault(f, len(self.index)) if grow else self.index.get(f, -1)
                if k >= 0:
                    ids.append(k)
                    owner.append(u)
        return np.array(ids, np.int64), np.array(owner, np.int64)

    def tables(self, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores of every distinct unit seen from each offset: (offsets, units, labels)."""
        out = np.zeros((len(self.offsets), n, len(self.labels)))
        for o in range(len(self.offsets)):
            for k in range(len(self.labels)):
                out[o, :, k] = np.bincount(owner, self.weights[o, ids, k], n)
        return out

    def emissions(self, table: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """(sequences, length, labels) of padded unit ids; 0 pads and stands beyond the edges."""
        s, t = seq.shape
        out = np.zeros((s, t, len(self.labels)))
        reach = max(abs(o) for o in self.offsets)
        wide = np.zeros((s, t + 2 * reach), seq.dtype)
        wide[:, reach : reach + t] = seq
        for k, o in enumerate(self.offsets):
            out += table[k][wide[:, reach + o : reach + o + t]]
        return out

    def fit(self, units: list[list[str]], seq: np.ndarray, gold: np.ndarray, rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> Chain:
        """Adam on the whole set. ``seq`` holds unit ids (0 pads), ``gold`` label numbers."""
        ids, owner = self.flat(units, grow=True)
        n, L = len(units), len(self.labels)
        self.weights = np.zeros((len(self.offsets), len(self.index), L))
        self.moves, self.first = np.zeros((L, L)), np.zeros(L)
        lengths = (seq > 0).sum(1)
        size = lengths.sum()
        order = np.argsort(lengths, kind="stable")
        parts = [(seq[k, : lengths[k].max()], np.eye(L, dtype=np.float32)[gold[k, : lengths[k].max()]] * (seq[k, : lengths[k].max()] > 0)[:, :, None]) for k in np.array_split(order, 6) if len(k)]
        state = [np.zeros_like(p) for p in (self.weights, self.moves, self.first) for _ in range(2)]
        for r in range(1, rounds + 1):
            table = self.tables(ids, owner, n).astype(np.float32)
            grad, moves, first = np.zeros_like(self.weights), np.zeros_like(self.moves), np.zeros_like(self.first)
            unit = np.zeros((len(self.offsets), n, L))
            for some, want in parts:  # sequences of like length together
                self.expected(table, some, want, unit, moves, first)
            for k in range(len(self.offsets)):
                for j in range(L):
                    grad[k, :, j] = np.bincount(ids, unit[k, owner, j], len(self.index))
            grads = (grad / size + ridge * self.weights / 10, moves / size + ridge * self.moves, first / size)
            for k, (x, g) in enumerate(zip((self.weights, self.moves, self.first), grads)):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        self.weights = self.weights.astype(np.float32)
        return self

    def expected(self, table: np.ndarray, seq: np.ndarray, want: np.ndarray, unit: np.ndarray, moves: np.ndarray, first: np.ndarray) -> None:
        """Add expected minus wanted counts of units, moves and first labels (forward-backward, scaled at each step)."""
        s, t = seq.shape
        L, live = len(self.labels), seq > 0
        e = self.emissions(table, seq).astype(np.float32)
        top = e.max(2, keepdims=True)
        p_e, p_m = np.exp(e - top), np.exp(self.moves).astype(np.float32)
        a, b = np.empty((s, t, L), np.float32), np.ones((s, t, L), np.float32)
        x = p_e[:, 0] * np.exp(self.first).astype(np.float32)
        a[:, 0] = x / x.sum(1, keepdims=True)
        for i in range(1, t):
            x = (a[:, i - 1] @ p_m) * p_e[:, i]
            a[:, i] = np.where(live[:, i, None], x / x.sum(1, keepdims=True), a[:, i - 1])
        for i in range(t - 2, -1, -1):
            x = (p_e[:, i + 1] * b[:, i + 1]) @ p_m.T
            b[:, i] = np.where(live[:, i + 1, None], x / x.sum(1, keepdims=True), 1.0)
        p = a * b
        p = p / p.sum(2, keepdims=True) * live[:, :, None]
        ahead = p_e[:, 1:] * b[:, 1:]
        both = np.einsum("sti,ij,stj->st", a[:, :-1], p_m, ahead)
        scale = np.divide(live[:, 1:], both, out=np.zeros_like(both), where=both > 0)
        moves += np.einsum("sti,stj->ij", a[:, :-1] * scale[:, :, None], ahead) * p_m - np.einsum("sti,stj->ij", want[:, :-1], want[:, 1:])
        first += (p[:, 0] - want[:, 0]).sum(0)
        d = p - want
        reach = max(abs(o) for o in self.offsets)
        wide = np.zeros((s, t + 2 * reach), seq.dtype)
        wide[:, reach : reach + t] = seq
        for k, o in enumerate(self.offsets):
            near = wide[:, reach + o : reach + o + t].ravel()
            for j in range(L):
                unit[k, :, j] += np.bincount(near, d[:, :, j].ravel(), unit.shape[1])

    def decode(self, table: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Viterbi over padded sequences: label numbers."""
        s, t = seq.shape
        e = self.emissions(table, seq)
        live = seq > 0
        back = np.zeros((s, t, len(self.labels)), np.int8)
        score = e[:, 0] + self.first
        for i in range(1, t):
            step = score[:, :, None] + self.moves[None]
            back[:, i] = step.argmax(1)
            score = np.where(live[:, i, None], step.max(1) + e[:, i], score)
        out = np.zeros((s, t), np.int64)
        at = score.argmax(1)
        rows = np.arange(s)
        for i in range(t - 1, -1, -1):
            out[:, i] = at
            if i:
                at = np.where(live[:, i], back[rows, i, at], at)
        return out


def padded(sequences: list[list[int]]) -> np.ndarray:
    """Rows of unit ids, 0 behind the end."""
    out = np.zeros((len(sequences), max((len(x) for x in sequences), default=1) or 1), np.int32)
    for k, x in enumerate(sequences):
        out[k, : len(x)] = x
    return out


def batches(sequences: list[list[int]], cells: int = 200_000):
    """Indexes of sequences of like length, so that padding stays small; together at most ``cells`` positions or one sequence."""
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(sequences[order[end]]) <= cells:
            end += 1
        yield order[at:end]
        at = end
