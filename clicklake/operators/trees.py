"""Boosted regression trees over binned columns, for any loss that gives gradients; pointwise and listwise losses for rankings.

Fitting runs in NumPy over a bounded sample of impressions; scoring is a product of Arrow batches and the model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Gradient = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def logistic(y: np.ndarray) -> Gradient:
    """Pointwise: gradient and curvature of the log-loss of each row on its own."""

    def at(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    return at


def _padded(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by group, and the place of each in a table of (groups, longest group)."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(group) else np.zeros(0, int)
    no = np.cumsum(np.isin(np.arange(len(group)), first)) - 1
    return order, no, np.arange(len(group)) - first[no] if len(group) else no


def listwise(y: np.ndarray, group: np.ndarray, depth: int = 30, block: int = 1 << 22) -> Gradient:
    """Each pair of a clicked and an unclicked row of a group pulls with the change of nDCG that swapping them would bring.

    Pairs wholly under `depth` places have no pull. Groups are held in tables of (groups, rows), `block` pairs at a time.
    """
    order, no, at_row = _padded(group)
    n_groups, width = (int(no[-1]) + 1, int(at_row.max()) + 1) if len(order) else (0, 0)
    sizes = np.bincount(no, minlength=n_groups)
    label = np.zeros((n_groups, width))
    label[no, at_row] = y[order]
    here = np.arange(width) < sizes[:, None]
    ideal = np.cumsum(1 / np.log2(np.arange(2, width + 3)))
    clicked = label.sum(axis=1).astype(int)
    norm = 1 / ideal[np.maximum(np.minimum(clicked, depth), 1) - 1] if width else np.zeros(0)
    useful = np.flatnonzero((clicked > 0) & (clicked < sizes))

    def at(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.full((n_groups, width), -np.inf)
        score[no, at_row] = f[order]
        g, h = np.zeros((n_groups, width)), np.zeros((n_groups, width))
        per = max(1, block // max(width * width, 1))
        for i in range(0, len(useful), per):
            of = useful[i : i + per]
            s, yy = score[of], label[of]
            rank = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1, kind="stable")
            gain = np.where(rank < depth, 1 / np.log2(rank + 2.0), 0.0)
            pair = (yy[:, :, None] > yy[:, None, :]) & here[of][:, :, None] & here[of][:, None, :]
            with np.errstate(invalid="ignore"):
                p = 1 / (1 + np.exp(np.clip(s[:, :, None] - s[:, None, :], -50, 50)))
            swap = np.abs(gain[:, :, None] - gain[:, None, :]) * norm[of][:, None, None]
            pull = np.where(pair, p * swap, 0.0)
            stiff = np.where(pair, p * (1 - p) * swap, 0.0)
            g[of] = -pull.sum(axis=2) + pull.sum(axis=1)
            h[of] = stiff.sum(axis=2) + stiff.sum(axis=1)
        gg, hh = np.zeros(len(f)), np.zeros(len(f))
        gg[order], hh[order] = g[no, at_row], h[no, at_row]
        return gg, np.maximum(hh, 1e-9)

    return at


def ndcg(score: np.ndarray, y: np.ndarray, group: np.ndarray, k: int = 10) -> float:
    """Mean nDCG@k of the groups with a click; 0 without any."""
    order = np.lexsort((-score, group))
    g, label = group[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    no = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
    place = np.arange(len(g)) - first[no] if len(g) else no
    dcg = np.bincount(no, np.where((place < k) & (label > 0), 1 / np.log2(place + 2.0), 0), len(first))
    clicks = np.bincount(no, label, len(first)).astype(int)
    ideal = np.cumsum(1 / np.log2(np.arange(2, k + 2)))
    some = clicks > 0
    return float((dcg[some] / ideal[np.minimum(clicks[some], k) - 1]).mean()) if some.any() else 0.0


@dataclass
class Trees:
    """Full binary trees of one depth: column and bin of each inner node, a value of each leaf; nulls have a bin of their own."""

    edges: list[np.ndarray]
    columns: list[np.ndarray] = field(default_factory=list)
    bins: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers of rows (a row, a column); NaN, which sorts last, is in the bin behind all others."""
        out = [np.where(np.isnan(c), len(e) + 1, np.searchsorted(e, c, side="left")) for e, c in zip(self.edges, x.T)]
        return np.column_stack(out).astype(np.int64) if len(out) else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        """The trees' sum for each row."""
        cells = self.binned(x)
        return sum((self._one(t, cells) for t in range(len(self.leaves) if upto is None else upto)), np.zeros(len(x)))

    def _one(self, t: int, cells: np.ndarray) -> np.ndarray:
        inner, rows = len(self.columns[t]), np.arange(len(cells))
        node = np.zeros(len(cells), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (cells[rows, self.columns[t][node]] > self.bins[t][node])
        return self.leaves[t][node - inner]


def fit(x: np.ndarray, gradient: Gradient, rounds: int = 80, depth: int = 4, rate: float = 0.1, leaf: float = 1e-2, ridge: float = 1.0, n_bins: int = 32, watch: tuple[np.ndarray, Callable[[np.ndarray], float]] | None = None, patience: int = 15) -> Trees:
    """Newton boosting. `watch` is (rows, quality of their scores): fitting ends `patience` rounds after the best one, and keeps the trees up to it."""
    k = x.shape[1]
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, n_bins + 1)[1:-1])) if len(v := c[~np.isnan(c)]) else np.zeros(0) for c in x.T]
    m = Trees(edges, gains=np.zeros(k))
    cells, wide = m.binned(x), n_bins + 2
    inner, f = 2**depth - 1, np.zeros(len(x))
    seen = None if watch is None else (m.binned(watch[0]), np.zeros(len(watch[0])))
    best, kept = -np.inf, 0
    for r in range(rounds if len(x) and k else 0):
        g, h = gradient(f)
        node, cc, bb = np.zeros(len(x), np.int64), np.zeros(inner, np.int64), np.full(inner, wide, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            top = np.full(n, 1e-9)
            for j in range(k):
                cell = (node - first) * wide + cells[:, j]
                gl = np.bincount(cell, g, n * wide).reshape(n, wide).cumsum(axis=1)
                hl = np.bincount(cell, h, n * wide).reshape(n, wide).cumsum(axis=1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[:, -1:] ** 2 / (hl[:, -1:] + ridge)
                gain[(hl < leaf) | (hr < leaf)] = 0
                at = gain.argmax(axis=1)
                got = gain[np.arange(n), at]
                better = np.flatnonzero(got > top)
                top[better], cc[first + better], bb[first + better] = got[better], j, at[better]
            split = bb[first : first + n] < wide
            np.add.at(m.gains, cc[first : first + n][split], top[split])
            node = 2 * node + 1 + (cells[np.arange(len(x)), cc[node]] > bb[node])
        value = -rate * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + ridge)
        f += value[node - inner]
        m.columns.append(cc)
        m.bins.append(bb)
        m.leaves.append(value)
        if seen is not None:
            seen[1][:] += m._one(r, seen[0])
            if (now := watch[1](seen[1])) > best:
                best, kept = now, r + 1
            elif r + 1 >= kept + patience:
                break
    if seen is not None:
        m.columns, m.bins, m.leaves = m.columns[:kept], m.bins[:kept], m.leaves[:kept]
    return m
