"""A small random forest in numpy: Gini splits at feature quantiles, flat arrays for prediction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # share of positives at the node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees, for each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, a, b, v in zip(self.feature, self.cut, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f[at], 0)] <= c[at]
                at = np.where(inner, np.where(go, a[at], b[at]), at)
            total += v[at]
        return total / max(1, len(self.feature))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 11) -> Forest:
    """Each tree sees a bootstrap sample, each split a random third of the features (three at least)."""
    rng = np.random.default_rng(seed)
    n, k = x.shape
    some = max(3, k // 3)
    nodes = 2 ** (depth + 1)
    shape = (trees, nodes)
    feature, cut, left, right, value = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape)
    for t in range(trees):
        used = 1
        todo = [(0, rng.integers(0, n, n), 0)]
        while todo:
            node, rows, level = todo.pop()
            labels = y[rows]
            value[t, node] = labels.mean()
            if level == depth or len(rows) < 2 * least or value[t, node] in (0.0, 1.0):
                continue
            best = (1e-12, -1, 0.0)
            base = value[t, node] * (1 - value[t, node])
            for f in rng.permutation(k)[:some]:
                column = x[rows, f]
                cuts = np.unique(np.quantile(column, np.linspace(0, 1, 18)[1:-1]))
                low = column[:, None] <= cuts[None, :]
                n_low = low.sum(axis=0)
                p_low = (low * labels[:, None]).sum(axis=0)
                n_high, p_high = len(rows) - n_low, labels.sum() - p_low
                ok = (n_low >= least) & (n_high >= least)
                a, b = p_low / np.maximum(n_low, 1), p_high / np.maximum(n_high, 1)
                gain = np.where(ok, base - (n_low * a * (1 - a) + n_high * b * (1 - b)) / len(rows), -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(f), float(cuts[i]))
            if best[1] < 0:
                continue
            low = x[rows, best[1]] <= best[2]
            feature[t, node], cut[t, node] = best[1], best[2]
            left[t, node], right[t, node] = used, used + 1
            todo += [(used, rows[low], level + 1), (used + 1, rows[~low], level + 1)]
            used += 2
    return Forest(feature, cut, left, right, value)
