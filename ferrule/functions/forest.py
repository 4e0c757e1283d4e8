"""A small calibrated ensemble of decision trees in NumPy, fitted on a bounded sample and applied in Arrow batches."""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, y: np.ndarray, k: int, rng: np.random.Generator, depth: int, leaf: int, bins: int) -> list[list]:
    """One tree as rows (feature or -1, threshold, left, right, class shares)."""
    tree: list[list] = []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(tree)
        counts = np.bincount(y[rows], minlength=k)
        tree.append([-1, 0.0, 0, 0, counts / max(1, counts.sum())])
        if level >= depth or len(rows) < 2 * leaf or counts.max() == len(rows):
            return me
        best = (1e-12, -1, 0.0)
        gini = 1 - ((counts / len(rows)) ** 2).sum()
        for f in rng.permutation(x.shape[1])[: max(2, int(np.ceil(np.sqrt(x.shape[1]))) + 1)]:
            v = x[rows, f]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 2)[1:-1], method="lower"))
            cuts = cuts[cuts < v.max()]
            if not len(cuts):
                continue
            side = np.searchsorted(cuts, v, side="left")
            table = np.zeros((len(cuts) + 1, k))
            np.add.at(table, (side, y[rows]), 1)
            left = table.cumsum(0)[:-1]
            right = counts - left
            nl, nr = left.sum(1), right.sum(1)
            score = (nl * (1 - ((left / np.maximum(nl, 1)[:, None]) ** 2).sum(1)) + nr * (1 - ((right / np.maximum(nr, 1)[:, None]) ** 2).sum(1))) / len(rows)
            score[(nl < leaf) | (nr < leaf)] = np.inf
            i = int(score.argmin())
            if gini - score[i] > best[0]:
                best = (gini - score[i], int(f), float(cuts[i]))
        if best[1] < 0:
            return me
        go = x[rows, best[1]] <= best[2]
        tree[me][:2] = best[1:]
        tree[me][2] = node(rows[go], level + 1)
        tree[me][3] = node(rows[~go], level + 1)
        return me

    node(np.arange(len(y)), 0)
    return tree


class Forest:
    """Class shares averaged over trees; ``sure`` maps the top share to how often it was right on rows out of bag (isotonic)."""

    def __init__(self, trees: int = 12, depth: int = 9, leaf: int = 2, bins: int = 24, seed: int = 7):
        self.size, self.depth, self.leaf, self.bins, self.seed = trees, depth, leaf, bins, seed

    def fit(self, x: np.ndarray, y: np.ndarray, k: int) -> Forest:
        rng = np.random.default_rng(self.seed)
        votes, self.trees = np.zeros((len(y), k)), []
        for _ in range(self.size):
            bag = rng.integers(0, len(y), len(y))
            t = _grow(x[bag], y[bag], k, rng, self.depth, self.leaf, self.bins)
            tree = (np.array([r[0] for r in t]), np.array([r[1] for r in t]), np.array([r[2] for r in t]), np.array([r[3] for r in t]), np.array([r[4] for r in t]))
            out = np.setdiff1d(np.arange(len(y)), bag)
            if len(out):
                votes[out] += self._leaf(tree, x[out])
            self.trees.append(tree)
        total = votes.sum(1)
        seen = total > 0
        top, right = votes[seen].max(1) / total[seen], votes[seen].argmax(1) == y[seen]
        order = np.argsort(top, kind="stable")
        blocks: list[list[float]] = []  # pool adjacent violators: [mean, weight, upper edge]
        for s, r in zip(top[order], right[order].astype(float)):
            blocks.append([r, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b = blocks.pop()
                a = blocks[-1]
                blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[2]]
        self.edges, self.means = np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])
        return self

    @staticmethod
    def _leaf(tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, share = tree
        at = np.zeros(len(x), dtype=int)
        while (open_ := feature[at] >= 0).any():
            i = np.nonzero(open_)[0]
            n = at[i]
            at[i] = np.where(x[i, feature[n]] <= cut[n], left[n], right[n])
        return share[at]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, calibrated confidence) of each row."""
        votes = sum(self._leaf(t, x) for t in self.trees) / len(self.trees)
        top = votes.max(1)
        sure = self.means[np.minimum(np.searchsorted(self.edges, top, side="left"), len(self.means) - 1)] if len(self.means) else np.zeros(len(x))
        return votes.argmax(1), sure
