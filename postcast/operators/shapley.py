"""Path-dependent Shapley values of tree ensembles (M6), for batches of rows.

A feature that is not known is averaged out by walking both ways of its splits, each
weighted by the share of training rows (cover) that went there.  On the way to one
leaf, a distinct feature i either fits the row (o_i = 1) or not (0) and has the
product z_i of its cover shares.  The leaf adds to feature i

    value * (o_i - z_i) * sum over subsets S of the other m - 1 features of
        |S|! (m - 1 - |S|)! / m! * prod_{j in S} o_j * prod_{j not in S} z_j

so a row's part depends on the o's alone: with m features on a path there are 2**m
cases.  Their sums are the coefficients of prod_j (o_j t + z_j), made for all leaves
of a tree with as many features at once, and rows only look up their case.  Values
and the base (the average over the training rows) sum to the prediction."""
from __future__ import annotations

from math import factorial

import numpy as np

WIDEST = 10  # features on a path whose cases are tabulated; beyond, cases are those of the rows
KEPT = 1 << 18  # numbers of a tree's tables that are kept for the next rows; larger ones are made anew
ROWS = 2048  # rows at once, for which (feature, class, row) is held


class Tree:
    """Nodes as arrays (children -1 at leaves; values (node,) or (node, class)) and the
    paths to the leaves."""

    def __init__(self, weight: float, left, right, feature, threshold, cover, value):
        self.weight, self.left, self.right = weight, np.asarray(left), np.asarray(right)
        self.feature, self.threshold = np.asarray(feature), np.asarray(threshold, float)
        self.cover, self.value = np.asarray(cover, float), np.asarray(value, float)
        self.splits = np.flatnonzero(self.left >= 0)
        self.groups = self._base = None
        column = {int(n): c for c, n in enumerate(self.splits)}
        self.paths = []  # (leaf, features, shares, per feature its splits and sides)
        stack = [(0, {})]
        while stack:
            node, on = stack.pop()
            if self.left[node] < 0:
                self.paths.append((node, list(on), [s for s, _ in on.values()], [w for _, w in on.values()]))
                continue
            f = int(self.feature[node])
            share, ways = on.get(f, (1.0, ()))
            for child, side in ((self.left[node], True), (self.right[node], False)):
                part = self.cover[child] / self.cover[node] if self.cover[node] else 0.5
                stack.append((int(child), on | {f: (share * part, (*ways, (column[node], side)))}))

    def base(self) -> np.ndarray:
        """The ensemble member's average over the training rows."""
        if self._base is None:
            self._base = self.weight * sum(self.value[leaf] * np.prod(shares) for leaf, _, shares, _ in self.paths)
        return self._base


def cases(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """(leaf, case, feature): the factor of a leaf's value for features with shares
    ``z`` (leaf, m) in the cases ``o`` (case, m)."""
    leaves, m = z.shape
    out = np.empty((leaves, len(o), m))
    weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    for i in range(m):
        poly = np.zeros((leaves, len(o), m))
        poly[:, :, 0] = 1
        for j in range(m):
            if j != i:
                more = np.zeros_like(poly)
                more[:, :, 1:] = poly[:, :, :-1] * o[None, :, j, None]
                poly = poly * z[:, None, j, None] + more
        out[:, :, i] = (poly @ weights) * (o[None, :, i] - z[:, None, i])
    return out


def leaf_cases(tree: Tree, goes_left: np.ndarray) -> dict[int, np.ndarray]:
    """Leaf -> the case of each row: bit j is set where the row fits the j-th feature of
    the leaf's path.  ``goes_left`` is (split, row)."""
    column = {int(n): c for c, n in enumerate(tree.splits)}
    out = {}
    stack = [(0, {}, np.zeros(goes_left.shape[1], np.int64))]
    while stack:
        node, on, case = stack.pop()
        if tree.left[node] < 0:
            out[node] = case
            continue
        f, left = int(tree.feature[node]), goes_left[column[node]]
        bit = np.int64(1 << on.get(f, len(on)))
        for child, fits in ((tree.left[node], left), (tree.right[node], ~left)):
            stack.append((int(child), on | {f: on.get(f, len(on))},
                          np.where(fits, case, case & ~bit) if f in on else case + fits * bit))
    return out


def _groups(tree: Tree) -> list:
    """Per number of features on a path: its leaves, their shares, table of cases, values
    and features.  Kept with the tree while its tables are small."""
    if tree.groups is not None:
        return tree.groups
    by_size: dict[int, list] = {}
    for path in tree.paths:
        by_size.setdefault(len(path[1]), []).append(path)
    out, size = [], 0
    for m, paths in by_size.items():
        if not m:
            continue
        leaves = [leaf for leaf, _, _, _ in paths]
        shares = np.array([shares for _, _, shares, _ in paths])
        table = None
        if m <= WIDEST:
            table = cases(shares, (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float))
            table = np.ascontiguousarray(table.transpose(0, 2, 1))
            size += table.size
        value = tree.weight * tree.value[leaves].reshape(len(leaves), -1, 1)
        out.append((m, leaves, shares, table, value, [features for _, features, _, _ in paths]))
    if size <= KEPT:
        tree.groups = out
    return out


def shapley_values(trees: list[Tree], x: np.ndarray, classes: int | None = None):
    """(rows, features) or (rows, classes, features), and the base."""
    n, d = x.shape
    out = np.zeros((d, classes or 1, n))
    base = np.zeros(() if classes is None else (classes,))
    for tree in trees:
        base = base + tree.base()
        if not len(tree.splits):
            continue
        case = leaf_cases(tree, x.T[tree.feature[tree.splits]] <= tree.threshold[tree.splits][:, None])
        for m, leaves, shares, table, value, features in _groups(tree):
            for p, leaf in enumerate(leaves):
                if table is not None:
                    part = table[p][:, case[leaf]]
                else:
                    part = cases(shares[p:p + 1], (case[leaf][:, None] >> np.arange(m) & 1).astype(float))[0].T
                for j, f in enumerate(features[p]):
                    out[f] += part[j] * value[p]
    return np.ascontiguousarray(out[:, 0].T if classes is None else out.transpose(2, 1, 0)), base
