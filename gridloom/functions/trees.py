"""Regression trees, forests and boosting for designs of a few hundred rows. Fits are deterministic for a seed."""

from __future__ import annotations

import numpy as np

SEED = 42


class Tree:
    """Binary tree by least squares: parallel arrays of feature, threshold, children and value."""

    def __init__(self) -> None:
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.value: list[float] = []

    def node(self, value: float) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.child.append((-1, -1))
        self.value.append(value)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f = self.feature[at]
            if f < 0:
                out[rows] = self.value[at]
            else:
                low = x[rows, f] <= self.cut[at]
                todo += [(self.child[at][0], rows[low]), (self.child[at][1], rows[~low])]
        return out


def best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, float, float]:
    """``feature, threshold, gain`` of the split that lowers the squared error most; feature -1 if there is none. All columns at once."""
    n = len(y)
    order = np.argsort(x, axis=0, kind="stable")
    xs, ys = np.take_along_axis(x, order, 0), y[order]
    left = np.cumsum(ys, axis=0)[:-1]
    sizes = np.arange(1, n)[:, None]
    gain = left**2 / sizes + (ys.sum(axis=0) - left) ** 2 / (n - sizes) - y.sum() ** 2 / n
    gain[(xs[1:] <= xs[:-1]) | (sizes < least) | (n - sizes < least)] = -np.inf
    at = int(gain.argmax())
    i, f = divmod(at, x.shape[1])
    top = float(gain[i, f])
    return (int(f), float((xs[i, f] + xs[i + 1, f]) / 2), top) if top > 1e-12 else (-1, 0.0, 0.0)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int | None = None, least: int = 1, features: int | None = None) -> Tree:
    tree = Tree()
    todo = [(tree.node(float(y.mean())), np.arange(len(y)), 0)]
    while todo:
        at, rows, level = todo.pop()
        if len(rows) < 2 * least or depth is not None and level >= depth:
            continue
        some = np.arange(x.shape[1]) if features is None or features >= x.shape[1] else np.sort(rng.permutation(x.shape[1])[:features])
        f, cut, _ = best_split(x[np.ix_(rows, some)], y[rows], least)
        if f < 0:
            continue
        low = x[rows, some[f]] <= cut
        sides = rows[low], rows[~low]
        tree.feature[at], tree.cut[at] = int(some[f]), cut
        tree.child[at] = tuple(tree.node(float(y[s].mean())) for s in sides)
        todo += [(c, s, level + 1) for c, s in zip(tree.child[at], sides, strict=True)]
    return tree


def share(kind: str | float | None, k: int) -> int | None:
    """So many of ``k`` features are tried at a split."""
    if kind is None:
        return None
    return max(1, int(k**0.5) if kind == "sqrt" else int(kind * k))


def forest(x: np.ndarray, y: np.ndarray, n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1, max_features: str | float | None = None, seed: int = SEED):
    """The mean of trees grown on bootstrap samples."""
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(n_estimators):
        rows = rng.integers(0, len(y), len(y))
        trees.append(grow(x[rows], y[rows], rng, max_depth, min_samples_leaf, share(max_features, x.shape[1])))
    return lambda z: np.mean([t.predict(z) for t in trees], axis=0)


def boosting(x: np.ndarray, y: np.ndarray, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, subsample: float = 1.0, seed: int = SEED):
    """Trees one after another, each on what is left of the target, on a share of the rows drawn without replacement."""
    rng = np.random.default_rng(seed)
    first = float(y.mean())
    left, trees = y - first, []
    for _ in range(n_estimators):
        rows = np.sort(rng.permutation(len(y))[: max(1, int(subsample * len(y)))]) if subsample < 1 else np.arange(len(y))
        t = grow(x[rows], left[rows], rng, max_depth)
        left = left - learning_rate * t.predict(x)
        trees.append(t)
    return lambda z: first + learning_rate * np.sum([t.predict(z) for t in trees], axis=0)
