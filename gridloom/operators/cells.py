"""Fits of many cells at once: cells that have the same design share its Gram matrix, and their series are the columns of one right-hand side.

A cell is one row with its series (a few hundred steps), made by one shuffle with partial lists; rows go to Python in Arrow batches, so a
task solves a batch of cells as matrices, and there is no Python group or data frame for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.distributions import t_two_sided


class Fit(NamedTuple):
    """Of c cells on k predictors: coefficients (k, c), p-values (k, c), R squared (c) and penalties (c); NaN where a method gives none."""

    coef: np.ndarray
    p: np.ndarray
    r2: np.ndarray
    alpha: np.ndarray


def nothing(k: int, c: int) -> Fit:
    return Fit(np.full((k, c), np.nan), np.full((k, c), np.nan), np.full(c, np.nan), np.full(c, np.nan))


def r_squared(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    centred = y - y.mean(axis=0)
    rest = centred - (x - x.mean(axis=0)) @ w
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - (rest**2).sum(axis=0) / (centred**2).sum(axis=0)


def ols(y: np.ndarray, x: np.ndarray) -> Fit:
    """Least squares with a constant. y: steps x cells; x: steps x predictors; all known. NaN below k + 2 steps."""
    (n, k), c = x.shape, y.shape[1]
    if n < k + 2:
        return nothing(k, c)
    a = np.column_stack([np.ones(n), x])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    rest = ((y - a @ beta) ** 2).sum(axis=0)
    df = n - np.linalg.matrix_rank(a)
    spread = np.diag(np.linalg.pinv(a.T @ a))[:, None] * rest / max(df, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / np.sqrt(spread)
        r2 = 1 - rest / ((y - y.mean(axis=0)) ** 2).sum(axis=0)
    return Fit(beta[1:], t_two_sided(t, df)[1:], r2, np.full(c, np.nan))


def descend(gram: np.ndarray, goal: np.ndarray, alpha: np.ndarray, start: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Cyclic coordinate descent of all columns on one Gram matrix. A column rests once a whole cycle moves none of its coefficients by ``tol``.
    gram: (k, k) and goal: (k, c), both over the number of steps; alpha: (c)."""
    w, active = start.copy(), np.arange(goal.shape[1])
    for _ in range(steps):
        own, most = w[:, active], np.zeros(len(active))
        for j in np.flatnonzero(np.diag(gram) >= 1e-20):
            rho = goal[j, active] - gram[j] @ own + gram[j, j] * own[j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - alpha[active], 0) / gram[j, j]
            most = np.maximum(most, np.abs(new - own[j]))
            own[j] = new
        w[:, active] = own
        active = active[most >= tol]
        if not len(active):
            break
    return w


def _normal(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    return x.T @ x / len(x), x.T @ y / len(x)


def lasso(y: np.ndarray, x: np.ndarray, alpha: float | np.ndarray) -> Fit:
    """Minimises |y - xw|^2 / 2n + alpha |w|_1 after centring, for each cell with its own or with one alpha. Zeros for constant series."""
    k, c = x.shape[1], y.shape[1]
    alpha = np.broadcast_to(np.asarray(alpha, float), c)
    w = descend(*_normal(y, x), alpha, np.zeros((k, c)), 2000, 1e-8)
    flat = y.std(axis=0) < 1e-10
    w[:, flat] = 0
    return Fit(w, np.full((k, c), np.nan), np.where(flat, 0, r_squared(y, x, w)), np.where(flat, np.nan, alpha))


def penalties(y: np.ndarray, x: np.ndarray, n: int = 100, ratio: float = 1e-3) -> np.ndarray:
    """``n`` penalties a cell (n, c), from the least that leaves no coefficient down to ``ratio`` of it."""
    top = np.maximum(np.abs(_normal(y, x)[1]).max(axis=0), 1e-12)
    return top * np.geomspace(1, ratio, n)[:, None]


def lasso_cv(y: np.ndarray, x: np.ndarray, folds: int = 5, n_alphas: int = 100) -> Fit:
    """The fit with the penalty of least mean error over consecutive folds, for each cell. The path of a fold goes down, and each penalty
    starts where the one before ended; a fold has one Gram matrix for all cells."""
    alphas = penalties(y, x, n_alphas)
    errors = np.zeros(alphas.shape)
    for part in np.array_split(np.arange(len(y)), folds):
        train = np.setdiff1d(np.arange(len(y)), part)
        my, mx = y[train].mean(axis=0), x[train].mean(axis=0)
        gram, goal = _normal(y[train], x[train])
        w = np.zeros(goal.shape)
        for i, a in enumerate(alphas):
            w = descend(gram, goal, a, w, 300, 1e-5)
            errors[i] += ((y[part] - my - (x[part] - mx) @ w) ** 2).mean(axis=0) / folds
    return lasso(y, x, alphas[errors.argmin(axis=0), np.arange(y.shape[1])])


def enough(n: int, k: int, folds: int) -> bool:
    return n >= max(folds + 2, k + 1, 10)


def rows_of(cells: pa.RecordBatch, keys: list[str], predictors: list[str], fit: Fit) -> pa.RecordBatch:
    """A row for each cell and predictor."""
    k = len(predictors)
    rows = cells.select(keys).take(pa.array(np.repeat(np.arange(cells.num_rows), k)))
    values = {"coef": fit.coef.T.ravel(), "p_value": fit.p.T.ravel(), "r2": np.repeat(fit.r2, k), "alpha": np.repeat(fit.alpha, k)}
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(predictors * cells.num_rows), *(pa.array(v, from_pandas=True) for v in values.values())], names=[*keys, "predictor", *values])


def _designs(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``cells, y (steps x cells), x (steps x predictors)`` for each design of the batch: cells whose complete steps have equal predictors."""
    edges = [batch.column(c).offsets.to_numpy() for c in ("_y", "_x")]
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("_y", "_x")]
    edges = [e - e[0] for e in edges]
    groups: dict[tuple[int, bytes], tuple[list[int], list[np.ndarray], np.ndarray]] = {}
    for i in range(batch.num_rows):
        y, x = flat[0][edges[0][i] : edges[0][i + 1]], flat[1][edges[1][i] : edges[1][i + 1]].reshape(-1, k)
        ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
        y, x = y[ok], x[ok]
        own = groups.setdefault((len(y), x.tobytes()), ([], [], x))
        own[0].append(i)
        own[1].append(y)
    for cells, ys, x in groups.values():
        yield np.array(cells), np.column_stack(ys), x


def fits(df: DataFrame, cell: list[str], y: str, predictors: list[str], fit: Callable[[np.ndarray, np.ndarray], Fit], order: str | None = None) -> DataFrame:
    """``cell, predictor, coef, p_value, r2, alpha`` of every cell, NULL where there is none. Steps with a missing value do not count. Steps are
    taken by ``order``; without one as they come, which is enough for methods that do not depend on it."""
    k, names = len(predictors), [f"_{i}" for i in range(len(predictors))]
    step = F.struct(*([F.col(order).alias("_at")] if order else []), F.col(y).cast("double").alias("_y"), *(F.col(p).cast("double").alias(n) for p, n in zip(predictors, names, strict=True)))
    steps = F.sort_array(F.collect_list(step)) if order else F.collect_list(step)
    rows = df.groupBy(*cell).agg(steps.alias("_s")).select(*cell, F.transform("_s", lambda s: s["_y"]).alias("_y"), F.flatten(F.transform("_s", lambda s: F.array(*(s[n] for n in names)))).alias("_x"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cell)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = nothing(k, batch.num_rows)
            for at, ys, x in _designs(batch, k):
                for every, own in zip(whole, fit(ys, x), strict=True):
                    every[..., at] = own
            yield rows_of(batch, cell, predictors, whole)

    return rows.mapInArrow(run, f"{kinds}, predictor string, coef double, p_value double, r2 double, alpha double")
