"""Forecasts with expanding folds: models, their search, designs from graph parents, and skill."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import trees
from gridloom.functions.named import named
from gridloom.operators import nested
from gridloom.operators.stats import lasso, lasso_cv, t_p_value
from gridloom.sources.results import stored


def skill(df: DataFrame, keys: list[str], y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """``rmse, r, t, n`` over the pairs where both are known; NULL below two pairs, r also for a constant side. t is r's statistic with
    n - 2 degrees of freedom, for ``stats.t_p_value``; NULL where r is 1 or there are none."""
    ok = F.col(y).isNotNull() & F.col(yhat).isNotNull() & ~F.isnan(y) & ~F.isnan(yhat)
    a, b = F.when(ok, F.col(y)), F.when(ok, F.col(yhat))
    s = df.groupBy(*keys).agg(F.sqrt(F.avg((a - b) * (a - b))).alias("e"), F.corr(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.count(a).alias("n"))
    enough = F.col("n") >= 2
    out = s.select(*keys, F.when(enough, F.col("e")).alias("rmse"), F.when(enough & (F.col("sa") >= 1e-9) & (F.col("sb") >= 1e-9), F.col("c")).alias("r"), "n")
    t = F.col("r") * F.sqrt(F.col("n") - 2) / F.nullif(F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))), F.lit(0.0))
    return out.withColumn("t", F.when(F.col("n") > 2, t))


def contingency(df: DataFrame, keys: list[str], threshold: Column, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """Counts of events, whose size exceeds the threshold whatever their sign, over the pairs where both are known. Rates are of the events
    observed, NULL without any. Below two pairs all counts are 0 and the rates NULL."""
    known = F.col(y).isNotNull() & F.col(yhat).isNotNull() & ~F.isnan(y) & ~F.isnan(yhat)
    seen, said = F.abs(y) > threshold, F.abs(yhat) > threshold
    cases = {"hits": seen & said, "misses": seen & ~said, "false_alarms": ~seen & said, "correct_negatives": ~seen & ~said}
    s = df.groupBy(*keys).agg(F.count_if(known).alias("pairs"), *(F.count_if(known & c).alias(n) for n, c in cases.items()))
    counts = s.select(*keys, *(F.when(F.col("pairs") >= 2, F.col(n)).otherwise(0).alias(n) for n in cases))
    events = F.col("hits") + F.col("misses")
    rate = F.col("hits") / F.nullif(events, F.lit(0))
    return counts.withColumns({"n_events_observed": events, "hit_rate": rate, "miss_rate": 1 - rate})


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def _linear(solve: Callable[..., np.ndarray], scaled: bool = True) -> Callable:
    """A model whose prediction is linear: ``solve`` gives the coefficients on (standardised) predictors and a centred target."""

    def fit(x: np.ndarray, y: np.ndarray, **options: float) -> Callable[[np.ndarray], np.ndarray]:
        mean, my = x.mean(axis=0), y.mean()
        std = x.std(axis=0) if scaled else np.ones(x.shape[1])
        std = np.where(std < 1e-12, 1, std)
        w = solve((x - mean) / std, y - my, **options)
        return lambda z: my + (z - mean) / std @ w

    return fit


_least_squares = _linear(lambda x, y: np.linalg.lstsq(x, y, rcond=None)[0], scaled=False)
#: Models by name: each takes predictors and a target, and gives a function that predicts; others are named ``module:attribute``. A linear model on graph parents is
#: the same as plain least squares on their lagged design.
MODELS: dict[str, Callable] = {
    "linear": _least_squares,
    "ridge": _linear(lambda x, y, alpha=1.0: ridge(x, y, alpha)),
    "lasso": _linear(lambda x, y: lasso(y, x, 0.01)),
    "lassocv": _linear(lambda x, y: lasso_cv(y, x, min(5, len(y)), 100)[1]),
    "random_forest": trees.forest,
    "gradient_boosting": trees.boosting,
    "tigramite_linear": _least_squares,
}
#: The grids of parameters that are searched.
GRIDS = {
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "random_forest": {"n_estimators": [100, 200], "max_depth": [5, 10, None], "min_samples_leaf": [1, 3, 5], "max_features": ["sqrt", 0.5]},
    "gradient_boosting": {"learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5, 7], "subsample": [0.8, 1.0]},
}
#: Models that moments decide: their penalties, and whether predictors are scaled.
SUMS = {"linear": ([0.0], False), "tigramite_linear": ([0.0], False), "ridge": (GRIDS["ridge"]["alpha"], True)}
#: Outer and inner folds by preset.
FOLDS = {"quick": (3, 2), "standard": (5, 3), "thorough": (10, 5)}


def expanding(n: int, k: int) -> list[tuple[int, int]]:
    """``start, end`` of each test block; all before it trains. None where there are fewer rows than blocks."""
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k if size else 0)]


def tuned(x: np.ndarray, y: np.ndarray, model: str, inner: int, grid: dict[str, list] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The model fitted with those parameters of its grid that have the least mean error over the inner expanding folds."""
    grid, fit = GRIDS.get(model, {}) if grid is None else grid, named(model, MODELS)
    options = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    folds = expanding(len(y), inner)
    if len(options) > 1 and folds:
        error = lambda o: np.mean([math.sqrt(((y[a:b] - fit(x[:a], y[:a], **o)(x[a:b])) ** 2).mean()) for a, b in folds])
        options = [options[int(np.argmin([error(o) for o in options]))]]
    return fit(x, y, **(options[0] if options else {}))


def predict_folds(design: DataFrame, keys: list[str], predictors: list[str], k: int, model: str = "linear", inner: int | None = None) -> DataFrame:
    """``keys, fold, t, y_true, y_pred``: each test block predicted from all rows before it. A key is one design matrix (a few hundred rows);
    rows with a missing predictor neither train nor are predicted. With ``inner`` folds the model's grid is searched. Models that moments decide
    are one plan of sums (``nested``)."""
    if model in SUMS:
        alphas, scaled = SUMS[model]
        rows = design.select(*keys, "t", "y", F.map_from_arrays(F.array(*map(F.lit, predictors)), F.array(*(F.col(p).cast("double") for p in predictors))).alias("x"))
        return nested.forecasts(rows, keys, k, inner or 0, alphas if inner or not any(alphas) else [1.0], scaled)
    fields = ", ".join(f"{c} {design.schema[c].dataType.simpleString()}" for c in keys)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        rows = _folds(pdf["t"].to_numpy(), pdf["y"].to_numpy(float), pdf[predictors].to_numpy(float), k, model, inner)
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, "fold", "t", "y_true", "y_pred"])

    return design.groupBy(*keys).applyInPandas(one, f"{fields}, fold int, t int, y_true double, y_pred double")


def _folds(t: np.ndarray, y: np.ndarray, x: np.ndarray, k: int, model: str, inner: int | None) -> list[tuple[int, int, float, float]]:
    ok = np.isfinite(x).all(axis=1) & np.isfinite(y)
    rows = []
    for fold, (start, end) in enumerate(expanding(len(t), k)):
        train, test = np.flatnonzero(ok[:start]), start + np.flatnonzero(ok[start:end])
        if len(train) < 2 or not len(test):
            continue
        predict = tuned(x[train], y[train], model, inner) if inner else named(model, MODELS)(x[train], y[train])
        rows += [(fold, int(t[i]), float(y[i]), float(p)) for i, p in zip(test, predict(x[test]), strict=True)]
    return rows


#: The season of a parent by its lag, and the order in which seasons are added.
LAG_SEASONS = {-6: "JJA(-1)", -5: "SON(-1)", -4: "DJF(0)", -3: "MAM(0)", -2: "JJA(0)", -1: "SON(0)"}
CUMULATIVE = ["JJA(-1)", "SON(-1)", "DJF(0)", "MAM(0)"]


def cumulative_parents(parents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, max_season, parent, lag``: for each season in turn the parents of it and of the seasons before. Parents whose lag has no
    season, or one that is not added, never occur. parents: ``keys, parent, lag`` (negative)."""
    name = F.create_map(*(F.lit(x) for pair in LAG_SEASONS.items() for x in pair))[F.col("lag")]
    place = F.array_position(F.array(*map(F.lit, CUMULATIVE)), name)
    later = F.slice(F.array(*map(F.lit, CUMULATIVE)), place.cast("int"), len(CUMULATIVE))
    return parents.filter(place > 0).select(*keys, F.explode(later).alias("max_season"), "parent", "lag")


def cumulative_designs(panel: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, max_season, target, t, y, masked, x`` with a map of ``parent@lag`` to value. panel: ``t, var, value, masked``; parents:
    ``keys, target, parent, lag``. Both joins are by variable and step; the parents are a dimension table."""
    chosen = cumulative_parents(parents, [*keys, "target"])
    own = [*keys, "target", "max_season"]
    groups = chosen.select(*own).distinct()
    goal = panel.select(F.col("var").alias("target"), "t", F.col("value").alias("y"), "masked").join(F.broadcast(groups), "target")
    used = panel.select(F.col("var").alias("parent"), F.col("t").alias("at"), "value").join(F.broadcast(chosen), "parent").select(*own, (F.col("at") - F.col("lag")).alias("t"), F.concat("parent", F.lit("@"), F.col("lag").cast("string")).alias("name"), "value")
    maps = used.groupBy(*own, "t").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("x"))
    return goal.join(maps, [*own, "t"], "left")


def forecasts(panel: DataFrame, parents: DataFrame, keys: list[str], model: str = "linear", preset: str = "standard") -> DataFrame:
    """``keys, target, max_season, fold, t, y_true, y_pred`` for each target, set and cumulative season, with the preset's folds and, where the
    model has a grid, its inner folds. Hidden steps of the target neither train nor are predicted; folds are cut from all steps. Linear models
    and ridge, which moments decide, are one plan of sums (``nested``); the others are fitted a design at a time."""
    k, inner = FOLDS[preset]
    own = [*keys, "target", "max_season"]
    design = cumulative_designs(panel, parents, keys)
    if model in SUMS:
        seen = design.withColumn("y", F.when(~F.coalesce("masked", F.lit(False)), F.col("y")))
        return nested.forecasts(seen, own, k, inner, *SUMS[model])
    fields = ", ".join(f"{c} {design.schema[c].dataType.simpleString()}" for c in own)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        maps = [dict(m) if m is not None else {} for m in pdf["x"]]
        names = sorted({n for m in maps for n in m})
        x = np.array([[m.get(n, np.nan) for n in names] for m in maps], float)
        y = np.where(pdf["masked"].to_numpy(bool), np.nan, pdf["y"].to_numpy(float))
        rows = _folds(pdf["t"].to_numpy(), y, x, k, model, inner if model in GRIDS else None)
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*own, "fold", "t", "y_true", "y_pred"])

    return design.groupBy(*own).applyInPandas(one, f"{fields}, fold int, t int, y_true double, y_pred double")


def skill_table(predicted: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Pooled metrics of all folds with the correlation's two-sided p-value, by set, target and cumulative season, in the order of the seasons."""
    own = [*keys, "target", "max_season"]
    predicted = stored(predicted, "predictions")  # a row for each step predicted, read twice
    pooled = skill(predicted, own)
    pooled = pooled.withColumn("p_value", t_p_value(F.col("t"), (F.col("n") - 2).cast("double")))
    both = pooled.join(contingency(predicted, own, F.lit(threshold)), own)
    place = F.array_position(F.array(*map(F.lit, CUMULATIVE)), F.col("max_season"))
    return both.orderBy("target", *keys, place)
