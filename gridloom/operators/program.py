"""Regression programs: which predictors a set takes, how they and the confounders are lagged for a season, and the fits of all sets and
seasons per cell. Series are a few hundred rows and travel with the plan; the field is shuffled once, by cell."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import cells

#: The season and the group of a variable by its lag in seasons; other lags count as lag 5.
LAG_GROUPS = {6: ("JJA", "JJA_PREDICTORS"), 5: ("SON", "SON_PREDICTORS"), 4: ("DJF", "DJF_CONFOUNDERS"), 3: ("MAM", "MAM_MEDIATORS")}
#: Target seasons in order, with their lag.
TARGET_LAGS = {"JJA_-1": 6, "SON_-1": 5, "DJF_0": 4, "MAM_0": 3, "JJA_0": 2, "SON_0": 1, "DJF_1": 0}
MONTHS = {"DJF": 1, "MAM": 4, "JJA": 7, "SON": 10}


def lag_group(lag: Column) -> Column:
    """``season, group`` of a lag."""
    out = None
    for k, (season, group) in LAG_GROUPS.items():
        row = F.struct(F.lit(season).alias("season"), F.lit(group).alias("group"))
        out = F.when(lag == k, row) if out is None else out.when(lag == k, row)
    return out.otherwise(F.struct(F.lit("SON").alias("season"), F.lit("SON_PREDICTORS").alias("group")))


def lag_bounds(text: Column) -> Column:
    """``high, low`` of a range of lags, ``lag6-3`` or ``lag5``, with or without ``_COMBINED``."""
    found = F.regexp_extract_all(F.replace(text, F.lit("_COMBINED"), F.lit("")), F.lit(r"(\d+)"), 1)
    numbers = F.transform(found, lambda x: x.cast("int"))
    return F.struct(F.get(numbers, F.lit(0)).alias("high"), F.element_at(numbers, -1).alias("low"))


def predictors_for(predictors: DataFrame, sets: DataFrame) -> DataFrame:
    """``set, name, lag, low`` of the predictors that each set takes, once each. predictors: ``name, pathway, lag``; sets: ``set, lags,
    pathway`` (dimension tables), where the pathway COMBINED takes all. ``low`` is the set's least lag, at which confounders are taken."""
    bounds = sets.withColumn("b", lag_bounds(F.col("lags"))).select("set", F.col("pathway").alias("wanted"), "b.high", "b.low")
    held = predictors.join(F.broadcast(bounds), F.col("lag").between(F.col("low"), F.col("high")))
    return held.filter((F.col("wanted") == "COMBINED") | (F.col("pathway") == F.col("wanted"))).select("set", "name", "lag", "low").dropDuplicates(["set", "name"])


def lowest(sets: DataFrame) -> DataFrame:
    """``set, low``: each set's least lag."""
    return sets.select("set", lag_bounds(F.col("lags")).alias("b")).select("set", "b.low")


def applicable_seasons(sets: DataFrame) -> DataFrame:
    """``set, target_season, target_lag, month``: from the season of a set's least lag on. The seasons are a table of seven rows."""
    table = F.array(*(F.struct(F.lit(s).alias("target_season"), F.lit(k).alias("target_lag"), F.lit(MONTHS[s.split("_")[0]]).alias("month")) for s, k in TARGET_LAGS.items()))
    return lowest(sets).select("set", "low", F.explode(table).alias("s")).filter(F.col("s.target_lag") <= F.col("low")).select("set", "s.*")


def lagged_series(series: DataFrame, chosen: DataFrame, seasons: DataFrame) -> DataFrame:
    """``set, target_season, season, name, value``: each chosen series moved so that its lag stands beside the target's season.
    series: ``name, season, value``; chosen: ``set, name, lag``; seasons: ``applicable_seasons``."""
    moved = series.join(F.broadcast(chosen), "name").join(F.broadcast(seasons), "set")
    at = F.expr("cast(add_months(season, 3 * (lag - target_lag)) as date)")
    return moved.select("set", "target_season", at.alias("season"), "name", "value", "month").filter(F.month("season") == F.col("month")).drop("month")


class Case(NamedTuple):
    """A set in a target season: its stamps, predictors (columns) and standardised confounders (columns)."""

    name: str
    target_season: str
    method: str
    stamps: list
    predictors: list[str]
    x: np.ndarray
    z: np.ndarray


def cases(series: DataFrame, confounders: DataFrame, predictors: DataFrame, sets: DataFrame) -> list[Case]:
    """The designs of all sets and seasons. They are index series, a few hundred rows each, and are collected. Steps without a value of
    some confounder go; a case with none left, or without predictors, is left out. sets: ``set, lags, pathway, method``."""
    chosen, seasons = predictors_for(predictors, sets), applicable_seasons(sets)
    low = lowest(sets).withColumnRenamed("low", "lag")
    held = confounders.select("name").distinct().crossJoin(F.broadcast(low)).select("set", "name", "lag")
    parts = lagged_series(series, chosen.select("set", "name", "lag"), seasons).withColumn("kind", F.lit("x")).unionByName(lagged_series(confounders, held, seasons).withColumn("kind", F.lit("z")))
    data = parts.toPandas()
    methods = {r.set: r.method for r in sets.collect()}
    out = []
    for (name, season), own in sorted(data.groupby(["set", "target_season"]), key=lambda g: g[0]):
        wide = {k: v.pivot_table(index="season", columns="name", values="value", dropna=False) for k, v in own.groupby("kind")}
        if "x" not in wide or "z" not in wide:
            continue
        z = wide["z"].astype(float)
        z = ((z - z.mean()) / z.std(ddof=0).replace(0, np.nan)).dropna()
        x = wide["x"].reindex(z.index).astype(float)
        x = x.loc[:, x.notna().any()]
        if len(z) and x.shape[1]:
            out.append(Case(name, season, methods[name], list(z.index), sorted(x.columns), x[sorted(x.columns)].to_numpy(), z.to_numpy()))
    return out


def fit(case: Case, y: np.ndarray, alpha: float | None, folds: int) -> cells.Fit:
    """One case for many cells. y: stamps x cells, NaN where a cell has no value. Cells with the same known stamps are solved together: the
    confounders' signal is taken out, and the rest is fitted by the case's method."""
    k = len(case.predictors)
    out = cells.nothing(k, y.shape[1])
    ok = np.isfinite(y)
    patterns, at = np.unique(ok, axis=1, return_inverse=True)
    for i in range(patterns.shape[1]):
        own, there = np.flatnonzero(at.ravel() == i), patterns[:, i]
        if there.sum() <= case.z.shape[1] + 1:
            continue
        base = np.column_stack([np.ones(there.sum()), case.z[there]])
        v, x = y[there][:, own], case.x[there]
        v = v - base @ np.linalg.lstsq(base, v, rcond=None)[0]
        whole = np.isfinite(x).all(axis=1)
        v, x = v[whole], x[whole]
        if case.method == "OLS":
            found = cells.ols(v, x)
        elif not cells.enough(len(v), k, folds):
            continue
        else:
            found = cells.lasso_cv(v, x, folds, 100) if case.method == "LASSO_CV" else cells.lasso(v, x, alpha)
        for every, mine in zip(out, found, strict=True):
            every[..., own] = mine
    return out


def run(target: DataFrame, cell: list[str], designs: list[Case], alpha: float | None = None, folds: int = 5) -> DataFrame:
    """``cell, set, target_season, predictor, coef, p_value, r2, alpha`` of every cell, set and season: the confounders' signal is taken out
    of the target, and the rest is fitted by the set's method (OLS, LASSO_CV, or LASSO_fixed_alpha with ``alpha``).
    target: ``cell, season, value``. One shuffle by cell serves all cases; what a method does not give is NULL."""
    keys = ", ".join(f"`{c}` {target.schema[c].dataType.simpleString()}" for c in cell)
    series = target.groupBy(*cell).agg(F.collect_list(F.struct(F.unix_date(F.col("season").cast("date")).alias("at"), F.col("value").cast("double").alias("value"))).alias("s")).select(*cell, F.col("s.at").alias("_at"), F.col("s.value").alias("_value"))
    days = [np.array(c.stamps, "datetime64[D]").astype(np.int64) for c in designs]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("_at").offsets.to_numpy()))
            at = batch.column("_at").flatten().to_numpy()
            value = batch.column("_value").flatten().to_numpy(zero_copy_only=False)
            for case, stamps in zip(designs, days, strict=True):
                place = np.minimum(np.searchsorted(stamps, at), len(stamps) - 1)
                hit = stamps[place] == at
                y = np.full((len(stamps), batch.num_rows), np.nan)
                y[place[hit], column[hit]] = value[hit]
                rows = cells.rows_of(batch, cell, case.predictors, fit(case, y, alpha, folds))
                named = [pa.array([v] * rows.num_rows, pa.string()) for v in (case.name, case.target_season)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(cell)], *named, *rows.columns[len(cell) :]], names=[*cell, "set", "target_season", *rows.schema.names[len(cell) :]])

    return series.mapInArrow(solve, f"{keys}, set string, target_season string, predictor string, coef double, p_value double, r2 double, alpha double")


def spatial_alpha(target: DataFrame, cell: list[str], designs: list[Case], inside: Column, levels: str | None = None, folds: int = 5) -> float | None:
    """The penalty for a region: the median over its cells of the cross-validated one, for the first case. With ``levels`` the target is
    averaged over that column first."""
    field = target.filter(inside)
    if levels:
        cell = [c for c in cell if c != levels]
        field = field.groupBy(*cell, "season").agg(F.avg("value").alias("value"))
    first = [c._replace(method="LASSO_CV") for c in designs[:1]]
    fits = run(field, cell, first, folds=folds).select(*cell, "alpha").distinct()
    return fits.agg(F.median("alpha")).first()[0]
