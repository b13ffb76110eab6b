"""Nested folds as a plan of sums against the plain search."""

import numpy as np
import pytest

from gridloom.operators import forecast, nested


def rows_of(key, n, k, seed, gaps=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * [10.0**i for i in range(k)] + 3 * np.arange(k) if k else np.zeros((n, 0))
    y = 100 + x @ rng.normal(size=k) + 2 * rng.normal(size=n)
    if gaps:
        x[rng.random((n, k)) < 0.05] = np.nan
        y[rng.random(n) < 0.1] = np.nan
    return key, x, y


@pytest.mark.parametrize("model,inner", [("ridge", 3), ("linear", 3)])
def test_plan_equals_the_plain_search(spark, model, inner):
    cases = [rows_of("a", 90, 3, 1), rows_of("b", 61, 1, 2), rows_of("c", 9, 2, 3), rows_of("d", 4, 1, 4), rows_of("e", 40, 4, 5, False), rows_of("f", 14, 12, 6, False)]
    cases[4][1][:, 3] = cases[4][1][:, 0]  # dependent
    cases[4][1][:20, 1] = 7.0  # constant in the first folds
    data = [(key, t, None if np.isnan(y[t]) and t % 2 else float(y[t]), {f"p{j}": None if np.isnan(v) and j % 2 else float(v) for j, v in enumerate(x[t])}) for key, x, y in cases for t in range(len(y))]
    design = spark.createDataFrame(data, "key string, t int, y double, x map<string,double>").repartition(4)
    alphas, scaled = forecast.SUMS[model]
    got = sorted((r.key, r.fold, r.t, r.y_true, r.y_pred) for r in nested.forecasts(design, ["key"], 5, inner, alphas, scaled).collect())
    want = sorted((key, *r) for key, x, y in cases for r in forecast._folds(np.arange(len(y)), y, x, 5, model, inner if model == "ridge" else None))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(got) >= 150
    for g, w in zip(got, want):
        if not (model == "linear" and w[0] in "ef"):  # of dependent columns the least coefficients depend on the scale
            assert g[4] == pytest.approx(w[4], rel=1e-6, abs=1e-6), g


def test_plan_has_no_group_of_rows_in_python(spark):
    design = spark.createDataFrame([("a", 1, 1.0, {"p": 1.0})], "key string, t int, y double, x map<string,double>")
    out = nested.forecasts(design, ["key"], 3, 2, [0.1, 1.0])
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString() and out.count() == 0
    assert nested.forecasts(design.limit(0), ["key"], 3, 2, [0.1, 1.0]).count() == 0


def test_moments_give_ridge():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=30)
    z = np.column_stack([np.ones(30), x, y])
    w = nested.solve((z.T @ z)[None].repeat(2, 0), np.array([5.0, 0.0]))
    for row, alpha in zip(w, (5.0, 1e-12)):
        predict = forecast.MODELS["ridge"](x, y, alpha=alpha)
        assert row[0] + x @ row[1:] == pytest.approx(predict(x), abs=1e-6)
