"""Fits of all cells at once against fits of each cell alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells, stats


def problem(n=90, k=4, c=30, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) @ (np.eye(k) + 0.4 * rng.normal(size=(k, k))) + rng.normal(size=k)
    y = x @ (rng.normal(size=(k, c)) * (rng.random((k, c)) < 0.5)) + rng.normal(size=(n, c)) * rng.random(c) * 3
    y[:, -1] = 5.0
    return y, x


def test_least_squares_of_all_cells():
    y, x = problem()
    got = cells.ols(y, x)
    for i in range(y.shape[1] - 1):
        b, p, r2 = stats.ols(y[:, i], x)
        assert got.coef[:, i] == pytest.approx(b) and got.p[:, i] == pytest.approx(p, abs=1e-12) and got.r2[i] == pytest.approx(r2)
    assert np.isnan(cells.ols(y[:5], x[:5]).coef).all()
    same = np.column_stack([x[:, 0], x[:, 0]])
    assert cells.ols(y, same).coef[:, 0] == pytest.approx(stats.ols(y[:, 0], same)[0])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_penalised_fits_of_all_cells(seed):
    y, x = problem(seed=seed)
    got = cells.lasso_cv(y, x)
    n, c = y.shape
    for i in range(c - 1):
        alpha, w = stats.lasso_cv(y[:, i], x)
        path = stats.lasso_path(y[:, i], x)
        assert cells.penalties(y, x)[:, i] == pytest.approx(path)
        assert abs(np.argmin(abs(path - alpha)) - np.argmin(abs(path - got.alpha[i]))) <= 1  # paths with and without a warm start agree to their tolerance
        assert got.coef[:, i] == pytest.approx(stats.lasso(y[:, i], x, got.alpha[i]), abs=1e-6)
    # the conditions of a minimum, for all cells
    slope = (x - x.mean(0)).T @ (y - y.mean(0) - (x - x.mean(0)) @ got.coef) / n
    w, a, s = got.coef[:, :-1], got.alpha[:-1], slope[:, :-1]
    assert np.all(np.abs(s - a * np.sign(w))[w != 0] < 1e-6) and np.all((np.abs(s) <= a + 1e-6)[w == 0])
    assert not got.coef[:, -1].any() and got.r2[-1] == 0 and np.isnan(got.alpha[-1])


def test_a_column_that_rests_waits_for_none():
    y, x = problem(c=12)
    whole = cells.lasso(y, x, 0.05).coef
    alone = np.column_stack([cells.lasso(y[:, [i]], x, 0.05).coef[:, 0] for i in range(12)])
    assert whole == pytest.approx(alone, abs=1e-12)


def test_cells_with_gaps_get_their_own_design(spark):
    y, x = problem(n=40, k=2, c=9)
    rows = [(c, f"k{c % 2}", t, None if (c, t) in {(1, 3), (2, 3), (4, 0)} else float(y[t, c]), *map(float, x[t])) for t in range(40) for c in range(9)]
    rows += [(20, "few", t, 1.0 * t, *map(float, x[t])) for t in range(3)] + [(21, None, t, None, 1.0, float("nan")) for t in range(30)]
    df = spark.createDataFrame(rows, "cell int, kind string, t int, y double, a double, b double").repartition(5)
    got = {(r.cell, r.predictor): r for r in stats.lasso_cv_fit(df, ["cell", "kind"], "y", ["a", "b"], order="t").collect()}
    assert len(got) == 22
    for c in range(9):
        ok = np.array([t for t in range(40) if (c, t) not in {(1, 3), (2, 3), (4, 0)}])
        want = cells.lasso_cv(y[ok][:, [c]], x[ok])
        for i, p in enumerate("ab"):
            r = got[c, p]
            assert (r.kind, r.coef, r.r2) == (f"k{c % 2}", pytest.approx(want.coef[i, 0], abs=1e-9), pytest.approx(want.r2[0], abs=1e-9))
    assert got[20, "a"].coef is None and got[21, "a"].alpha is None and got[21, "b"].kind is None
    plain = {(r.cell, r.predictor): r.coef for r in stats.ols_multi(df, ["cell"], "y", ["a", "b"]).collect()}
    assert plain[3, "a"] == pytest.approx(stats.ols(y[:, 3], x)[0][0]) and plain[20, "a"] is None
    assert "BatchEvalPython" not in (plan := stats.ols_multi(df, ["cell"], "y", ["a", "b"])._jdf.queryExecution().toString()) and "FlatMapGroups" not in plan and "MapInArrow" in plan
    assert stats.lasso_fixed(df.limit(0), ["cell"], "y", ["a"], 0.1).count() == 0
    assert stats.ols_multi(df.withColumn("coef", F.col("y")), ["cell"], "coef", ["a"]).filter("cell = 3").first().coef is not None
