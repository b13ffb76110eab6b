"""Regression and tests per cell. What sums can express is built in; dense solves run in numpy, a batch of cells at once (``cells``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.distributions import t_two_sided
from gridloom.operators import cells


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return F.pandas_udf(lambda x, n: pd.Series(t_two_sided(x.to_numpy(float), n.to_numpy(float))), "double")(t, df)


def slope_map(df: DataFrame, cell: list[str], y: str = "y", x: str = "x", least: int = 3) -> DataFrame:
    """``slope, r2, n`` of a simple regression in each cell; NULL below ``least`` pairs."""
    n = F.regr_count(y, x)
    return df.groupBy(*cell).agg(F.when(n >= least, F.regr_slope(y, x)).alias("slope"), F.when(n >= least, F.regr_r2(y, x)).alias("r2"), n.alias("n"))


def slope_significance(df: DataFrame, cell: list[str], critical: Column, y: str = "y", x: str = "x", n_mode: str = "pairs") -> DataFrame:
    """``slope, se, t, significant``. n_mode: degrees of freedom from the pairs, or from all rows of the cell."""
    n = F.regr_count(y, x) if n_mode == "pairs" else F.count(F.lit(1))
    sums = df.groupBy(*cell).agg(F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), n.alias("n"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(rest / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif(F.col("sxx"), F.lit(0.0)))
    out = sums.withColumn("se", se).withColumn("t", F.col("slope") / F.nullif(F.col("se"), F.lit(0.0)))
    return out.select(*cell, "slope", "se", "t", (F.abs("t") >= critical).alias("significant"))


def remove_signal(df: DataFrame, cell: list[str], signals: list[str], y: str = "y", out: str = "residual") -> DataFrame:
    """The residual of each cell's regression on the series, by sums over the cell; beyond two, one after another is taken out of the value
    and of the series that are left (a series without variance of its own is passed over)."""
    w = Window.partitionBy(*cell)
    ok = F.lit(True)
    for c in (y, *signals):
        ok = ok & F.col(c).isNotNull()
    v = {c: F.when(ok, F.col(c)) for c in (y, *signals)}
    dev = {c: v[c] - F.avg(v[c]).over(w) for c in v}
    staged = df.withColumns({f"_{i}": dev[c] for i, c in enumerate((y, *signals))})
    s = lambda a, b: F.sum(F.col(f"_{a}") * F.col(f"_{b}")).over(w)
    if len(signals) == 1:
        staged = staged.withColumn(out, F.col("_0") - F.coalesce(s(0, 1) / F.nullif(s(1, 1), F.lit(0.0)), F.lit(0.0)) * F.col("_1"))
    elif len(signals) == 2:
        det = F.nullif(s(1, 1) * s(2, 2) - s(1, 2) * s(1, 2), F.lit(0.0))
        b1, b2 = (s(0, 1) * s(2, 2) - s(0, 2) * s(1, 2)) / det, (s(0, 2) * s(1, 1) - s(0, 1) * s(1, 2)) / det
        staged = staged.withColumn(out, F.col("_0") - b1 * F.col("_1") - b2 * F.col("_2"))
    else:
        for j in range(1, len(signals) + 1):
            rest = [0, *range(j + 1, len(signals) + 1)]
            share = F.nullif(s(j, j), F.lit(0.0))
            staged = staged.withColumns({f"_{i}": F.col(f"_{i}") - F.coalesce(s(i, j) / share, F.lit(0.0)) * F.col(f"_{j}") for i in rest})
        staged = staged.withColumn(out, F.col("_0"))
    return staged.drop(*(f"_{i}" for i in range(len(signals) + 1)))


def remove_unless_gaps(df: DataFrame, cell: list[str], signal: str, y: str = "y", out: str = "residual") -> DataFrame:
    """As ``remove_signal``, but a cell with any missing value stays as it is."""
    gaps = F.count_if(F.col(y).isNull()).over(Window.partitionBy(*cell))
    return remove_signal(df, cell, [signal], y, "_r").withColumn(out, F.when(gaps > 0, F.col(y)).otherwise(F.col("_r"))).drop("_r")


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients and two-sided p-values of the predictors (a constant is added), and R squared; NaN where n < k + 2."""
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    y, x = y[ok], x[ok]
    n, k = x.shape
    if n < k + 2:
        return np.full(k, np.nan), np.full(k, np.nan), np.nan
    a = np.column_stack([np.ones(n), x])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    rest = y - a @ beta
    df = n - np.linalg.matrix_rank(a)
    cov = np.linalg.pinv(a.T @ a) * (rest @ rest) / max(df, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / np.sqrt(np.diag(cov))
        r2 = 1 - rest @ rest / ((y - y.mean()) ** 2).sum()
    return beta[1:], t_two_sided(t, df)[1:], float(r2)


def lasso(y: np.ndarray, x: np.ndarray, alpha: float, steps: int = 2000, tol: float = 1e-8) -> np.ndarray:
    """Minimises |y - xw|^2 / 2n + alpha |w|_1 after centring, by cyclic coordinate descent."""
    y, x = y - y.mean(), x - x.mean(axis=0)
    n, k = x.shape
    gram, target, w = x.T @ x / n, x.T @ y / n, np.zeros(k)
    for _ in range(steps):
        most = 0.0
        for j in range(k):
            if gram[j, j] < 1e-20:
                continue
            rho = target[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
            most, w[j] = max(most, abs(new - w[j])), new
        if most < tol:
            break
    return w


def lasso_path(y: np.ndarray, x: np.ndarray, n: int = 100, ratio: float = 1e-3) -> np.ndarray:
    top = np.abs((x - x.mean(axis=0)).T @ (y - y.mean())).max() / len(y)
    return np.geomspace(max(top, 1e-12), max(top, 1e-12) * ratio, n)


def lasso_cv(y: np.ndarray, x: np.ndarray, folds: int = 5, n_alphas: int = 100) -> tuple[float, np.ndarray]:
    """The penalty with the least mean error over consecutive folds, and the coefficients with it."""
    alphas = lasso_path(y, x, n_alphas)
    parts = np.array_split(np.arange(len(y)), folds)
    errors = np.zeros(len(alphas))
    for part in parts:
        train = np.setdiff1d(np.arange(len(y)), part)
        my, mx = y[train].mean(), x[train].mean(axis=0)
        for i, a in enumerate(alphas):
            w = lasso(y[train], x[train], a, steps=300, tol=1e-5)
            errors[i] += ((y[part] - my - (x[part] - mx) @ w) ** 2).mean() / folds
    best = float(alphas[errors.argmin()])
    return best, lasso(y, x, best)


def ols_multi(df: DataFrame, cell: list[str], y: str, predictors: list[str]) -> DataFrame:
    """``cell, predictor, coef, p_value, r2``; NULL below k + 2 steps."""
    return cells.fits(df, cell, y, predictors, cells.ols).drop("alpha")


def lasso_fixed(df: DataFrame, cell: list[str], y: str, predictors: list[str], alpha: float) -> DataFrame:
    """``cell, predictor, coef``; NULL below max(7, k + 1, 10) steps, 0 for a constant series."""
    k = len(predictors)
    fit = lambda v, x: cells.lasso(v, x, alpha) if cells.enough(len(v), k, 5) else cells.nothing(k, v.shape[1])
    return cells.fits(df, cell, y, predictors, fit).select(*cell, "predictor", "coef")


def lasso_cv_fit(df: DataFrame, cell: list[str], y: str, predictors: list[str], folds: int = 5, n_alphas: int = 100, order: str | None = None) -> DataFrame:
    """``cell, predictor, coef, alpha, r2`` with the cross-validated penalty of each cell; NULL below max(folds + 2, k + 1, 10) steps, and
    coefficients and r2 of 0 for a constant series. Folds are runs of steps by ``order``."""
    k = len(predictors)
    fit = lambda v, x: cells.lasso_cv(v, x, folds, n_alphas) if cells.enough(len(v), k, folds) else cells.nothing(k, v.shape[1])
    return cells.fits(df, cell, y, predictors, fit, order).select(*cell, "predictor", "coef", "alpha", "r2")


def lasso_cv_alpha(df: DataFrame, cell: list[str], y: str, predictors: list[str], folds: int = 5, order: str | None = None) -> DataFrame:
    """``cell, alpha``: the cross-validated penalty of each cell; its median is the penalty for a region."""
    return lasso_cv_fit(df, cell, y, predictors, folds, order=order).filter(F.col("predictor") == predictors[0]).select(*cell, "alpha")


def ols_normal(df: DataFrame, cell: list[str], y: str, predictors: list[str]) -> DataFrame:
    """``cell, predictor, coef, t, df, r2`` of a regression on a constant and up to three series, by sums over the cell: one aggregation, and
    the normal equations are solved in closed form. NULL below k + 2 rows or for dependent predictors."""
    k = len(predictors)
    if not 1 <= k <= 3:
        raise ValueError("one to three predictors; ols_multi takes more")
    names = [y, *predictors]
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    v = [F.when(ok, F.col(c).cast("double")) for c in names]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = df.groupBy(*cell).agg(F.count(v[0]).alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(v)), *((F.covar_pop(v[i], v[j]) * F.count(v[0])).alias(f"s{i}{j}") for i, j in pairs))
    s = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}")

    def det(rows: list[int], cols: list[int]) -> Column:
        if not rows:
            return F.lit(1.0)
        out = None
        for c, col in enumerate(cols):
            part = s(rows[0], col) * det(rows[1:], cols[:c] + cols[c + 1 :]) * (-1) ** c
            out = part if out is None else out + part
        return out

    every = list(range(1, k + 1))
    whole = F.nullif(det(every, every), F.lit(0.0))
    inverse = lambda i, j: det([r for r in every if r != j], [c for c in every if c != i]) * (-1) ** (i + j) / whole
    coefs = []
    for i in every:
        total = None
        for j in every:
            part = inverse(i, j) * s(0, j)
            total = part if total is None else total + part
        coefs.append(total)
    solved = sums.withColumns({f"b{i}": c for i, c in zip(every, coefs, strict=True)} | {f"v{i}": inverse(i, i) for i in every})
    explained = None
    for i in every:
        part = F.col(f"b{i}") * s(0, i)
        explained = part if explained is None else explained + part
    left = F.greatest(s(0, 0) - explained, F.lit(0.0))
    enough = F.col("n") >= k + 2
    free = (F.col("n") - k - 1).cast("double")
    rows = F.array(*(F.struct(F.lit(p).alias("predictor"), F.when(enough, F.col(f"b{i}")).alias("coef"), F.when(enough, F.col(f"b{i}") / F.nullif(F.sqrt(F.col(f"v{i}") * left / free), F.lit(0.0))).alias("t")) for i, p in zip(every, predictors, strict=True)))
    r2 = F.when(enough, 1 - left / F.nullif(s(0, 0), F.lit(0.0)))
    return solved.select(*cell, F.explode(rows).alias("x"), free.alias("df"), r2.alias("r2")).select(*cell, "x.*", "df", "r2")


def welch(df: DataFrame, cell: list[str], group: str, a, b, value: str = "value") -> DataFrame:
    """``t, df, n_a, n_b`` of the difference of two groups' means; NULL below two values in either."""
    own = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.groupBy(*cell).agg(*(f(own(g)).alias(f"{n}_{k}") for k, g in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    qa, qb = F.col("v_a") / F.nullif("n_a", F.lit(0)), F.col("v_b") / F.nullif("n_b", F.lit(0))
    ok = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    t = F.when(ok, (F.col("m_a") - F.col("m_b")) / F.nullif(F.sqrt(qa + qb), F.lit(0.0)))
    low = F.nullif(qa * qa / F.nullif(F.col("n_a") - 1, F.lit(0)) + qb * qb / F.nullif(F.col("n_b") - 1, F.lit(0)), F.lit(0.0))
    return s.select(*cell, t.alias("t"), F.when(ok, (qa + qb) * (qa + qb) / low).alias("df"), "n_a", "n_b")


def ttest_1samp(df: DataFrame, cell: list[str], value: str = "value", mean: float = 0.0) -> DataFrame:
    s = df.groupBy(*cell).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    return s.select(*cell, F.when(F.col("n") >= 2, (F.col("m") - mean) / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))).alias("t"), (F.col("n") - 1).alias("df"))


def bh_fdr(df: DataFrame, keys: list[str], p: str = "p_value", out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg: the least p m / rank of all equal or larger p in the family ``keys``."""
    family = Window.partitionBy(*keys)
    ranked = df.withColumn("_q", F.col(p) * F.count(p).over(family) / F.row_number().over(family.orderBy(p)))
    down = family.orderBy(F.col(p).desc(), F.col("_q").asc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min("_q").over(down))).drop("_q")
