"""Lagged causal discovery: condition selection per target, then momentary tests given the parents of both ends.

All lags are 1 or more, so every edge is directed by time and targets are independent of each other in each phase. The unit of work is
(run, alpha, target): runs, windows, penalties and targets are what is distributed. A unit that fails is a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from gridloom.functions.distributions import normal_scores, t_two_sided
from gridloom.functions.named import named
from gridloom.operators import stats


def partial_correlation(x: np.ndarray, y: np.ndarray, z: np.ndarray, robust: bool = True) -> tuple[float, float]:
    """Correlation of the residuals given ``z`` (columns), and its two-sided p-value; robust: after normal scores."""
    n, k = len(x), z.shape[1]
    df = n - k - 2
    if df < 1:
        return 0.0, 1.0
    data = np.column_stack([x, y, z])
    data = normal_scores(data) if robust else data
    data = data - data.mean(axis=0)
    if k:
        data[:, :2] -= data[:, 2:] @ np.linalg.lstsq(data[:, 2:], data[:, :2], rcond=None)[0]
    a, b = data[:, 0], data[:, 1]
    size = np.sqrt((a @ a) * (b @ b))
    if size < 1e-12:
        return 0.0, 1.0
    r = float(np.clip(a @ b / size, -1, 1))
    t = r * np.sqrt(df / max(1e-300, 1 - r * r))
    return r, float(t_two_sided(t, df))


def process_residual(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """What a Gaussian process with a squared-exponential kernel and noise leaves of ``y`` given ``z``; length and noise are those of a
    fixed grid with the greatest likelihood. Columns are standardised."""
    z = (z - z.mean(axis=0)) / np.where(z.std(axis=0) < 1e-12, 1, z.std(axis=0))
    y = (y - y.mean()) / max(y.std(), 1e-12)
    distance = ((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2)
    best = (-np.inf, y)
    for length in (0.5, 1.0, 2.0, 4.0, 8.0):
        kernel = np.exp(-distance / (2 * length * length * z.shape[1]))
        for noise in (0.1, 0.3, 0.6, 0.9):
            c = np.linalg.cholesky((1 - noise) * kernel + noise * np.eye(len(y)))
            w = np.linalg.solve(c.T, np.linalg.solve(c, y))
            likelihood = -0.5 * y @ w - np.log(np.diag(c)).sum()
            if likelihood > best[0]:
                best = (likelihood, y - (1 - noise) * kernel @ w)
    return best[1]


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    def centred(v: np.ndarray) -> np.ndarray:
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    size = np.sqrt((a * a).mean() * (b * b).mean())
    return float(np.sqrt(max((a * b).mean(), 0) / size)) if size > 1e-300 else 0.0


def ranks(x: np.ndarray) -> np.ndarray:
    """Each value's place among all, in (0, 1)."""
    return (np.argsort(np.argsort(x, kind="stable"), kind="stable") + 0.5) / len(x)


@lru_cache(maxsize=256)
def null_distances(n: int, draws: int = 500) -> np.ndarray:
    """Distance correlations of independent uniform samples of size ``n``, ascending; seeded by the size."""
    rng = np.random.default_rng(n)
    return np.sort([distance_correlation(rng.random(n), rng.random(n)) for _ in range(draws)])


def process_distance(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """Dependence given ``z`` (columns) of any form: the distance correlation of the uniform ranks of what Gaussian processes leave of both,
    and the share of independent samples that reach it."""
    n = len(x)
    if n - z.shape[1] - 2 < 1 or x.std() < 1e-12 or y.std() < 1e-12:
        return 0.0, 1.0
    if z.shape[1]:
        x, y = process_residual(x, z), process_residual(y, z)
    value = distance_correlation(ranks(x), ranks(y))
    null = null_distances(n)
    return value, float(1 + len(null) - np.searchsorted(null, value)) / (len(null) + 1)


#: Conditional independence tests by name. Others may be added: a test takes x, y and the columns z, and gives effect and p-value.
TESTS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, float]]] = {
    "robust_parcorr": partial_correlation,
    "parcorr": lambda x, y, z: partial_correlation(x, y, z, robust=False),
    "gpdc": process_distance,
}


class Lagged:
    """A panel (steps x variables) with a mask of hidden target steps. test: see ``named``."""

    def __init__(self, values: np.ndarray, masked: np.ndarray, most: int, test: str = "robust_parcorr"):
        self.v, self.m, self.most, self.judge = values, masked, most, named(test, TESTS)

    def test(self, i: int, lag: int, j: int, conditions: list[tuple[int, int]]) -> tuple[float, float]:
        """``i`` at t - lag against ``j`` at t, given (variable, lag) pairs; conditions later than the cause are left out."""
        given = [(k, c) for k, c in conditions if c >= lag and (k, c) != (i, lag)]
        start = max([self.most, lag, *(c for _, c in given)])
        t = np.arange(start, len(self.v))
        t = t[~self.m[t, j]]
        z = np.column_stack([self.v[t - c, k] for k, c in given]) if given else np.zeros((len(t), 0))
        return self.judge(self.v[t - lag, i], self.v[t, j], z)


def select_parents(panel: Lagged, j: int, alpha: float, least: int, most_sets: int) -> list[tuple[int, int]]:
    """The lagged conditions of ``j``: candidates that no set of stronger ones explains away, the strongest first."""
    left = {(i, lag): np.inf for i in range(panel.v.shape[1]) for lag in range(least, panel.most + 1)}
    order = sorted(left)
    size = 0
    while size <= len(order) - 1:
        gone = []
        for x in order:
            others = [o for o in order if o != x]
            for given in islice(combinations(others, size), most_sets):
                r, p = panel.test(*x, j, list(given))
                left[x] = min(left[x], abs(r))
                if p > alpha:
                    gone.append(x)
                    break
        for x in gone:
            del left[x]
        order = sorted(left, key=lambda x: (-left[x], x))
        size += 1
    return order


def momentary(panel: Lagged, parents: dict[int, list[tuple[int, int]]], j: int, least: int, every: bool = True) -> list[tuple[int, int, float, float]]:
    """``(cause, lag, effect, p)`` for all causes of ``j`` given the parents of both ends."""
    out = []
    for i in range(panel.v.shape[1]):
        for lag in range(least, panel.most + 1):
            if every or (i, lag) in parents[j]:
                given = [x for x in parents[j] if x != (i, lag)] + [(k, c + lag) for k, c in parents.get(i, [])]
                out.append((i, lag, *panel.test(i, lag, j, list(dict.fromkeys(given)))))
    return out


def effect_of(panel: Lagged, i: int, lag: int, j: int, alpha: float, least: int = 1, most_sets: int = 10) -> tuple[float, float]:
    """Effect and p-value of one edge of the graph: conditions are selected for its two ends alone, as no other's enter its test."""
    parents = {k: select_parents(panel, k, alpha, least, most_sets) for k in {i, j}}
    given = [x for x in parents[j] if x != (i, lag)] + [(k, c + lag) for k, c in parents[i]]
    return panel.test(i, lag, j, list(dict.fromkeys(given)))


def windows_by_years(panel: DataFrame, years: int, step: int, per_year: int = 4, least_per_year: int = 1, time: str = "t") -> DataFrame:
    """The panel's rows once for each window they lie in, with ``window, centre``. A window has ``ceil(years * per_year / least_per_year)``
    steps, as a target may be seen in so few seasons of a year; windows begin every so many of ``step`` years and are whole. ``centre`` is the step in a window's middle. There are no windows
    longer than the panel. Steps are dense from 0."""
    length, stride = -(-years * per_year // least_per_year), max(1, -(-step * per_year // least_per_year))
    last = panel.agg(F.max(time).alias("_last"))
    t = F.col(time)
    first = F.greatest(F.lit(0), F.ceil((t - (length - 1)) / stride)).cast("int")
    end = F.least(F.floor(t / stride), F.floor((F.col("_last") - (length - 1)) / stride)).cast("int")
    rows = panel.crossJoin(F.broadcast(last)).filter((F.col("_last") >= length - 1) & (end >= first))
    return rows.withColumn("window", F.explode(F.sequence(first, end))).drop("_last").withColumn("centre", F.col("window") * stride + length // 2)


FOUND = "array<struct<cause string, lag int, causal_effect double, p_value double>>"


def _per_target(rows: DataFrame, out: str, kind: str, work: Callable[[dict, list[str], Lagged, int], list[dict]], test: str, most: int) -> DataFrame:
    """``keys, target, out, error``: ``work`` on each row, which is a run's packed panel and a target. A row whose work fails has the error's
    text instead. Rows are dealt out one by one, as each is minutes of work on some kilobytes."""
    kept = [f for f in rows.schema if not f.name.startswith("_")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found, error = None, None
                try:
                    names, panel = opened(row["_panel"], most, test)
                    found = work(row, names, panel, names.index(row["target"]))
                except Exception as failed:  # noqa: BLE001  any failure of a run is a result, and others go on
                    error = f"{type(failed).__name__}: {failed}"
                own = batch.slice(i, 1).select([f.name for f in kept])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([found], arrow_kind), pa.array([error], pa.string())], names=[*own.schema.names, out, "error"])

    arrow_kind = to_arrow_type(_parse_datatype_string(kind))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.repartition(n, *(f.name for f in kept if f.name != "alpha")).mapInArrow(run, f"{fields}, {out} {kind}, error string")


def opened(cells: list[dict], most: int, test: str) -> tuple[list[str], Lagged]:
    """The names, in order, and the panel of packed cells. A missing value is 0, as for a hidden one; one that is infinite has no meaning."""
    names, steps = sorted({c["var"] for c in cells}), sorted({c["t"] for c in cells})
    column, line = {v: k for k, v in enumerate(names)}, {t: k for k, t in enumerate(steps)}
    values, hidden = np.zeros((len(steps), len(names))), np.zeros((len(steps), len(names)), bool)
    for c in cells:
        v = c["value"]
        if v is not None and np.isinf(v):
            raise ValueError(f"{c['var']} is infinite at step {c['t']}")
        at = line[c["t"]], column[c["var"]]
        values[at], hidden[at] = 0.0 if v is None or np.isnan(v) else v, bool(c["masked"])
    return names, Lagged(values, hidden, most, test)


def attempts(panel: DataFrame, run: list[str], targets: list[str] | None = None, alpha: str = "alpha", least: int = 1, most: int = 6, most_sets: int = 10, test: str = "robust_parcorr") -> DataFrame:
    """``run, alpha, target, edges, error``: the tests of each target of each run, or why they failed.

    A run's panel (steps x variables, some thousands of cells) is packed into one row, and goes to each of its targets, which are what is
    distributed: first to select the parents of every variable, then to test each target given the parents of both ends."""
    keys = [*run, alpha]
    cells = F.sort_array(F.collect_list(F.struct("t", "var", "value", "masked")))
    packed = panel.groupBy(*keys).agg(cells.alias("_panel"))
    every = packed.select(*keys, "_panel", F.explode(F.array_distinct(F.transform("_panel", lambda c: c["var"]))).alias("target"))
    chosen = _per_target(every, "parents", "array<struct<var string, lag int>>", lambda row, names, data, j: [{"var": names[k], "lag": c} for k, c in select_parents(data, j, float(row[alpha]), least, most_sets)], test, most)
    known = chosen.groupBy(*keys).agg(F.collect_list(F.struct("target", "parents")).alias("_parents"), F.min("error").alias("_error"))
    again = every.join(known, keys)
    if targets is not None:
        again = again.filter(F.col("target").isin(targets))

    def tested(row: dict, names: list[str], data: Lagged, j: int) -> list[dict]:
        if row["_error"]:
            raise ValueError(row["_error"])
        parents = {names.index(x["target"]): [(names.index(p["var"]), p["lag"]) for p in x["parents"]] for x in row["_parents"]}
        return [{"cause": names[i], "lag": lag, "causal_effect": float(r), "p_value": float(p)} for i, lag, r, p in momentary(data, parents, j, least)]

    return _per_target(again, "edges", FOUND, tested, test, most)


def outcomes(attempted: DataFrame, run: list[str], alpha: str = "alpha") -> DataFrame:
    """``run, alpha, ok, tests, error``: a row for each run. A run of which any target failed has no graph, and the first error's text."""
    s = attempted.groupBy(*run, alpha).agg(F.min("error").alias("error"), F.sum(F.size("edges")).alias("tests"))
    return s.select(*run, alpha, F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), F.col("tests")).otherwise(0).alias("tests"), F.regexp_replace("error", "^(ValueError: )+", "").alias("error"))


def discover(panel: DataFrame, run: list[str], targets: list[str] | None = None, alpha: str = "alpha", least: int = 1, most: int = 6, most_sets: int = 10, test: str = "robust_parcorr", fdr: bool = False) -> DataFrame:
    """``run, cause, effect, lag, causal_effect, p_value`` with a row for each pair and lag of each run that went well; ``outcomes`` of
    ``attempts`` tells of the others.

    panel: ``run, alpha, t, var, value, masked``, a bounded reanalysis season panel a run; missing values are 0. With ``fdr`` the p-values are
    adjusted over all tests of the run (Benjamini-Hochberg). test: a name in ``TESTS``."""
    keys = [*run, alpha]
    tried = attempts(panel, run, targets, alpha, least, most, most_sets, test).withColumn("_failed", F.count("error").over(Window.partitionBy(*keys)))
    found = tried.filter("_failed = 0").select(*keys, F.col("target").alias("effect"), F.inline("edges"))
    if fdr:
        found = stats.bh_fdr(found, keys).withColumn("p_value", F.col("q_value"))
    return found.select(*keys, "cause", "effect", "lag", "causal_effect", "p_value")
