"""Programs, models, coupled modes, searches and sinks against plain numpy and planted structure."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import trees
from gridloom.operators import composite, coupled, edges, forecast, indices, modes, pcmci, program, region_search, stats
from gridloom.sources import progress, scan

STAMPS = [datetime.date(1980 + k // 4, 1 + 3 * (k % 4), 1) for k in range(120)]


def test_signals_of_any_number_are_removed(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(50, 4))
    y = z @ [1, 2, -1, 0.5] + rng.normal(size=50)
    df = spark.createDataFrame([(i, 0, *map(float, (y[i], *z[i], z[i, 0]))) for i in range(50)], "i int, cell int, y double, a double, b double, c double, d double, same double")
    base = np.column_stack([np.ones(50), z])
    want = y - base @ np.linalg.lstsq(base, y, rcond=None)[0]
    for signals in (["a", "b", "c", "d"], ["a", "b", "same", "c", "d"]):
        got = [r.residual for r in stats.remove_signal(df, ["cell"], signals).orderBy("i").collect()]
        assert got == pytest.approx(want, abs=1e-9)


def test_normal_equations_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = [(c, *map(float, rng.normal(size=4))) for c in range(3) for _ in range(30)] + [(9, 1.0, 1.0, 1.0, 1.0)] * 4
    df = spark.createDataFrame(rows, "cell int, y double, a double, b double, c double")
    got = {(r.cell, r.predictor): (r.coef, r.p_value, r.r2) for r in stats.ols_normal(df, ["cell"], "y", ["a", "b", "c"]).withColumn("p_value", stats.t_p_value(F.col("t"), F.col("df"))).collect()}
    want = {(r.cell, r.predictor): (r.coef, r.p_value, r.r2) for r in stats.ols_multi(df.filter("cell < 9"), ["cell"], "y", ["a", "b", "c"]).collect()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6)
    assert got[9, "a"][0] is None


def test_lasso_fit_gives_coefficients(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = 2 * x[:, 0] + 0.1 * rng.normal(size=80)
    rows = [(0, float(a), *map(float, b)) for a, b in zip(y, x)] + [(1, 1.0, *map(float, b)) for b in x] + [(2, 1.0, 2.0, 3.0)]
    got = {(r.cell, r.predictor): r for r in stats.lasso_cv_fit(spark.createDataFrame(rows, "cell int, y double, a double, b double"), ["cell"], "y", ["a", "b"]).collect()}
    assert got[0, "a"].coef == pytest.approx(2, abs=0.1) and abs(got[0, "b"].coef) < 0.1 and got[0, "a"].r2 > 0.98 and got[0, "a"].alpha > 0
    assert got[1, "a"].coef == 0 and got[1, "a"].r2 == 0 and got[2, "a"].coef is None


def test_rotated_shares_are_of_the_rotated_variance():
    x = np.random.default_rng(4).normal(size=(60, 8)) * np.arange(1, 9)
    x -= x.mean(0)
    patterns, rotation, percent = modes.reof(x.T @ x, 3)
    assert percent.sum() == pytest.approx(100) and np.var(x @ patterns.T, axis=0, ddof=1) / np.var(x @ patterns.T, axis=0, ddof=1).sum() * 100 == pytest.approx(percent)
    assert patterns == pytest.approx((modes.eof(x.T @ x, 3)[0].T @ rotation).T)


def test_trees_fit_steps():
    rng = np.random.default_rng(5)
    x = rng.random((200, 3))
    y = np.where(x[:, 1] > 0.5, 3.0, -1.0) + (x[:, 2] > 0.2)
    assert trees.grow(x, y, rng).predict(x) == pytest.approx(y)
    assert len(trees.grow(x, y, rng, depth=1).value) == 3 and min(np.unique(trees.grow(x, y, rng, least=40).predict(x), return_counts=True)[1]) >= 40
    z = rng.random((100, 3))
    want = np.where(z[:, 1] > 0.5, 3.0, -1.0) + (z[:, 2] > 0.2)
    for fit in (trees.forest(x, y, 30), trees.boosting(x, y, 100, subsample=0.8)):
        assert np.abs(fit(z) - want).mean() < 0.2
    assert trees.share("sqrt", 9) == 3 and trees.share(0.5, 9) == 4 and trees.share(None, 9) is None
    assert (trees.forest(x, y, 5)(z) == trees.forest(x, y, 5)(z)).all()


@pytest.mark.parametrize("model", sorted(forecast.MODELS))
def test_models_predict(model):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2))
    y = 1 + x[:, 0] + 0.05 * rng.normal(size=90)
    grid = {"n_estimators": [20]} if model == "random_forest" else {"learning_rate": [0.1, 0.2]} if model == "gradient_boosting" else None
    fit = forecast.tuned(x[:60], y[:60], model, 3, grid)
    assert np.corrcoef(fit(x[60:]), y[60:])[0, 1] > 0.85


def test_search_takes_the_better_penalty():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 12))
    y = rng.normal(size=40)
    heavy, light = forecast.tuned(x, y, "ridge", 3), forecast.MODELS["ridge"](x, y, alpha=100.0)
    assert heavy(x) == pytest.approx(light(x))  # noise alone is shrunk most
    assert forecast.expanding(10, 3) == [(4, 6), (6, 8), (8, 10)] and forecast.expanding(2, 3) == []


def test_forecasts_use_parents_by_season(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 100))
    y = np.concatenate([np.zeros(6), a[:-6]]) + 0.01 * rng.normal(size=100)
    panel = spark.createDataFrame([(t, v, float(s[t]), v == "y" and t % 7 == 0) for v, s in (("a", a), ("b", b), ("y", y)) for t in range(100)], "t int, var string, value double, masked boolean")
    parents = spark.createDataFrame([("s", "y", "a", -6), ("s", "y", "b", -4), ("s", "y", "b", -2), ("s", "y", "b", -9)], "set string, target string, parent string, lag int")
    chosen = {(r.max_season, r.parent, r.lag) for r in forecast.cumulative_parents(parents, ["set", "target"]).collect()}
    assert chosen == {(s, "a", -6) for s in forecast.CUMULATIVE} | {(s, "b", -4) for s in forecast.CUMULATIVE[2:]}
    predicted = forecast.forecasts(panel, parents, ["set"], "linear")
    assert all(r.t % 7 for r in predicted.collect())
    table = forecast.skill_table(predicted, ["set"]).collect()
    assert [r.max_season for r in table] == forecast.CUMULATIVE and all(r.r > 0.99 and r.rmse < 0.05 and r.n_events_observed == r.hits + r.misses for r in table)


def _field(spark, x, names):
    return spark.createDataFrame([(names[j], 10.0 * j, STAMPS[i], float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "cell string, lat double, season date, value double")


def test_coupled_modes_equal_a_plain_decomposition(spark):
    rng = np.random.default_rng(9)
    shared = rng.normal(size=(120, 2)) * [3, 1.5]
    x, y, z = (shared @ rng.normal(size=(2, k)) + 0.3 * rng.normal(size=(120, k)) for k in (6, 4, 4))
    y[5, 3] = np.nan  # a cell with a gap takes no part
    names = [list("abcdef"[:k]) for k in (6, 4, 4)]
    fields = [coupled.prepared(_field(spark, v, n), ["cell", "lat"]) for v, n in zip((x, y, z), names)]
    pcs, left, right, percent = coupled.mca(fields[0], fields[1:], ["cell", "lat"], k=2)

    def plain(v):
        out = np.empty_like(v)
        for m in range(4):
            part = v[m::4]
            out[m::4] = (part - np.nanmean(part, axis=0)) / np.nanstd(part, axis=0)
        w = np.sqrt(np.cos(np.radians(10.0 * np.arange(v.shape[1]))))
        return out * w, w

    (a, wa), (b, wb), (c, _) = plain(x), plain(y), plain(z)
    both = np.concatenate([b[:, :3], c], axis=1)
    u, s, v = np.linalg.svd(a.T @ both / 119, full_matrices=False)
    assert percent == pytest.approx(100 * s[:2] ** 2 / (s**2).sum())
    table = {(r.season, r.mode): (r.left, r.right) for r in pcs.collect()}
    for m in range(2):
        for k, raw in enumerate((a @ u[:, m], both @ v[m])):
            want = raw.copy()
            for q in range(4):
                want[q::4] = (raw[q::4] - raw[q::4].mean()) / raw[q::4].std()
            got = np.array([table[t, m + 1][k] for t in STAMPS])
            assert got * np.sign(got @ want) == pytest.approx(want, abs=1e-6)
    pattern = {(r.cell, r.mode): r.pattern for r in left.collect()}
    want = u[:, 0] / wa * (a @ u[:, 0]).std()
    got = np.array([pattern[n, 1] for n in names[0]])
    assert got * np.sign(got @ want) == pytest.approx(want, abs=1e-6)
    assert {r.cell for r in right[0].collect()} == {"a", "b", "c"} and right[1].count() == 8
    gram = a @ a.T
    eof, plain_eof = coupled.principal(gram, 2), np.linalg.svd(a, full_matrices=False)
    assert eof.percent == pytest.approx(100 * plain_eof[1][:2] ** 2 / (plain_eof[1] ** 2).sum()) and np.abs(eof.left[:, 0]) == pytest.approx(np.abs(plain_eof[0][:, 0] * plain_eof[1][0]))


def test_program_equals_plain_regressions(spark):
    rng = np.random.default_rng(10)
    p, q, z = rng.normal(size=(3, 120))
    y = np.concatenate([np.zeros(6), p[:-6]]) * 2 + 5 * np.concatenate([np.zeros(5), z[:-5]]) + 0.1 * rng.normal(size=120)
    series = spark.createDataFrame([(n, STAMPS[t], float(s[t])) for n, s in (("p", p), ("q", q)) for t in range(120)], "name string, season date, value double")
    confounder = spark.createDataFrame([("z", STAMPS[t], float(z[t]) if t != 30 else None) for t in range(120)], "name string, season date, value double")
    predictors = spark.createDataFrame([("p", "EP", 6), ("q", "EP", 5), ("q", "CP", 5)], "name string, pathway string, lag int")
    sets = spark.createDataFrame([("o", "lag6-5", "EP", "OLS"), ("f", "lag6-5_COMBINED", "COMBINED", "LASSO_fixed_alpha"), ("none", "lag3", "EP", "OLS")], "set string, lags string, pathway string, method string")
    designs = program.cases(series, confounder, predictors, sets)
    assert {(c.name, c.target_season) for c in designs} == {(n, s) for n in "of" for s in list(program.TARGET_LAGS)[1:]}
    target = spark.createDataFrame([(c, STAMPS[t], float(y[t])) for c in (1, 2) for t in range(120)], "cell int, season date, value double")
    got = {(r.cell, r.set, r.target_season, r.predictor): r for r in program.run(target, ["cell"], designs, 0.05).collect()}
    r = got[1, "o", "DJF_1", "p"]
    steps = [t for t in range(120) if STAMPS[t].month == 1 and t >= 6 and t - 5 != 30]
    zs = np.array([z[t - 5] for t in steps])
    base = np.column_stack([np.ones(len(steps)), zs])
    rest = y[steps] - base @ np.linalg.lstsq(base, y[steps], rcond=None)[0]
    b, pv, r2 = stats.ols(rest, np.array([[p[t - 6], q[t - 5]] for t in steps]))
    assert (r.coef, r.p_value, r.r2) == pytest.approx((b[0], pv[0], r2)) and r.coef == pytest.approx(2, abs=0.2) and r.alpha is None
    lasso = got[2, "f", "DJF_1", "p"]
    assert lasso.p_value is None and lasso.alpha == 0.05 and 1.5 < lasso.coef < r.coef + 0.1
    assert program.spatial_alpha(target, ["cell"], designs, F.col("cell") == 1) > 0
    assert program.run(target.limit(0), ["cell"], designs, 0.05).count() == 0


def test_process_test_sees_what_correlation_misses():
    rng = np.random.default_rng(11)
    x, z = rng.normal(size=(2, 120))
    y = x**2 + 0.2 * rng.normal(size=120)
    none = np.zeros((120, 0))
    assert pcmci.TESTS["gpdc"](x, y, none)[1] < 0.01 and pcmci.TESTS["parcorr"](x, y, none)[1] > 0.01
    both = np.sin(z) + 0.1 * rng.normal(size=(2, 120))
    assert pcmci.TESTS["gpdc"](both[0], both[1], none)[1] < 0.01 < pcmci.TESTS["gpdc"](both[0], both[1], z[:, None])[1]
    assert pcmci.TESTS["gpdc"](x, np.ones(120), none) == (0.0, 1.0)


def test_one_edge_is_that_of_the_whole_graph(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(80, 3))
    for t in range(2, 80):
        v[t, 1] += 0.8 * v[t - 2, 0]
    panel = spark.createDataFrame([(0, 0.05, t, f"v{k}", float(v[t, k]), False) for t in range(80) for k in range(3)], "run int, alpha double, t int, var string, value double, masked boolean")
    row = pcmci.discover(panel, ["run"]).filter("cause = 'v0' and effect = 'v1' and lag = 2").first()
    lagged = pcmci.Lagged(v, np.zeros(v.shape, bool), 6)
    assert pcmci.effect_of(lagged, 0, 2, 1, 0.05) == pytest.approx((row.causal_effect, row.p_value)) and row.p_value < 1e-6


def test_rectangles_stay_valid_under_the_rules():
    rng, b = random.Random(13), region_search.Bounds(-30, 30, -90, 0)
    x, y = region_search.Rect(-10, 0, -60, -30), region_search.Rect(5, 25, -50, -20)
    kids = {region_search.crossover(rng, x, y, b) for _ in range(200)}
    mean = region_search.Rect(-2, 12, -55, -25)
    assert kids == {region_search.Rect(*x[:2], *y[2:]), region_search.Rect(*y[:2], *x[2:]), mean}
    moved = [region_search.mutate(rng, x, b) for _ in range(300)]
    assert all(region_search.valid(m, b) for m in moved) and len(set(moved)) > 100
    assert any(m[1] - m[0] == 10 and m[3] - m[2] == 30 and m != x for m in moved)
    tight = region_search.Bounds(0, 5, 0, 10)
    only = region_search.Rect(0, 5, 0, 10)
    assert region_search.mutate(rng, only, tight) == only and region_search.crossover(rng, only, only, tight) == only


@pytest.mark.parametrize("right", [(), ("w",)])
def test_search_finds_the_region_that_acts(spark, right):
    rng = np.random.default_rng(14)
    source = rng.normal(size=90)
    rows = []
    for lat in range(0, 40, 5):
        for lon in range(0, 80, 10):
            own = rng.normal(size=(2, 90)) * 0.3 + (source if lat < 20 and lon < 40 else rng.normal(size=90))
            rows += [(float(lat), float(lon), t, float(own[0, t]), float(own[1, t])) for t in range(90)]
    fields = spark.createDataFrame(rows, "lat double, lon double, t int, value double, w double").repartition(3)
    y = np.concatenate([np.zeros(3), source[:-3]]) + 0.3 * rng.normal(size=90)
    panel = spark.createDataFrame([(t, n, float(s[t]), False) for n, s in (("y", y), ("other", rng.normal(size=90))) for t in range(90)], "t int, var string, value double, masked boolean")
    rects = [region_search.Rect(0, 15, 0, 30), region_search.Rect(20, 35, 40, 70), region_search.Rect(41, 50, 0, 30)]
    got = {r.id: r.effect for r in region_search.causal_fitness(fields, panel, rects, "y", 3, right).collect()}
    assert got[0] > 0.8 > 0.5 > got[1] and 2 not in got


def test_work_is_resumed(spark, tmp_path):
    path, seen = f"file://{tmp_path}/progress", []

    def work(chunk):
        if chunk == "c" and "c" not in seen:
            seen.append(chunk)
            raise RuntimeError("stopped")
        seen.append(chunk)
        return 5

    with pytest.raises(RuntimeError):
        progress.resume(spark, path, ["a", "b", "a", "c", "d"], work)
    assert progress.pending(spark, path, ["a", "b", "c", "d"]) == ["c", "d"]
    assert progress.resume(spark, path, ["a", "b", "c", "d"], work) == 2 and seen == ["a", "b", "c", "c", "d"]
    assert sorted((r.chunk, r.rows) for r in progress.done(spark, path).collect()) == [(c, 5) for c in "abcd"]


def test_sidecar_says_what_was_written(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "lat double, lon double, value double")
    row = scan.write_with_sidecar(df, f"file://{tmp_path}/field", "scan", {"b": 1, "a": "x"}, f"file://{tmp_path}/registry").first()
    assert row.rows == 1 and row.parameters == '{"a": "x", "b": 1}' and len(row.hash) == 8 and "value:double" in row.columns
    assert spark.read.json(f"file://{tmp_path}/registry").count() == 1 and spark.read.json(f"file://{tmp_path}/field.json").count() == 1


@pytest.mark.parametrize("name,least", [("EC", None), ("SPO", "mean"), ("PSA", "mean")])
def test_named_indices_are_those_of_a_plain_decomposition(spark, name, least):
    rng = np.random.default_rng(15)
    lats, lons = [-4.0, -1.0, 3.0], [172.0, 178.0, -170.0, -100.0, 20.0]
    places = [(a, o) for a in lats for o in lons]
    x = (rng.normal(size=(120, 3)) * [4, 2, 1]) @ rng.normal(size=(3, 15)) + 0.2 * rng.normal(size=(120, 15))
    rows = [(*places[j], STAMPS[i], float(x[i, j])) for i in range(120) for j in range(15)]
    box = (-5, 5, 170, -80)
    got = {(r.season, r.name): r.value for r in indices.named(spark.createDataFrame(rows, "lat double, lon double, season date, value double"), name, box).collect()}
    inside = [j for j, (_, o) in enumerate(places) if o != 20.0]
    w = np.sqrt(np.cos(np.radians([places[j][0] for j in inside])))
    y = (x[:, inside] - x[:, inside].mean(axis=0)) * w
    u, s, v = np.linalg.svd(y, full_matrices=False)
    pc = u * s

    def standard(series):
        out = series.copy()
        for q in range(4):
            out[q::4] = (series[q::4] - series[q::4].mean()) / series[q::4].std()
        return out

    if name == "EC":
        sums = [standard((a * pc[:, 0] + b * pc[:, 1]) / 2**0.5) for a in (1, -1) for b in (1, -1)]
        for n in "EC":
            assert any(np.array([got[t, n] for t in STAMPS]) == pytest.approx(z, abs=1e-6) for z in sums)
    else:
        for n, m in {"SPO": {"SPO": 0}, "PSA": {"PSA1": 1, "PSA2": 2}}[name].items():
            want = standard(pc[:, m] * (1 if v[m].mean() > 0 else -1))
            assert np.array([got[t, n] for t in STAMPS]) == pytest.approx(want, abs=1e-6)


def test_graphs_of_sets_reach_the_target(spark):
    rows = [(s, k, 0.05, c, e, lag, 0.5, 0.01) for s in ("x", "y") for k in range(4) for c, e, lag in (("a", "goal", 3), ("b", "a", 1), ("c", "b", 3), ("d", "other", 2))]
    runs = spark.createDataFrame(rows, "set string, run_idx int, alpha double, cause string, effect string, lag int, causal_effect double, p_value double")
    adjusted = runs.filter("run_idx = 0 and not (set = 'y' and cause = 'b')").drop("run_idx")
    got = {(r.set, r.cause, r.effect, r.lag) for r in edges.graphs(runs, adjusted, ["goal"]).collect()}
    assert got == {("x", "a", "goal", 3), ("x", "b", "a", 1), ("y", "a", "goal", 3)}
    assert {r.cause for r in edges.graphs(runs, None, ["goal"]).collect()} == {"a", "b"}


def test_seasons_that_are_shown():
    assert [s[0] for s in composite.target_seasons("DJF_0")] == ["DJF_0", "MAM_0", "JJA_0", "SON_0", "DJF_1"] and len(composite.target_seasons()) == 7 == len(composite.target_seasons("odd"))
    assert [s[0] for s in composite.target_seasons("DJF_0", ["SON_0", "JJA_-1", "no"])] == ["JJA_-1", "SON_0"]
    assert composite.seasons_to_plot(["b", "z", "a"], list("abc")) == ["b", "a"] and composite.seasons_to_plot(None, list("abc"), 1) == ["b", "c"]


def test_persistence_is_written_and_files_are_checked(spark, tmp_path):
    rows = [(k, 0.05, "a", "b", 2, 0.5, 0.01) for k in range(4)] + [(k, 0.05, "c", "b", 1, 0.5, 0.2) for k in range(4)]
    runs = spark.createDataFrame(rows, "run_idx int, alpha double, cause string, effect string, lag int, causal_effect double, p_value double")
    s = scan.write_persistence(edges.persistence(runs), f"file://{tmp_path}/p").first()
    assert (s.edges, s.persistent, s.robust, s.mean_ratio) == (2, 1, 1, 0.5)
    assert [r.cause for r in spark.read.csv(f"file://{tmp_path}/p/robust", header=True).collect()] == ["a"]
    runs.limit(1).write.parquet(f"file://{tmp_path}/good")
    (tmp_path / "bad").write_bytes(b"PAR1 not a table")
    paths = [f"file://{tmp_path}/{n}" for n in ("good", "bad", "none")]
    assert list(scan.readable(spark, paths).values()) == [True, False, False]


def test_composites_are_tested(spark):
    rng = np.random.default_rng(16)
    rows = [(y, c, float(rng.normal() + (5 if c == 1 and y % 2 else 0))) for y in range(20) for c in (1, 2)]
    field = spark.createDataFrame(rows, "year int, cell int, value double")
    events = spark.createDataFrame([(y, "high" if y % 2 else "low") for y in range(20)], "year int, kind string")
    got = {r.cell: r for r in composite.significant(composite.high_low(field, events, ["cell"])).collect()}
    assert got[1].p_value < 1e-4 and got[1].kept == got[1].diff and (got[2].kept is None) == (got[2].p_value >= 0.05)
