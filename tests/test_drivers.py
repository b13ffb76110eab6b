"""Drivers from fields to results: coupled modes without the cold tongue, models on a graph, winds as they are drawn."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import composite, coupled, edges, lagged

STAMPS = [datetime.date(1980 + k // 4, 1 + 3 * (k % 4), 1) for k in range(60)]


def months(x):
    """Standardised by calendar month (quarter)."""
    out = x.copy()
    for q in range(4):
        own = x[q::4]
        out[q::4] = (own - own.mean(axis=0)) / own.std(axis=0)
    return out


def test_coupled_driver_equals_numpy(spark):
    rng = np.random.default_rng(1)
    lat, lon = np.array([-20.0, -4.0, 4.0, 20.0]), np.array([-170.0, -120.0, 170.0, 20.0])
    fields = {n: rng.normal(size=(60, 4, 4)) for n in ("sst", "u", "v")}
    for f in fields.values():
        f += rng.normal(size=(60, 1, 1)) * rng.random((4, 4))
    fields["u"][3, 0, 0] = np.nan  # the cell counts for no wind
    table = {n: spark.createDataFrame([(float(a), float(o), STAMPS[t], None if np.isnan(f[t, i, j]) else float(f[t, i, j])) for t in range(60) for i, a in enumerate(lat) for j, o in enumerate(lon)], "lat double, lon double, season date, value double") for n, f in fields.items()}
    parts, pattern, winds, percent = coupled.drive(table["sst"], table["u"], table["v"], (-30, 30, -180, 0), ["lat", "lon"], 2)

    w = np.cos(np.radians(lat))
    box = fields["sst"][:, 1:3, :2]  # 6S-6N; 190E and 240E
    signal = months(((box * w[1:3, None]).sum(axis=(1, 2)) / (w[1:3, None] * np.ones((1, 2))).sum())[:, None])[:, 0]
    base = np.column_stack([np.ones(60), signal])

    def ready(f):
        x = f[:, :, :2].reshape(60, -1)  # longitudes within the box
        ok = ~np.isnan(x).any(axis=0)
        x[:, ok] -= base @ np.linalg.lstsq(base, x[:, ok], rcond=None)[0]
        return months(x) * np.repeat(np.sqrt(w), 2)

    x, u, v = (ready(fields[n].copy()) for n in ("sst", "u", "v"))
    good = ~np.isnan(u).any(axis=0)
    y = np.concatenate([u[:, good], v[:, good]], axis=1)
    p, s, q = np.linalg.svd(x.T @ y / 59, full_matrices=False)
    assert percent == pytest.approx(100 * s[:2] ** 2 / (s**2).sum(), rel=1e-6)
    pc = x @ p[:, :2]
    got = {(r.season, r.mode): r.left for r in parts.collect()}
    mine = np.array([[got[t, k] for k in (1, 2)] for t in STAMPS])
    for k in range(2):
        want = months(pc)[:, k]
        assert abs(np.corrcoef(mine[:, k], want)[0, 1]) == pytest.approx(1, abs=1e-6)
    shape = {(r.lat, r.lon): r.pattern for r in pattern.filter("mode = 1").collect()}
    assert len(shape) == 8
    want = p[:, 0] / np.repeat(np.sqrt(w), 2) * pc[:, 0].std()
    seen = np.array([shape[a, o] for a in lat for o in lon[:2]])
    assert np.abs(seen) == pytest.approx(np.abs(want), rel=1e-6)
    blown = {(r.lat, r.lon) for r in winds.filter("mode = 1 AND u IS NOT NULL AND v IS NOT NULL").collect()}
    assert len(blown) == 7 and (-20.0, -170.0) not in blown


def test_models_on_a_graph_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 80
    v = rng.normal(size=(n, 4))
    for t in range(3, n):
        v[t, 0] += 0.7 * v[t - 1, 1] - 0.4 * v[t - 3, 2] + 2
    hide = {(10, 0), (11, 0)}
    rows = [(s, t, f"v{k}", None if (t, k) in {(20, 1), (30, 0)} else float(v[t, k] * (1 + s)), (t, k) in hide) for s in (0, 1) for t in range(n) for k in range(4)]
    panel = spark.createDataFrame(rows, "run int, t int, var string, value double, masked boolean").repartition(3)
    graph = spark.createDataFrame([(s, "v0", p, lag) for s in (0, 1) for p, lag in (("v2", -3), ("v1", 1), ("v1", 1))] + [(0, "v3", "v3", 2)], "run int, target string, parent string, lag int")
    models = lagged.fit(panel, graph, ["run"])
    got = {(r.run, r.target): (r.n, r.coefs) for r in models.collect()}
    steps = [t for t in range(3, n) if t not in (10, 11, 21, 30)]
    a = np.column_stack([np.ones(len(steps)), [v[t - 1, 1] for t in steps], [v[t - 3, 2] for t in steps]])
    want = np.linalg.lstsq(a, v[steps, 0], rcond=None)[0]
    assert set(got) == {(0, "v0"), (1, "v0"), (0, "v3")} and got[0, "v0"][0] == len(steps)
    assert got[0, "v0"][1] == pytest.approx(want) and got[1, "v0"][1] == pytest.approx(want * [2, 1, 1])
    said = {(r.run, r.target, r.t): (r.y_true, r.y_pred) for r in lagged.predict(panel, graph, models, ["run"]).collect()}
    assert (0, "v0", 21) not in said and said[0, "v0", 80][0] is None  # a parent is unknown; one step past the end
    assert said[0, "v0", 80][1] == pytest.approx(want @ [1, v[79, 1], v[77, 2]]) and said[0, "v0", 30][0] is None
    assert lagged.fit(panel.limit(0), graph, ["run"]).count() == 0


def test_all_graphs_are_walked_together(spark):
    rows = [(s, k, 0.05, c, e, lag, 0.5, 0.01) for s in ("x", "y", None) for k in range(4) for c, e, lag in (("a", "goal", 3), ("b", "a", 1), ("c", "b", 3)) if s != "y" or c != "b"]
    runs = spark.createDataFrame(rows, "set string, run_idx int, alpha double, cause string, effect string, lag int, causal_effect double, p_value double")
    out = edges.graphs(runs.filter("set IS NOT NULL"), None, ["goal"])
    assert {(r.set, r.cause) for r in out.collect()} == {("x", "a"), ("x", "b"), ("y", "a")}


@pytest.mark.parametrize("scaling", [None, "waf"])
def test_drawn_winds_equal_numpy(spark, scaling):
    rng = np.random.default_rng(3)
    lat, lon = np.arange(-8, 9), np.arange(0, 23)
    maps, rows = {}, []
    for m in range(3):
        u, v = rng.normal(size=(2, 17, 23))
        sig = rng.random((17, 23)) < (0.0 if m == 2 else 0.7)
        u[0, 0] = v[0, 0] = 0.0
        maps[m] = u, v, sig
        rows += [(m, int(a), int(o), float(u[i, j]), float(v[i, j]), bool(sig[i, j])) for i, a in enumerate(lat) for j, o in enumerate(lon)]
    got = {(r.m, r.lat, r.lon): (r.u, r.v, r.width) for r in composite.winds(spark.createDataFrame(rows, "m int, lat int, lon int, u double, v double, significant boolean"), ["m"], scaling, equator=2).collect()}
    step = 7 if scaling else 5
    assert len(got) == 3 * len(lat[::step]) * len(lon[::step])
    for m, (u, v, sig) in maps.items():
        keep = sig & (np.abs(lat)[:, None] > 2) if scaling else sig
        u, v = np.where(keep, u, np.nan), np.where(keep, v, np.nan)
        size = np.hypot(u, v)
        ratio = np.ones_like(size)
        if scaling and keep.any():
            low, high = np.nanquantile(size, [0.05, 0.95])
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(size != 0, (1.4 + (np.clip(size, low, high) - high) * 0.8 / (high - low)) / size, 0)
        for i in range(0, 17, step):
            for j in range(0, 23, step):
                a, b, w = got[m, lat[i], lon[j]]
                if not keep[i, j]:
                    assert a is None and b is None and w == (0 if keep.any() else None)
                else:
                    assert (a, b, w) == (pytest.approx(u[i, j] * ratio[i, j]), pytest.approx(v[i, j] * ratio[i, j]), pytest.approx(3 * size[i, j] / np.nanmax(size)))
    assert composite.winds(spark.createDataFrame(rows[:1], "m int, lat int, lon int, u double, v double, significant boolean").drop("m"), [], scaling).select(F.count("*")).first()[0] == 1
