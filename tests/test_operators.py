"""Operators against closed forms and planted structure."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import distributions as dist
from gridloom.operators import edges, forecast, grid, modes, panel, pcmci, region_search, season, sphere, stats
from gridloom.sources import scan
from gridloom.streaming import windows


def test_t_distribution():
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert dist.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert dist.t_critical(0.01, 30) == pytest.approx(2.749996, abs=1e-5)


def test_ols_recovers_coefficients():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    b, p, r2 = stats.ols(3 + x @ [2.0, 0.0] + 0.1 * rng.normal(size=200), x)
    assert b == pytest.approx([2, 0], abs=0.05) and p[0] < 1e-6 < p[1] and r2 > 0.99
    assert np.isnan(stats.ols(np.ones(3), np.ones((3, 2)))[0]).all()


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    x, alpha = rng.normal(size=(100, 5)), 0.3
    y = x @ [1.5, 0, 0, -2, 0] + rng.normal(size=100)
    w = stats.lasso(y, x, alpha, tol=1e-12)
    g = (x - x.mean(0)).T @ (y - y.mean() - (x - x.mean(0)) @ w) / 100
    assert np.all(np.abs(g[w != 0] - alpha * np.sign(w[w != 0])) < 1e-6) and np.all(np.abs(g[w == 0]) <= alpha + 1e-9)


def test_varimax_is_a_rotation_that_simplifies():
    rng = np.random.default_rng(3)
    simple = np.zeros((40, 3))
    for k in range(3):
        simple[k * 13 : k * 13 + 13, k] = 1 + 0.1 * rng.normal(size=13)
    mixed = simple @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turned, r = modes.varimax(mixed)
    assert r @ r.T == pytest.approx(np.eye(3), abs=1e-8)
    assert np.sort(np.abs(turned), axis=1)[:, :2].max() < 0.2


def test_moments_and_eof_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(5)
    n, mean, gram = modes.moments(df, "x")
    assert n == 60 and mean == pytest.approx(x.mean(0)) and gram == pytest.approx((x - x.mean(0)).T @ (x - x.mean(0)))
    _, share = modes.eof(gram, 2)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert share == pytest.approx(s[:2] / s.sum())
    assert modes.moments(df.limit(0), "x")[0] == 0


def test_planted_lagged_link_is_found(spark):
    rng = np.random.default_rng(5)
    n = 240
    a, b, c = rng.normal(size=(3, n))
    for t in range(3, n):
        b[t] += 0.9 * a[t - 3]
        c[t] += 0.8 * b[t - 1]
    rows = [(0, 0.01, t, v, float(x[t]), False) for v, x in (("a", a), ("b", b), ("c", c)) for t in range(n)]
    df = spark.createDataFrame(rows, "run_idx int, alpha double, t int, var string, value double, masked boolean")
    got = {(r.cause, r.effect, r.lag): r for r in pcmci.discover(df, ["run_idx"], most=4, most_sets=5).collect()}
    strong = {k for k, r in got.items() if r.p_value < 1e-6}
    # conditions later than the cause are not used, so the chain a -> b -> c shows as a direct link too
    assert strong == {("a", "b", 3), ("b", "c", 1), ("a", "c", 4)} and len(got) == 36


def test_solid_rotation_and_divergent_flow():
    lat, lon = np.linspace(-87.5, 87.5, 36), np.arange(0, 360, 5.0)
    yy, xx = np.meshgrid(np.radians(lat), np.radians(lon), indexing="ij")
    out = sphere.diagnose(10 * np.cos(yy), np.zeros_like(yy), lat)
    expected = -10 * sphere.EARTH_RADIUS * np.sin(yy)
    assert out["psi"] == pytest.approx(expected, abs=1e-6 * np.abs(expected).max())
    assert np.abs(out["chi"]).max() < 1e-6 * np.abs(expected).max()
    # chi = cos(lat) cos(lon): u = -sin(lon)/a, v = -sin(lat) cos(lon)/a
    a = sphere.EARTH_RADIUS
    out = sphere.diagnose(-np.sin(xx) / a * 1e8, -np.sin(yy) * np.cos(xx) / a * 1e8, lat)
    assert out["chi"] == pytest.approx(1e8 * np.cos(yy) * np.cos(xx), abs=1e3) and np.abs(out["psi"]).max() < 1e3


def test_cubic_gap_fill():
    x = np.linspace(0, 1, 21)
    row = 2 * x + 1
    row[[5, 6, 12]] = np.nan
    filled = sphere.fill_gaps(np.tile(row, (6, 1)))
    assert filled == pytest.approx(np.tile(2 * x + 1, (6, 1)))
    cubic = 0.1 * x**3 - x**2 + 2
    holes = cubic.copy()
    holes[[1, 4, 5, 9]] = np.nan
    assert sphere.fill_gaps(np.tile(holes, (6, 1))) == pytest.approx(np.tile(cubic, (6, 1)))


def test_polygon_excludes_its_edge(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (3.0, 3.0)], "lon double, lat double")
    inside = df.filter(grid.in_polygon([(0, 0), (2, 0), (2, 2), (0, 2)])).collect()
    assert [tuple(r) for r in inside] == [(1.0, 1.0)]
    assert df.filter(grid.in_polygon([(0, 0), (4, 0), (0, 4)])).count() == 3


def test_anomalies_sum_to_zero_and_scores_have_unit_spread(spark):
    df = spark.createDataFrame([(f"{y}-{m:02d}-01", c, float((y * m * (c + 3)) % 17)) for y in range(2000, 2010) for m in (1, 4, 7, 10) for c in (0, 1)], "season string, cell int, value double").withColumn("season", F.to_date("season"))
    a = season.zscore_month(season.anomaly(df, ["cell"]), ["cell"], "anom")
    r = a.groupBy("cell", F.month("season")).agg(F.sum("anom").alias("s"), F.stddev_pop("z").alias("d")).collect()
    assert all(abs(x.s) < 1e-9 and (x.d is None or abs(x.d - 1) < 1e-9) for x in r)


def test_exact_alignment_raises(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, value double")
    assert panel.align_exact(a, a, ["k"]).count() == 2
    with pytest.raises(Exception, match="labels differ"):
        panel.align_exact(a, a.filter("k = 1"), ["k"]).collect()


@pytest.mark.parametrize("mode", ["bounded", "open"])
def test_traversal_equals_brute_force(spark, mode):
    rng = random.Random(6)
    table = sorted({(f"v{rng.randrange(7)}", f"v{rng.randrange(7)}", rng.randint(1, 3)) for _ in range(18)})
    low, high, targets = (2 if mode == "bounded" else 0), 6, ["v0", "v1"]
    kept = set()
    for target in targets:
        queue, seen = [(target, 0)], {(target, 0)}
        while queue:
            at, cum = queue.pop()
            for e in table:
                if e[1] == at and low <= cum + e[2] <= high:
                    kept.add(e)
                    state = (e[0], cum + e[2])
                    if state not in seen and (mode == "bounded" or e[0] not in targets):
                        seen.add(state)
                        queue.append(state)
    df = spark.createDataFrame(table, "cause string, effect string, lag int")
    assert {tuple(r) for r in edges.toward(df, targets, high, low, mode).collect()} == kept


def test_rectangles_stay_valid_and_search_finds_the_peak():
    b = region_search.Bounds(-40, 40, -100, 100)
    rng = random.Random(7)
    r = region_search.draw(rng, b)
    for _ in range(300):
        r = region_search.mutate(rng, region_search.crossover(rng, r, region_search.draw(rng, b), b), b, 15)
        assert region_search.valid(r, b)
        assert region_search.to_rect(region_search.to_vertices(r)) == r
    with pytest.raises(ValueError):
        region_search.to_rect([(0, 0), (1, 0), (2, 1), (0, 1)])
    want = region_search.Rect(-10, 10, -20, 30)
    score = lambda rects: [1 / (1 + sum(abs(p - q) for p, q in zip(x, want, strict=True))) for x in rects]
    best, fitness, history = region_search.search(score, b, refinements=2000)
    assert best == want and fitness == 1 and history == sorted(history)


def test_folds_predict_only_from_the_past(spark):
    rows = [(t, float(t), 2.0 * t + 1, "k") for t in range(40)]
    df = spark.createDataFrame(rows, "t int, x0 double, y double, key string")
    got = forecast.predict_folds(df, ["key"], ["x0"], 3).collect()
    assert len(got) == 30 and all(abs(r.y_true - r.y_pred) < 1e-8 for r in got)
    x = np.random.default_rng(8).normal(size=(40, 2))
    assert forecast.tuned(x, np.zeros(40), "ridge", 3, {"alpha": [0.1, 1.0]})(x) == pytest.approx(np.zeros(40))


def test_scan_normalises(spark, tmp_path):
    df = spark.createDataFrame([("2000-01-01", 0, 10.0, 350.0, 500, 1.0), ("2000-01-01", 0, 10.0, 350.0, 300, float("nan"))], "valid_time string, number int, latitude double, longitude double, pressure_level int, u double")
    r = scan.normalise(df, level=500, scale=2.0).collect()
    assert [tuple(x) for x in r] == [("2000-01-01", 10.0, -10.0, 2.0)]
    mean = scan.normalise(df, mean_levels=(300, 500)).collect()
    assert mean[0]["value"] == 1.0
    path = str(tmp_path / "f")
    scan.write_field(scan.normalise(df), path, ("level",))
    assert scan.results(spark, path, level=500).count() == 1
    assert {r.format for r in scan.file_formats(spark, f"{path}/level=500/*.parquet").collect()} == {"parquet"}
    assert scan.valid_area((10, -20, -10, 20)) and not scan.valid_area((-10, 0, 10, 20)) and scan.valid_grid((1.0, 1.0))


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    events.write.parquet(path)
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(path), "1 day", ["event_type"], "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type, r.n) for r in spark.table("tumbling").collect()}
    assert got == {(r.start, r.event_type, r.n) for r in windows.tumbling(events, "1 day", ["event_type"]).collect()}
